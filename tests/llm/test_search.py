"""Exact search against a double loop."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    def weights(v):
        return [math.floor(64 * float(np.float32(x))) for x in v]

    valid = [(i, weights(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, v in valid:
        if i % every or (i, tuple(v)) in seen:
            continue
        seen.add((i, tuple(v)))
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in valid if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def test_against_loops(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) if rng.random() < 0.7 else 0.0 for _ in range(12)]) for i in range(300)]
    rows += [(i, [0.5, -0.25]) for i in range(400, 460)]  # ties, shorter vectors
    rows += [(20, rows[20][1]), (21, rows[21][1]), (21, rows[21][1]), (460, []), (480, [0.0] * 12)]
    rows += [(None, [1.0]), (500, None), (520, [1.0, None]), (521, [float("nan")]), (540, [float("inf"), 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    found = topk.top_k(df)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(20, [1.0])], [(1, [1.0]), (2, [1.0])]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("block", topk.F.lit(1)).withColumn("score", topk.F.lit("x"))
    assert topk.top_k(df).collect() == []


def test_large_weights_take_64_bits():
    found = list(topk.search(np.array([20]), pa.array([[1e6, 1.0]]), np.array([1, 2]), pa.array([[1e6, 0.0], [-1e6, 3.0]]), 5))
    assert found[0][1].tolist() == [1, 2] and found[0][2].tolist() == [64**2 * 10**12, -(64**2) * 10**12 + 64 * 192]

"""Hard negatives against a plain loop over all pairs."""

import math
import random

import numpy as np
import pytest

from ledgerloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    valid = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        valid.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out, seen = [], set()
    for i, v, label in valid:
        if i % 100 or (i, tuple(v), label) in seen:
            continue
        seen.add((i, tuple(v), label))
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in valid if j != i)
        for p, pid, _ in [x for x in scored if x[2] == label][:5]:
            window = [x for x in scored if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            out += [(i, pid, r + 1, j, -p, -s) for r, (s, j, _) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("block", [64, 8192])
def test_against_loops(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "CANDIDATES", block)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0.1, 0.2) for _ in range(6)], rng.randrange(4)) for i in range(900)]
    rows += [(i, [0.25, 0.5], i % 3) for i in range(1000, 1400)]  # one vector many times
    rows += [(100, rows[100][1], rows[100][2]), (101, rows[101][1], rows[101][2]), (1500, [], 2), (1600, [-1.0] * 6, 1)]
    rows += [(None, [1.0], 1), (1700, None, 1), (1800, [1.0, None], 1), (1801, [float("nan")], 1), (1900, [float("inf")], 1), (2000, [1.0], None)]
    found = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


def test_bounded_lists_inside_a_cell(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TILE", 256)
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.5, 0.25, 1.0]) for _ in range(3)], rng.randrange(3)) for i in range(500)]
    assert sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)


def test_large_weights(spark):
    rows = [(100, [3e5, 1.0], 1), (101, [2e5, 0.5], 1), (102, [1.9e5, 1.0], 2), (103, [1.7e5, 1e6], 3)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label long")
    assert sorted(tuple(r) for r in negatives.hard_negatives(df).collect()) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(100, [1.0], 1)], [(100, [1.0], 1), (101, [1.0], 1)], [(100, [1.0], 1), (101, [1.0], 2)]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("mark", "low", "slot", "block", "is_anchor"):
        df = df.withColumn(name, negatives.F.lit("x"))
    assert negatives.hard_negatives(df).collect() == []

"""Toxic passages: segments by definition, counts by a loop, accuracy on rows that were not learned from."""

import collections
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from ledgerloom.llm import toxicity

SYLLABLES = ["ka", "lo", "mi", "ten", "ru", "so", "bel", "ar", "in", "tu"]


def by_definition(values):
    """The best segment (shortest, then first), and the same on both sides of it."""
    best = None
    for a in range(len(values)):
        total = 0.0
        for b in range(a, len(values)):
            total += values[b]
            if total > 0 and (best is None or total > best[2] + 1e-12 or (abs(total - best[2]) <= 1e-12 and b - a < best[1] - best[0])):
                best = (a, b, total)
    if best is None:
        return []
    left, right = by_definition(values[: best[0]]), by_definition(values[best[1] + 1 :])
    return left + [best] + [(a + best[1] + 1, b + best[1] + 1, s) for a, b, s in right]


def test_segments_by_definition():
    rng = random.Random(2)
    for _ in range(300):
        values = [rng.choice([-0.25, -0.25, -0.25, round(rng.uniform(0.1, 2), 3)]) for _ in range(rng.randrange(0, 40))]
        places = [i for i, v in enumerate(values) if v > 0]
        found = toxicity.segments(places, [values[i] for i in places])
        want = by_definition(values)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(found, want))


def test_segments_are_linear():
    n = 400_000
    assert len(toxicity.segments(list(range(0, 10 * n, 10)), [1.0] * n)) == n
    (whole,) = toxicity.segments(list(range(n)), [1.0] * n)
    assert whole[:2] == (0, n - 1)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def test_features_by_a_loop(spark):
    rng = random.Random(8)
    rows = []
    for k in range(300):
        toxic = int(k % 3 == 0)
        body = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(30)]
        for _ in range(3 * toxic):
            body.insert(rng.randrange(30), rng.choice(["grumbold", "zappelot", "zappelin", "zappe"]) + rng.choice(["", "s", "x"]))
        rows.append((" ".join(body), toxic))
    rows += [("same zappelot words here " * 3, 0)] * 50  # copies count once
    seen = collections.defaultdict(lambda: [0, 0])
    for text, toxic in rows:
        listed = words(text)
        for before, word in zip(["", *listed], listed):
            seen[word, before][toxic] = 1
    counts = collections.defaultdict(lambda: [0, 0])
    for (word, _), (c, t) in seen.items():
        for name in {(0, word)} | {(k, word[:k]) for k in toxicity.BEGINNINGS if len(word) >= k}:
            counts[name][0] += c
            counts[name][1] += t
    total = [sum(v[i] for k, v in counts.items() if k[0] == 0) for i in (0, 1)]
    base = (total[1] + 1) / (sum(total) + 2)
    odds = lambda r: math.log(r / (1 - r))
    want = {}
    for (kind, name), (c, t) in counts.items():
        rate = base
        for k in [k for k in toxicity.BEGINNINGS if k <= len(name) and (not kind or k <= kind)] + [0] * (not kind):
            above = rate
            pc, pt = counts[k, name[:k] if k else name]
            rate = (pt + toxicity.PRIOR * above) / (pc + pt + toxicity.PRIOR)
        score = odds(rate) - odds(base)
        error = math.sqrt(1 / (t + toxicity.PRIOR * above) + 1 / (c + toxicity.PRIOR * (1 - above)))
        if score >= 1 and score / error >= toxicity.Z:
            want[kind, name] = score
        elif score < 1 and odds(above) - odds(base) >= 1:
            want[kind, name] = 0.0
    found = {(r.kind, r.name): r.score for r in toxicity.features(spark.createDataFrame(rows, "text string, toxic int")).collect()}
    assert found.keys() == want.keys() and any(k == (5, "zappe") for k in want)
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def corpus(n=1500, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.15)
        body = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(rng.choice([5, 40, 400]))]
        for _ in range(2 + len(body) // 50 if toxic else 0):
            body.insert(rng.randrange(len(body)), rng.choice(["Grumbold", "zappe" + "".join(rng.choice(SYLLABLES) for _ in range(2))]))
        docs.append((i, " ".join(body)))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_passages(spark):
    docs, labels = corpus()
    toxic = {i: t for i, _, t in labels}
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = toxicity.toxicity(docs_df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.n_passages == len(r.passages)
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == toxic[r.doc_id] for r in held)
    assert right >= 0.97 * len(held)
    text = dict(docs)
    hits = [words(text[r.doc_id])[p["first"] : p["last"] + 1] for r in held if toxic[r.doc_id] for p in r.passages]
    assert hits and all(h[0][:5] in ("grumb", "zappe") and h[-1][:5] in ("grumb", "zappe") for h in hits)


def test_odd_rows(spark):
    docs, labels = corpus(400)
    long = "kalo miten " * 300_000 + "grumbold zappelot grumbold"
    extra = [(9000, None), (9001, ""), (9002, "   é中!!"), (9003, long), (9003, long), (None, "grumbold grumbold zappelot")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string")
    for name in ("score", "toxic", "_id", "passages", "words", "aside"):
        df = df.withColumn(name, toxicity.F.lit("x"))
    marks = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (7, 0, 3)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(df, marks).collect()
    assert len(rows) == len(docs) + len(extra)
    assert sum(r.doc_id == 9003 for r in rows) == 2
    empty = {r.score for r in rows if r.doc_id in (9000, 9001, 9002)}
    assert len(empty) == 1 and empty.pop() < 0.3
    assert not any(r.held_out for r in rows if r.doc_id is None)
    clean = toxicity.drop_toxic(df, marks, df)
    assert clean.columns == df.columns and clean.where("doc_id in (9000, 9001, 9002)").count() == 3


@pytest.mark.parametrize("toxic", [[], [0, 0, 0, 0], [1, 1, 1, 1]])
def test_without_both_labels(spark, toxic):
    df = spark.createDataFrame([(i, "some words") for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    rows = toxicity.toxicity(df, labels).collect()
    assert len({r.score for r in rows}) == 1 and len(rows) == 4
    assert toxicity.toxicity(df.limit(0), labels).collect() == []


def test_unknown_words_have_no_score():
    model = toxicity.Model([toxicity.np.zeros(0, "u8")] * 5, [toxicity.np.zeros(0)] * 5)
    assert list(toxicity.passages(pa.array(["a b", None]), model)) == [(2, []), (0, [])]

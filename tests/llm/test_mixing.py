"""Targets against repeated resharing, the mix against its rules."""

import random

import pytest

from ledgerloom.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], COLUMNS)


def reshared(sizes, weights=(5, 2, 1), passes=3):
    """Targets by capping and sharing the excess again and again; sources in order."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > passes * sizes[s]]
        if not above:
            return {**capped, **share}
        capped.update({s: passes * sizes[s] for s in above})


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "z", "😀", "tiny"]
    rows = [(k, "w " * rng.randrange(0, 90), rng.choice(names[:-1] + ["a"] * 8)) for k in range(500)]
    rows += [(900, "one two", "tiny"), (901, None, "a"), (902, " \t\n\x0b\x0c\r", "a"), (903, "x" * 50000 + " y" * 3000, "z")]
    found = mixing.mix(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes = {}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    targets = reshared(sizes)
    taken = {}
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 12 + 0.01 * target
    again = mixing.mix(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_rows_of_the_mix(spark):
    rng = random.Random(9)
    rows = [(k, "w " * rng.randrange(0, 40), rng.choice("abc")) for k in range(200)]
    docs = frame(spark, rows).withColumn("_turn", mixing.F.lit(1)).withColumn("size", mixing.F.lit("x"))
    plan = {r.doc_id: (r.taken, r.size) for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert times == {d: -(-t // n) for d, (t, n) in plan.items() if t}


def test_small_sources_by_large_blocks(spark, monkeypatch):
    """Blocks of 4096 words, as on large input: every source's taken words are its rounded target."""
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 1)
    rows = [(k, "w " * 5000, "hot") for k in range(400)]
    words = {"b": 300, "c": 900, "d": 4097, "e": 30000, "a": 1, "z": 2500}
    for k, (source, n) in enumerate(words.items()):
        rows += [(1000 + 100 * k + j, "v " * (n // 10 + (j < n % 10)), source) for j in range(10)]
    docs = frame(spark, rows)
    found = mixing.mix(docs).collect()
    taken, targets = {}, reshared({**words, "hot": 2_000_000})
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in targets.items())
    assert {r.source for r in mixing.mixed(docs).select("source").distinct().collect()} == {*words, "hot"}


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(None, "a b c", None), (None, "a b c", None)], [(1, "a", "s"), (1, "a", "s")]])
def test_small_tables(spark, rows):
    found = mixing.mix(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    assert sum(r.taken for r in found) == sum(len((t or "").split()) for _, t, _ in rows)
    assert mixing.mixed(frame(spark, rows)).count() == sum(bool(t) for _, t, _ in rows)

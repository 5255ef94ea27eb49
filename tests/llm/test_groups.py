"""Components and near-duplicate groups against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import components, minhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(shape)
    if shape == "chain":
        order = rng.sample(range(60), 60)
        edges = list(zip(order, order[1:]))
    elif shape == "star":
        edges = [(500, k) for k in range(200)] + [(7, 7)]
    elif shape == "random":
        edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    else:
        edges = []
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "u long, v long")
    found = {r.id: r.component for r in components.components(df).collect()}
    assert found == union_find([e for e in edges if e[0] != e[1]])


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(docs, percent=85):
    sets = {d: shingles(t) for d, t in docs if d is not None}
    ids = sorted(sets)
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    group = union_find(links)
    return {(d, len(sets[d]), group.get(d, d), group.get(d, d) == d) for d in ids}


def documents(spark, docs):
    return spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], COLUMNS)


def test_near_duplicates_with_edits(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    docs = []
    for k in range(160):  # copies with ever more edits: links in chains, pairs just below the line, and some far off
        words = list(base)
        for _ in range(k % 14):
            words[rng.randrange(150)] = word()
        docs.append((1000 + k, " ".join(words)))
    docs += [(k, " ".join(word() for _ in range(60))) for k in range(50)]
    docs += [(300 + k, " ".join(base)) for k in range(40)]
    docs += [(400, None), (401, ""), (402, " \n\t "), (403, "One two"), (404, "one TWO"), (405, "one two three")]
    docs += [(406, "one two"), (407, " ".join(base * 300)), (408, "\n".join(base * 300)), (1000, docs[0][1])]
    found = [tuple(r) for r in minhash.near_duplicates(documents(spark, docs)).collect()]
    assert len(found) == len(docs) and set(found) == brute(docs)


def test_cells_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 8)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    docs = []
    for k in range(90):
        words = list(base)
        for at in rng.sample(range(80), k % 5):
            words[at] = f"x{rng.randrange(10**6)}"
        docs.append((k, " ".join(words)))
    found = {tuple(r) for r in minhash.near_duplicates(documents(spark, docs)).collect()}
    assert found == brute(docs)


def test_empty_and_null(spark):
    assert minhash.near_duplicates(documents(spark, [])).collect() == []
    found = minhash.near_duplicates(documents(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (4, "A b C d e f")])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found) == [
        ("3", 2, "3", True), ("4", 2, "3", False), ("None", 2, "None", True),
    ]


def test_drop_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 9, 8), (2, "a b c d e f", 7, 6), (None, "x", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep long, _gone long")
    left = minhash.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(map(str, (tuple(r) for r in left.collect()))) == ["(1, 'a b c d e f', 9, 8)", "(None, 'x', None, None)"]


def test_shingle_sets_match_words():
    texts = ["A b c d e f g", "a B c D e f g", "a b c d e", "a b", "", None, "ä ö ü ß é x", "a b c d e f g h" * 5]
    found = list(minhash.shingle_sets(pa.array(texts)))
    assert [len(s) for s in found] == [len(shingles(t)) for t in texts]
    assert np.array_equal(found[0], found[1]) and not np.array_equal(found[2][:1], found[3])

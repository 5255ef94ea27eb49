"""License scans, spot signatures and the quality classifier."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import licenses, quality, spotsigs

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], COLUMNS)


def filled(template, rng, optional, wrong=False):
    """A text that the template accepts, or with ``wrong`` one that breaks its mandatory wording."""
    out = []
    for kind, value in licenses.parts(template):
        if kind == "word":
            out.append(value.decode())
        elif kind == "any":
            out += ["anything"] * rng.randrange(0, value + 1)
        elif optional:
            out += [w.decode() for w in value]
    if wrong:
        at = rng.randrange(1, len(out) - 1)
        out.insert(at, "zzz")
    return ", ".join(w.upper() if rng.random() < 0.3 else w for w in out)


@pytest.mark.parametrize("label", sorted(licenses.TEMPLATES))
def test_templates(label):
    rng, template = random.Random(label), licenses.TEMPLATES[label]
    automaton, regex = licenses.Automaton(template), re.compile(licenses.pattern(template))
    for k in range(30):
        text = "before - " + filled(template, rng, k % 2, wrong=k % 3 == 2) + ". After"
        words = text.encode().translate(licenses._PLAIN).split()
        joined = b" " + b" ".join(words) + b" "
        found = automaton.anchor in joined and automaton.matches(words)
        assert found == bool(regex.search(joined.decode()))
        if k % 3 != 2:
            assert found


def test_scan(spark):
    rows = [
        (1, "Released under the MIT License. mit\nlicense"), (2, "MIT-LICENSE, Apache license; general, public license!"), (3, None), (4, ""),
        (5, "Licensed under CC BY-NC 4.0."), (6, "Mitt license é"), (7, "mit license " * 20000), (None, "x"), (1, "again"),
        (8, "This work is licensed under the GNU General Public License, version 3."), (9, "licensed under the Apache  License, Version 2.0"),
    ]
    found = licenses.scan(frame(spark, rows).withColumn("score", licenses.F.lit("x")))
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 3)) for r in found.collect())
    assert got == [
        ("1", 1, 0, None, None, "", "", 0.0), ("1", 7, 2, 3, 5, "mit", "mit,mit-notice", 0.8), ("2", 7, 3, 0, 4, "apache,gpl,mit", "apache,gpl,mit", 0.75),
        ("3", 0, 0, None, None, "", "", 0.0), ("4", 0, 0, None, None, "", "", 0.0), ("5", 7, 0, None, None, "", "cc-by-nc-4.0", 0.667),
        ("6", 3, 0, None, None, "", "", 0.0), ("7", 40000, 20000, 0, 39998, "mit", "mit", 1.0), ("8", 12, 1, 7, 7, "gpl", "gpl,gpl-3.0", 0.75),
        ("9", 8, 1, 3, 3, "apache", "apache,apache-2.0", 0.75), ("None", 1, 0, None, None, "", "", 0.0),
    ]
    assert licenses.scan(frame(spark, [])).collect() == []


def chains(text, chain=3):
    """Spots as tuples of words, by plain loops."""
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    common = set(spotsigs.ANCHORS)
    out = set()
    for k in [-1, *(k for k, w in enumerate(words) if w in common)]:
        after = [w for w in words[k + 1 :] if w not in common][:chain]
        if after:
            out.add((words[k] if k >= 0 else None, *after))
    return out


def test_spots_match_loops():
    rng = random.Random(2)
    vocabulary = ["the", "of", "a", "über", "été", "house", "dog", "tree", "Ärger", "x1", "run"]
    texts = ["", None, "the of", "...", "dog", "The dog, a TREE of run!", "été für"]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    found = list(spotsigs.spot_sets(pa.array(texts)))
    for text, spots in zip(texts, found):
        want = len(chains(text or ""))
        assert len(spots) == (want if want else bool(text)), text
    for k in range(0, 180, 7):
        x, y = chains(texts[10 + k]), chains(texts[17 + k])
        if x and y:
            assert abs(spotsigs.likeness(found[10 + k], found[17 + k]) - len(x & y) / len(x | y)) < 1e-9


def test_pruning_changes_no_likeness():
    rng = random.Random(3)
    for _ in range(300):
        x, y = (np.unique(np.array([rng.randrange(300) for _ in range(rng.randrange(0, 400))], "<u4")) for _ in range(2))
        exact = spotsigs.likeness(x, y)
        for least in (0.2, 0.5, 0.8):
            assert spotsigs.likeness(x, y, least) == (exact if exact >= least else 0.0)


def test_partitions_are_wide_enough():
    for size in range(1, 3000, 7):
        assert spotsigs.partition(size) - spotsigs.partition(-(-size * 8 // 10)) <= 1


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_compare_with_next(spark, partitions):
    rng = random.Random(5)
    rows = [(k * 3, " ".join(rng.choice(["the", "é", "dog", "of", "cat", "漢字", "run"]) for _ in range(rng.randrange(0, 40)))) for k in range(120)]
    rows[5], rows[6], rows[7] = (15, None), (18, ""), (21, "word " * 30000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {r.doc_id: r for r in spotsigs.compare_with_next(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == len(rows)
    for (doc, text), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        text, after, r = text or "", after or "", found[doc]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, new, following = spotsigs.spot_sets(pa.array([text, edited, after]))
        assert (r.fingerprint, r.edited_fingerprint) == (spotsigs.fingerprint(own), spotsigs.fingerprint(new))
        assert r.near_edited == spotsigs.likeness(own, new) and r.near_next == spotsigs.likeness(own, following)


def test_compare_few(spark):
    assert spotsigs.compare_with_next(frame(spark, [])).collect() == []
    (one,) = spotsigs.compare_with_next(frame(spark, [(4, "the dog ran off")])).collect()
    assert one.near_next == 1.0
    found = spotsigs.compare_with_next(frame(spark, [(None, "a b"), (1, "the dog"), (1, "the dog"), (1, "the cat")])).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "1", "1", "None"]
    equal = [r.fingerprint for r in found if r.n_chars == 7]
    assert len(set(equal)) == 2


GOOD = "the of and was for that with house garden water river stone morning light".split()


def corpus(n, rng):
    rows = []
    for k in range(n):
        words = [rng.choice(GOOD) for _ in range(rng.randrange(20, 60))]
        bad = k % 3 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if k % 2 else [w + "$$%" for w in words]
        rows.append((k, " ".join(words), 0 if bad else 1))
    return rows


def test_quality(spark, monkeypatch):
    rng = random.Random(7)
    rows = corpus(300, rng)
    docs = frame(spark, [(d, t) for d, t, _ in rows] + [(None, "the house"), (900, None), (901, ""), (902, "stone " * 40000), (5, "the river")])
    docs = docs.withColumn("score", quality.F.lit("x")).withColumn("_quality", quality.F.lit(3))
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in rows] + [(None, 1, 0), (1000, 0, 0), (4, None, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality.quality(docs, labels).collect()
    assert len(found) == 305 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    truth = {d: q for d, _, q in rows}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    again = quality.quality(docs, labels).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    kept = quality.keep_good(docs, labels, docs)
    assert kept.columns == docs.columns and kept.where("_quality = 3").count() == kept.count()


def test_quality_without_labels(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.quality(docs, none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, one).count() == 2
    assert quality.quality(frame(spark, []), one).collect() == []


@pytest.mark.parametrize("cell", [512, 4])
def test_near_copies(spark, monkeypatch, cell):
    monkeypatch.setattr(spotsigs, "CELL", cell)
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "of", "is", "a"]) if rng.random() < 0.3 else f"w{rng.randrange(10**5)}"
    base = [word() for _ in range(150)]
    docs = []
    for k in range(60):
        words = list(base)
        for _ in range(k % 12):
            words[rng.randrange(150)] = word()
        docs.append((100 + k, " ".join(words)))
    docs += [(k, " ".join(word() for _ in range(rng.randrange(1, 80)))) for k in range(40)]
    docs += [(200 + k, " ".join(base)) for k in range(9)] + [(300, None), (301, ""), (302, "the of"), (303, "The, of!"), (100, docs[0][1])]
    sets = {d: set(s.tolist()) for d, s in zip([d for d, _ in docs], spotsigs.spot_sets(pa.array([t for _, t in docs])))}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            if sets[x] and sets[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) - 1e-9:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    found = spotsigs.near_copies(frame(spark, docs + [(None, "the dog")])).collect()
    assert len(found) == len(docs) + 1
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_spots, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert spotsigs.near_copies(frame(spark, [])).collect() == []

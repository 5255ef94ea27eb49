"""Spelling variants against sets of words with one code point left out."""

import collections
import random
import re
import zlib

import pytest

from ledgerloom.llm import variants

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, length=7, count=2, factor=10, typo=31):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= length:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= count}
    cut = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            cut[w[:k] + w[k + 1 :]].add((w, k))
    near = collections.defaultdict(set)
    for short, owners in cut.items():
        for w, k in owners:
            if short in words:
                near[w].add(short)
                near[short].add(w)
            near[w] |= {x for x, j in owners if j == k and x != w}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= factor * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def texts(seed=3, letters="abÀé", stems=60):
    rng = random.Random(seed)
    out = []
    for _ in range(stems):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 12)))
        out.append((len(out), " ".join([word] * rng.choice([1, 3, 40, 500]))))
        for _ in range(6):
            at, kind = rng.randrange(len(word)), rng.randrange(3)
            other = word[:at] + ("" if kind == 0 else rng.choice(letters)) + word[at + (kind < 2) :]
            out.append((len(out), f"{other}, {other.upper()}; {other} 1{word}2 "))
    return out


@pytest.mark.parametrize(("group", "bucket", "tile"), [(8192, 16384, 1 << 17), (3, 40, 4), (1, 7, 1)])
def test_against_sets(spark, monkeypatch, group, bucket, tile):
    """Also with groups dealt into blocks and buckets of a few words."""
    monkeypatch.setattr(variants, "GROUP", group)
    monkeypatch.setattr(variants, "BUCKET", bucket)
    monkeypatch.setattr(variants, "TILE", tile)
    rows = texts() + [(None, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa"), (5, None), (6, ""), (7, "kurz ×÷×÷×÷×÷ ×÷×÷×÷×÷")]
    rows += [(9, "repeated words repeated words"), (9, "repeated words repeated words")]
    found = rows_of(variants.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == brute(rows)
    assert any(r[1] for r in found)


def test_chains_and_ties(spark):
    rows = [(1, "abcdefg " * 3), (2, "abcdefgh " * 40), (3, "abcdefghi " * 500), (4, "bbcdefgh " * 500), (5, "abcdefghij " * 6000)]
    want = brute(rows, typo=10**9)
    found = rows_of(variants.variants(spark.createDataFrame(rows, "doc_id long, text string"), typo=0))
    assert found == want
    assert {r[0]: r[2] for r in found}["abcdefg"] == "abcdefghij"


def test_long_text_and_clashing_names(spark):
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("xyz") for _ in range(8)) for _ in range(30000))
    df = spark.createDataFrame([(1, long, "a", 2)], "doc_id long, text string, word string, n int")
    assert rows_of(variants.variants(df)) == brute([(1, long)])


def test_no_words(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(variants.variants(df)) == []
    assert rows_of(variants.variants(spark.createDataFrame([(1, "once upon"), (2, None)], "doc_id long, text string"))) == []

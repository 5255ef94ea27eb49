"""Token files, Huffman codes and pieces: against the library, a plain search, and round trips."""

import functools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from ledgerloom.llm import huffman, pieces, tokenfiles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    "", None, "Hello world", "  two  spaces \n\n and\tlines\r\n ", "it's we'll I'D 12345 6,78", "ÄÖ ß é 漢字 😀 ñ x y　z",
    "<|endoftext|> </s> <s> <0x0A> ▁mark ▁", "hi <|endoftext|> there", "<|endoftext|><|endoftext|>\n\n  x", "a\x1cb \x85c\x00d", "\n", " ", "word " * 500, "x" * 5000, "a" + "́" * 3 + "﻿",
]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], COLUMNS)


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenfiles.vocabulary_path())


def direct(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def test_units_give_the_tokenizers_ids():
    path = tokenfiles.vocabulary_path()
    rng = random.Random(2)
    alphabet = list("ab cd\n\t'sé1 9.,! 漢") + ["  ", " \n", "the ", "'ll"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    ids, offsets = tokenfiles.encode_batch(texts, path)
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == direct(text), repr(text)


def agree(texts):
    ids, offsets = tokenfiles.encode_batch(texts, tokenfiles.vocabulary_path())
    assert len(offsets) == len(texts) + 1
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == direct(text), repr(text)


@pytest.mark.parametrize("joins", [True, False])
def test_words_of_letters_and_marks_give_the_tokenizers_ids(monkeypatch, joins):
    """Also next to the characters and letters that stand between them on their way to the library."""
    if not joins:
        monkeypatch.setattr(tokenfiles, "_separable", lambda *_: False)
    tokenfiles._table.cache_clear()
    rng = random.Random(9)
    some = ["\x01", "\x01 ", "\x00", "Ā", "ā", "é", "ß", "×", "÷", "ÿ", "À", "'", "'s", ",", "...", "(", "\"", "—", "7", "word", "The", "\u0301", "\n", " ", " ", " "]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(0, 30))) for _ in range(600)]
    agree(texts + ["", "a", ",", "\n", "a\n,b.c d", "one\n\ntwo", "hi <|endoftext|>", "x" * 3000 + "," * 3000 + "é" * 3000])
    agree([])
    agree(["", ""])
    agree(["<|endoftext|>"])
    tokenfiles._table.cache_clear()


def test_new_words_reach_the_library_together(monkeypatch):
    import tokenizers

    real, calls = tokenizers.Tokenizer, []

    class Model:
        def __init__(self, inner):
            self.inner, self.token_to_id = inner, inner.token_to_id

        def tokenize(self, text):
            calls.append(text)
            return self.inner.tokenize(text)

    class Counted:
        def __init__(self, model):
            self.inner = real(model.inner)

        @classmethod
        def from_file(cls, path):
            made = cls(Model(real.from_file(path).model))
            made.inner = real.from_file(path)
            return made

        @property
        def model(self):
            return Model(self.inner.model)

        def encode(self, text, **kw):
            calls.append(text)
            return self.inner.encode(text, **kw)

        def encode_batch_fast(self, texts, **kw):
            calls.extend(texts)
            return self.inner.encode_batch_fast(texts, **kw)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    rng = random.Random(11)
    words = {"".join(rng.choice("aeinrsté") for _ in range(9)) for _ in range(3000)}
    text = ", ".join(sorted(words))
    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    tokenfiles._table.cache_clear()
    ids, _ = tokenfiles.encode_batch([text, text], tokenfiles.vocabulary_path())
    tokenfiles._table.cache_clear()
    assert ids.tolist() == real.from_file(tokenfiles.vocabulary_path()).encode(text, add_special_tokens=False).ids * 2
    assert len(calls) < len(words) / 16


def test_tokenize_in_groups_of_texts(spark, monkeypatch):
    rows = list(enumerate(TEXTS)) + [(100 + k, f"number {k} of Ünits, " * (k % 7)) for k in range(90)]
    for size in (1, 300, 1 << 24):
        monkeypatch.setattr(tokenfiles, "TOGETHER_BYTES", size)
        found = tokenfiles.tokenize(frame(spark, rows).coalesce(1)).collect()
        assert {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in found} == {d: direct(t) + [2] for d, t in rows}


def test_token_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", 700)
    rows = list(enumerate(TEXTS, 5)) + [(3, "again"), (3, "again"), (None, "no id"), (-7, "first")]
    rows += [(100 + k, f"number {k} " * (k % 9)) for k in range(200)]
    found = tokenfiles.token_index(frame(spark, rows), str(tmp_path / "f")).collect()
    assert len(found) == len(rows)
    found = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    want = {d: direct(t) + [2] for d, t in rows}
    start = 0
    for r in found:
        ids = np.array(want[r.doc_id], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    back = tokenfiles.read(spark, str(tmp_path / "f")).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in back} == want


def test_token_index_of_nothing(spark):
    assert tokenfiles.token_index(frame(spark, [])).collect() == []


@given(st.lists(st.integers(0, 400), max_size=3000), st.sampled_from([8, 9, 16]))
@settings(max_examples=40, deadline=None)
def test_huffman_round_trip(values, limit):
    ids = np.array(values, np.int32)
    counts = np.bincount(ids, minlength=500)
    lengths = huffman.code_lengths(counts, limit)
    used = np.flatnonzero(counts)
    assert all(lengths[used] > 0) and lengths.max(initial=0) <= max(limit, int(max(len(used) - 1, 0)).bit_length())
    assert len(used) < 2 or sum(2.0 ** -int(n) for n in lengths[used]) == 1
    code, cut = huffman.codes(lengths), len(ids) // 3
    blocks = []
    for part in (ids[:cut], ids[cut:]):
        data, marks = huffman.encode(part, lengths, code)
        blocks.append((data, marks, len(part)))
    assert np.array_equal(huffman.Decoder(lengths)(blocks), ids)


def test_huffman_lengths_are_best():
    """Without a binding limit the size is that of the usual algorithm."""
    import heapq

    rng = random.Random(4)
    for _ in range(20):
        counts = np.array([rng.randrange(1, 10 ** rng.randrange(1, 4)) for _ in range(rng.randrange(2, 60))])
        heap, cost = sorted(map(int, counts)), 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        assert int((huffman.code_lengths(counts, 24) * counts).sum()) == cost


def plain(known, word):
    """The best sum of scores over all segmentations, by an unshared search."""
    best = [0.0] + [None] * len(word)
    for end in range(1, len(word) + 1):
        best[end] = best[end - 1] + known.unknown
        for start in range(end):
            found = known.endings.get(word[start:end])
            if found is not None:
                best[end] = max(best[end], best[start] + found[0])
    return best[-1]


def test_pieces_are_a_best_segmentation():
    known = pieces.Pieces(pieces.vocabulary_path())
    rng = random.Random(6)
    words = [" " * rng.randrange(0, 3) + "".join(rng.choice("aeinrst thé漢ß▁") for _ in range(rng.randrange(1, 12))).replace(" ", "") for _ in range(600)]
    words = sorted({w for w in words if w})
    rng.shuffle(words)
    score = {i: s for s, i in (v for v in known.endings.values() if v)}
    for word, ids in zip(words, known.segment(words)):
        total, run = 0.0, b""
        for i in ids:
            if i in score:
                total += score[i]
            else:
                run += known.bytes_of[i]
        total += known.unknown * len(run.decode())
        assert abs(total - plain(known, word)) < 1e-6 * (1 + abs(total)), word
        assert b"".join(known.bytes_of[i] for i in ids).decode() == word


def test_pieces_round_trip(spark):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (1, "again")]
    found = pieces.pieces(frame(spark, rows)).collect()
    assert len(found) == len(rows) and all(r.exact for r in found)
    for r in found:
        assert r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert {r.doc_id: r.n_pieces for r in found}[0] == 0
    texts = pieces.decode(pieces.encode(frame(spark, rows[:13]))).collect()
    assert {r.doc_id: r.text for r in texts} == {d: t or "" for d, t in rows[:13]}
    assert pieces.pieces(frame(spark, [])).collect() == []


@pytest.mark.parametrize("limit", [0, 3, 10**6])
def test_unit_table_starts_anew(limit):
    from ledgerloom.llm.units import UnitTable

    table = UnitTable(lambda words: [np.array([len(w), 7] if w else [], "<i4").tobytes() for w in words], limit)
    for _ in range(3):
        ids, counts = table(["a", "", "bbb", "a"])
        assert ids.tolist() == [1, 7, 3, 7, 1, 7] and counts.tolist() == [2, 0, 2, 2]

"""Spelling variants: words one code point apart, found by bitsets over (position, letter).

The vocabulary is counted by Spark. Two words one edit apart share the first half of the shorter
one's length, or else all behind it, so each word goes to the groups of its two halves, as a word of
its own length and as one that is a code point longer than its partner. Groups are dealt into
buckets of bounded size; a group too large for one is dealt into blocks that all meet each other.

In a bucket the words of both lengths are the columns of bit vectors, one vector for each position
and letter. A word of the shorter length runs through them letter by letter: one vector holds the
words equal so far, one those with one letter replaced, one those with one letter inserted, whose
positions are shifted by one. All words of a bucket run at once. The first kind of group lets errors
start behind the shared half only, the second drops words with the same first half, so that a pair
is found once. Deletions are the same pairs seen from the longer word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

LEAST_LENGTH, LEAST_COUNT, FACTOR, TYPO = 7, 2, 10, 31
#: Entries of a bucket, entries of a group above which it is dealt into blocks, 64-bit words of a bit matrix at once.
BUCKET, GROUP, TILE = 16384, 8192, 1 << 17

RUN = r"[A-Za-zÀ-ÿ]"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """word and n, the number of its occurrences over all texts.

    Words are the maximal runs of letters, A-Z lower-cased. Where ``typo`` divides the crc32 of
    ``<doc_id>:<run>``, the run loses the code point that the crc32 names (0: never).
    """
    runs = F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))
    found = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.transform(runs, _lower)).alias("run"),
    )
    word = F.col("run")
    if typo:
        h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(h % typo == 0, cut).otherwise(word)
    counts = found.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _bits(codes: np.ndarray, letters: int) -> np.ndarray:
    """(position, letter, 64-bit word): the columns that have the letter there; code 0 is no letter."""
    n, length = codes.shape
    out = np.zeros((length, letters, -(-n // 64) * 8), np.uint8)
    for p in range(length):
        has = codes[:, p][None, :] == np.arange(letters, dtype=codes.dtype)[:, None]
        has[0] = False
        out[p, :, : -(-n // 8)] = np.packbits(has, axis=1, bitorder="little")
    return out.view(np.uint64)


def _columns(mask: np.ndarray) -> np.ndarray:
    packed = np.packbits(mask, bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


def near_pairs(codes: np.ndarray, lengths: np.ndarray, asks: np.ndarray, held: np.ndarray, m: int, tail: bool):
    """Places of pairs (word of length ``m`` that asks, held word of length m or m + 1) one edit apart.

    ``codes`` has a letter number for each position, 0 behind the end. Without ``tail`` the two
    share the first m // 2 letters; with it they don't.
    """
    asking, mine = np.flatnonzero(asks & (lengths == m)), np.flatnonzero(held)
    if not len(asking) or not len(mine):
        return
    half = m // 2
    index = _bits(codes[mine, : m + 1], int(codes.max()) + 1)
    same, longer = _columns(lengths[mine] == m), _columns(lengths[mine] == m + 1)
    size = index.shape[2]
    step = max(1, TILE // size)
    for first in range(0, len(asking), step):
        word = codes[asking[first : first + step]]
        exact = np.broadcast_to(same | longer, (len(word), size)).copy()
        replaced, inserted = np.zeros_like(exact), np.zeros_like(exact)
        shared = None
        for i in range(m):
            if i == half:
                shared = exact.copy()
            here = index[i][word[:, i]]
            if tail or i >= half:
                inserted |= exact
                inserted &= index[i + 1][word[:, i]]
                replaced &= here
                replaced |= exact & ~here
            exact &= here
        inserted |= exact
        found = (replaced & same) | (inserted & longer)
        if tail:
            found &= ~shared
        rows, words = np.nonzero(found)
        if len(rows):
            flags = np.unpackbits(found[rows, words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, bit = np.nonzero(flags)
            yield asking[first + rows[at]], mine[words[at] * 64 + bit]


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A letter number for each position of each word, 0 behind its end, and the words' lengths."""
    texts = words.to_pylist()
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    _, numbers = np.unique(points, return_inverse=True)
    rows = np.repeat(np.arange(len(texts)), lengths)
    codes = np.zeros((len(texts), int(lengths.max(initial=0)) + 1), np.int32)
    codes[rows, np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = numbers.ravel() + 1
    return codes, lengths


def _search(table: pa.Table) -> pa.Table:
    """For each word of the bucket with near words: their number, the largest n, and the first word that has it."""
    table = table.combine_chunks()
    words = table["word"].chunk(0) if table.num_rows else pa.array([], pa.string())
    n = table["n"].to_numpy()
    kinds = np.stack([table[c].to_numpy().astype(np.int64) for c in ("m", "tail", "cell")])
    asks, held = table["asks"].to_numpy().astype(bool), table["held"].to_numpy().astype(bool)
    out = []
    order = np.lexsort(kinds)
    cuts = np.flatnonzero((kinds[:, order[1:]] != kinds[:, order[:-1]]).any(0)) + 1
    for part in np.split(order, cuts):
        m, tail, _ = kinds[:, part[0]]
        codes, lengths = _letters(words.take(pa.array(part)))
        for a, b in near_pairs(codes, lengths, asks[part], held[part], int(m), bool(tail)):
            out.append(np.stack([part[a], part[b]]))
            longer = lengths[b] > m  # a pair of equal length is found from both sides
            out.append(np.stack([part[b[longer]], part[a[longer]]]))
    word, near = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    # The same word has places for each of its entries: count by text, partners by n, then by text.
    texts = np.array(words.to_pylist(), object)
    ranks = np.argsort(np.argsort(texts, kind="stable"), kind="stable") if len(word) else word
    order = np.lexsort([ranks[near], -n[near], word])
    word, near = word[order], near[order]
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    return pa.table({
        "word": pa.array(texts[word[starts]], pa.string()), "near": np.diff([*starts, len(word)]).astype(np.int64),
        "most": n[near[starts]], "form": pa.array(texts[near[starts]], pa.string()),
    })


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, the largest n among near words, and the first word that has it; only words with near ones."""
    entries = words.select(
        "word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m"), F.length("word").alias("length")
    ).withColumn("tail", F.explode(F.array(F.lit(False), F.lit(True))))
    half = F.floor(F.col("m") / 2).cast("int")
    # Behind the first half, or one further where the first half has the inserted letter.
    behind = F.substring("word", F.col("length") - (F.col("m") - half) + 1, F.col("length"))
    part = F.when(F.col("tail"), behind).otherwise(F.substring("word", F.lit(1), half))
    entries = entries.withColumn("key", F.xxhash64("tail", "m", part)).drop("length")
    # A group without a word of length m has no pairs; large ones are dealt into blocks.
    groups = entries.groupBy("key").agg(F.count("*").alias("size"), F.min(F.length("word") - F.col("m")).alias("least"))
    groups = groups.where("size > 1 and least = 0").select("key", F.ceil(F.col("size") / GROUP).cast("int").alias("blocks"))
    dealt = stored(entries.join(groups, "key"), "variants-entries")
    whole = dealt.where("blocks = 1").select("*", F.lit(True).alias("asks"), F.lit(True).alias("held"), F.lit(0).cast("long").alias("cell"))
    large = dealt.where("blocks > 1").withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    asking = large.select("*", every).select(
        *dealt.columns, F.lit(True).alias("asks"), F.lit(False).alias("held"), F.xxhash64("key", "own", "other").alias("cell")
    )
    holding = large.select("*", every).select(
        *dealt.columns, F.lit(False).alias("asks"), F.lit(True).alias("held"), F.xxhash64("key", "other", "own").alias("cell")
    )
    cells = whole.unionByName(asking).unionByName(holding)
    buckets = max(1, -(-dealt.count() // BUCKET))
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("key", "cell"), F.lit(buckets)).cast("int"))
    found = cells.select("bucket", "word", "n", "m", "tail", "cell", "asks", "held").groupBy("bucket")
    found = found.applyInArrow(lambda table: _search(table), "word string, near long, most long, form string")
    best = F.min(F.struct((-F.col("most")).alias("less"), F.col("form").alias("form"))).alias("best")
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.less")).alias("most"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the last word reached by following ``forms`` (word, form) from word.

    A round sends each word on to what its own target points at, so a chain of k forms takes about
    log2(k) rounds; as n grows at least ``FACTOR`` times with each form, k is at most 18.
    """
    reached = stored(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = reached.join(ahead, "root")
        if moved.isEmpty():
            return reached
        reached = stored(
            reached.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variants-roots"
        )


def variants(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    factor: int = FACTOR,
    typo: int = TYPO,
) -> DataFrame:
    """Each word of the vocabulary with the word it is a rare spelling of.

    Reads doc_id and text. Words are near if one code point inserted, deleted or replaced turns one
    into the other. A word's form is its near word of largest n (ties: smallest by code points), if
    that is at least ``factor`` times its own n; its root is the end of the chain of forms. Null or
    empty texts have no words, a null doc_id reads as empty text, repeated rows count as often as
    they come. Without words there are no rows. ``factor`` must be above 1, so that chains end; a
    vocabulary word must have at least two code points. Other columns are not read.
    """
    if factor <= 1 or least_length < 2:
        raise ValueError("factor must be above 1 and least_length at least 2")
    words = stored(vocabulary(docs.select("doc_id", F.col("text").cast("string").alias("text")), least_length, least_count, typo), "variants-words")
    near = stored(words.join(near_words(words), "word"), "variants-near")
    forms = near.where(F.col("most") >= factor * F.col("n")).select("word", "form", F.col("most").alias("form_n"))
    forms = stored(forms, "variants-forms")
    out = words.join(near.select("word", "n_near"), "word", "left").join(forms, "word", "left").join(roots(forms), "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )

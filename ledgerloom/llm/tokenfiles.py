"""Token-id files: byte-level BPE ids in canonical Huffman code, written in doc_id order and read back.

A file is a Parquet folder of independent blocks, each with the ids of consecutive documents, and
next to it the code lengths, which come from the counts of all ids over all documents. A block
closes at the first document end after ``BLOCK_IDS`` ids.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import huffman
from .common import bounded_batches, ordered, scratch_path, stored
from .units import PACKED, UnitTable, take_slices

END = 2
BLOCK_IDS = 1 << 16
#: Blocks are decoded together up to about so many ids.
_TOGETHER = 1 << 20
#: Texts are encoded together up to about so many bytes: each distinct word of them once.
TOGETHER_BYTES = 1 << 22
#: Ids of so many units are put together at once.
_SLICES = 1 << 17

#: White space as the tokenizer's pattern has it (Unicode's White_Space).
_WIDE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = f"\t-\r {_WIDE}"
#: Letters and marks of which the pattern's classes are certain.
_LETTER, _MARK = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r"!-&(-/:-@\[-`{-~"
#: Where the pattern can't reach over: words with the one space in front of them, and runs of white space.
_UNITS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Inside a unit: whole runs of letters or of marks with an ASCII character behind them, else all that is left.
_PARTS = re.compile(rf" ?+[{_LETTER}]++(?![^\x00-\x7f])| ?+[{_MARK}]++(?![^\x00-\x7f]|')|\n(?=[{_LETTER}{_MARK}])|(?s:.)+")
#: A part that the pattern takes as one.
_ONE = re.compile(rf" ?[{_LETTER}]+| ?[{_MARK}]+|\n")
#: White space that isn't one blank or line break between two other characters, and the character that marks a unit.
_ODD = rf"[{_SPACE}][{_SPACE}]|[\t\x0b-\r{_WIDE}]|\x00|\A[ \n]|[ \n]\z"
_MARKED = "\0"
#: A unit of letters and marks alone; the kinds of its bytes (letters 1, marks 2, the line break 4).
_SIMPLE = rf"\A[\x00\n]?[{_LETTER}{_MARK}]*\z"
_KINDS = np.array([4 if b == 10 else 1 if b > 127 or chr(b).isalpha() else 2 if re.match(f"[{_MARK}]", chr(b)) else 0 for b in range(256)], np.uint8)
#: Bytes behind a part and behind a unit, how many units go to the library as one, and how many such texts at once.
_PART_END, _UNIT_END, _JOINED, _CALL = 0, 1, 32, 256


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct units of texts that aren't odd, the place among them of each unit in turn, and how many
    units each text has.

    A word stands for itself behind a blank, one that begins with a line break or a mark (left out) for
    itself alone.
    """
    texts = pc.binary_join_element_wise(pa.scalar(_MARKED, texts.type), texts, pa.scalar("", texts.type))
    texts = pc.replace_substring(texts, "\n", " \n")
    words = pc.split_pattern(texts, " ")
    del texts
    coded = words.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), words.value_lengths().to_numpy()


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


#: Parts whose ids are remembered besides those of whole units.
KNOWN_PARTS = 120_000


def _separable(model: dict, letters: list[str]) -> bool:
    """Whether the model merges what stands between such letters as if it stood alone."""
    if any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return False
    merged = set(chain.from_iterable(chain.from_iterable(model["merges"])))
    return all(c in model["vocab"] and c not in merged for c in letters)


def _joined(words: pa.Array) -> np.ndarray:
    """The bytes of simple units, with a blank in front where one belongs, and of the ends of parts and units."""
    if not len(words):
        return np.zeros(0, np.uint8)
    behind = pa.scalar(chr(_UNIT_END), words.type)
    raw = pc.binary_join_element_wise(pa.scalar(" ", words.type), words, behind, pa.scalar("", words.type))
    first, last = raw.offset, raw.offset + len(raw)
    at = np.frombuffer(raw.buffers()[1], np.int64)
    raw = np.frombuffer(raw.buffers()[2], np.uint8)[at[first] : at[last]]
    alone = (raw == 0) | (raw == 10)
    raw = raw[~(np.append(alone[1:], False) & (raw == 32)) & (raw != 0)]
    kinds = _KINDS[raw]
    return np.insert(raw, np.flatnonzero((kinds[:-1] | kinds[1:] == 3) | (kinds[:-1] == 4)) + 1, _PART_END)


@lru_cache(maxsize=2)
def _table(path: str) -> tuple[Callable | None, UnitTable, list[str], Callable[[str], list[int]]]:
    """One tokenizer and table for a worker process, however many tasks it runs: the ids of simple units and
    their counts (None if the model doesn't allow for it), the table of other units, the strings of added
    tokens, and the ids of a whole text, as which the library takes a text that holds one of them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("token files hold ids of 16 bits")
    merge, letters, known = tokenizer.model.tokenize, _byte_letters(), {}

    def ids_of(part: str) -> bytes:
        """Packed ids; a part that the pattern takes as one goes to the library's merges at once."""
        if _ONE.fullmatch(part):
            if part.isascii():
                part = part.replace(" ", letters[32]).replace("\n", letters[10])
            else:
                part = part.encode().decode("latin-1").translate(letters)
            return array("i", [t.id for t in merge(part)]).tobytes()
        return array("i", tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def encode(new: list[str]):
        for unit in new:
            parts = _PARTS.findall(unit[1:] if unit[0] == _MARKED else unit if unit[0] == "\n" else " " + unit)
            found = b""
            for part in parts:
                ids = known.get(part)
                if ids is None:
                    if len(known) >= KNOWN_PARTS:
                        known.clear()
                    ids = known[part] = ids_of(part)
                found += ids
            yield found

    ends = [letters[_PART_END], letters[_UNIT_END]]
    part_end, unit_end = map(tokenizer.model.token_to_id, ends)
    codes = np.array([ord(letters[b]) for b in range(256)], "<u2")
    # The same model with nothing around it.
    merges = Tokenizer(tokenizer.model)

    def simple(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = _joined(words)
        cuts = np.flatnonzero(raw == _UNIT_END)[_JOINED - 1 :: _JOINED] + 1
        texts = [t.tobytes().decode("utf-16-le") for t in np.split(codes[raw], cuts)]
        # What the library returns takes much more memory than ids.
        calls = (merges.encode_batch_fast(texts[k : k + _CALL], add_special_tokens=False) for k in range(0, len(texts), _CALL))
        ids = np.fromiter(chain.from_iterable(e.ids for call in calls for e in call), PACKED)
        kept = (ids != part_end) & (ids != unit_end)
        return ids[kept], np.diff(np.cumsum(kept)[ids == unit_end], prepend=0)

    with open(path, encoding="utf-8") as file:
        joins = _separable(json.load(file)["model"], ends)

    def whole(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return simple if joins else None, UnitTable(encode, 800_000), added, whole


def encode_batch(texts: pa.Array | list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in order, and the offsets of each text's ids."""
    simple, table, added, whole = _table(path)
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
    texts = texts.fill_null("")
    special = np.zeros(len(texts), bool)
    for token in added:
        special |= np.asarray(pc.match_substring(texts, token))
    odd = np.asarray(pc.match_substring_regex(texts, _ODD)) & ~special
    words, places, sizes = units(texts.filter(pa.array(~odd & ~special)))
    others = [[_MARKED + u for u in _UNITS.findall(t)] for t in texts.filter(pa.array(odd)).to_pylist()]

    # Distinct units, and behind them all of the odd texts: counts and starts of ids.
    n = sum(map(len, others))
    easy = np.zeros(len(words) + n, bool)
    flat, counts = np.zeros(0, np.int32), np.zeros(len(easy), np.int64)
    if simple and len(words):
        easy[: len(words)] = np.asarray(pc.match_substring_regex(words, _SIMPLE))
        flat, counts[easy] = simple(words.filter(pa.array(easy[: len(words)])))
    hard = words.filter(pa.array(~easy[: len(words)])).to_numpy(zero_copy_only=False).tolist() + list(chain.from_iterable(others))
    more, counts[~easy] = table(hard)
    starts = np.zeros(len(easy), np.int64)
    starts[easy] = np.cumsum(counts[easy]) - counts[easy]
    starts[~easy] = len(flat) + np.cumsum(counts[~easy]) - counts[~easy]
    flat = np.concatenate([flat, more])
    places = np.concatenate([places, np.arange(len(words), len(easy))])
    sizes = np.concatenate([sizes, np.array([len(o) for o in others], np.int64)])

    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts[places])])[np.cumsum([0, *sizes])]
    cuts = (places[k : k + _SLICES] for k in range(0, len(places), _SLICES))
    ids = np.concatenate([flat[:0], *(take_slices(flat, starts[p], counts[p]) for p in cuts)])
    if not (odd | special).any():
        return ids, offsets
    parts = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    parts += [np.array(whole(t), np.int32) for t in texts.filter(pa.array(special)).to_pylist()]
    # From plain, odd and special texts back to the order of the texts.
    order = np.argsort(np.argsort(odd + 2 * special, kind="stable"))
    parts = [parts[k] for k in order]
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def tokenize(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and ids (little-endian, 16 bits) of each whole text and the end id."""
    bounded_batches(docs.sparkSession)
    path = path or vocabulary_path()

    def coded(held):
        texts = pa.chunked_array([b.column(1).cast(pa.large_string()) for b in held]).combine_chunks()
        ids, offsets = encode_batch(texts, path)
        at = 0
        for batch in held:
            ends = offsets[at : at + len(batch) + 1]
            at += len(batch)
            rows = [np.append(ids[a:b], end) for a, b in zip(ends[:-1], ends[1:])]
            columns = [batch.column(0), pa.array([len(r) for r in rows], pa.int64())]
            columns.append(pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()))
            columns.append(pa.array([r.astype("<u2").tobytes() for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "ids"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= TOGETHER_BYTES:
                yield from coded(held)
                held, size = [], 0
        if held:
            yield from coded(held)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, ids binary")


def _counts(batches):
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for ids in batch.column(0):
            total += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])


_BLOCK = "first long, docs binary, sizes binary, n_ids long, marks binary, payload binary"


def write(rows: DataFrame, folder: str) -> None:
    """Write ``rows`` (doc_id, n_tokens, ids_crc32, ids) as a token file, by ascending doc_id.

    Null ids of documents come first; repeated ids of documents are ordered by length and check
    sum. The counts that the driver gets have at most 2**16 rows.
    """
    spark = rows.sparkSession
    found = rows.select("ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    lengths = huffman.code_lengths(counts)
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").write.parquet(f"{folder}/codes")
    code = huffman.codes(lengths)

    def blocks(batches):
        docs, parts, held = [], [], 0

        def close():
            ids = np.concatenate(parts)
            payload, marks = huffman.encode(ids, lengths, code)
            known = [0 if d is None else d for d in docs]
            sizes = np.array([len(p) for p in parts], "<u4")
            flags = np.array([d is None for d in docs], np.uint8)
            cells = [known[0], np.array(known, "<i8").tobytes() + flags.tobytes(), sizes.tobytes(), len(ids), marks.astype("<u4").tobytes(), payload]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            names = ["first", "docs", "sizes", "n_ids", "marks", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(doc)
                parts.append(np.frombuffer(ids.as_buffer(), "<u2"))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield close()
                    docs, parts, held = [], [], 0
        if docs:
            yield close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32")
    dealt.select("doc_id", "ids").mapInArrow(blocks, _BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids (little-endian, 32 bits) of each document of a token file."""
    bounded_batches(spark)
    # One row of 2**16 bytes.
    lengths = np.frombuffer(spark.read.parquet(f"{folder}/codes").first()[0], np.uint8)

    def run(batches):
        decoder = huffman.Decoder(lengths)

        def decoded(rows):
            ids = decoder([(r[4], np.frombuffer(r[3], "<u4"), r[2]) for r in rows]).astype("<u4")
            docs, parts, at = [], [], 0
            for known, sizes, *_ in rows:
                sizes = np.frombuffer(sizes, "<u4")
                n = len(sizes)
                docs += [None if f else d for d, f in zip(np.frombuffer(known, "<i8", n).tolist(), known[8 * n :])]
                for size in sizes.tolist():
                    parts.append(ids[at : at + size].tobytes())
                    at += size
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(parts, pa.binary())], ["doc_id", "ids"])

        for batch in batches:
            held, n = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                n += row[2]
                if n >= _TOGETHER:
                    yield decoded(held)
                    held, n = [], 0
            if held:
                yield decoded(held)

    blocks = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks")
    return blocks.select("docs", "sizes", "n_ids", "marks", "payload").mapInArrow(run, "doc_id long, ids binary")


def token_index(docs: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32 of each document, from the file.

    A null text is empty (its ids are the end id alone), a null doc_id sorts first, repeated rows
    are documents of their own. An empty table writes an empty file.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    write(stored(tokenize(docs, path), "token-ids"), folder)

    def sums(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            columns = [batch.column(0), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32"])

    found = read(spark, folder).mapInArrow(sums, "doc_id long, n_tokens long, ids_crc32 long")
    keys = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("ids_crc32")]
    # Stored, as dealing out ranges reads its input twice.
    return ordered(stored(found, "token-rows"), keys, {"start": "n_tokens"}).select("doc_id", "start", "n_tokens", "ids_crc32")

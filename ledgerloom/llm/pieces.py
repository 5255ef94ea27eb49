"""SentencePiece encoding and decoding: a Viterbi search shared by words with a common prefix.

A text is marked as the model does it: a space in front, and every space written as the mark.
No piece holds the mark behind another character or a line break, so the best segmentation of a
text is that of its marked words one by one. The distinct words of a batch are sorted, which is
the depth-first order of their trie; walking it, the forward scores of the prefix that a word
shares with the one before are kept and only the rest is searched.

The segmentation has the largest sum of piece scores (with equal sums, the longer last piece).
The model's file is one for merges, whose library replays merges instead; here its pieces and
scores serve as a unigram model. Characters without a piece are written as bytes, so is a literal
mark, and decoding gives every text back exactly.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches
from .units import UnitTable, take_slices

MARK = "▁"
#: A marked word, spaces alone, or one line break.
_UNITS = re.compile(r" *[^ \n]+| +|\n")


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The pieces of a model file, ready for search and decoding."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        #: By text with spaces for marks: (score, id) of a piece, None for a mere ending of one.
        self.endings: dict[str, tuple[float, int] | None] = {}
        lowest = 0.0
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace(MARK, " ")
                if re.search(r"[^ ] |\n", text):
                    raise ValueError(f"piece {piece!r} reaches over words")
                self.bytes_of.append(text.encode())
                score = model.get_score(i)
                lowest = min(lowest, score)
                self.endings[text] = (score, i)
                for k in range(1, len(text)):
                    self.endings.setdefault(text[k:], None)
        #: As in the library, a character without a piece costs ten more than the worst piece.
        self.unknown = lowest - 10
        lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.flat, self.lengths = np.frombuffer(b"".join(self.bytes_of), np.uint8), lengths
        self.starts = np.cumsum(lengths) - lengths

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the distinct ``words``, found in sorted order."""
        out: list[list[int]] = [[]] * len(words)
        endings, unknown = self.endings, self.unknown
        best, back, last = [0.0], [(0, -1)], ""
        for n in sorted(range(len(words)), key=words.__getitem__):
            word = words[n]
            shared = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, link = best[end - 1] + unknown, (end - 1, -1)
                start = end - 1
                while start >= 0:
                    found = endings.get(word[start:end], 0)
                    if found == 0:
                        break
                    if found is not None and best[start] + found[0] >= top:
                        top, link = best[start] + found[0], (start, found[1])
                    start -= 1
                best.append(top)
                back.append(link)
            last, at, ids = word, len(word), []
            while at:
                start, piece = back[at]
                if piece < 0:
                    ids.extend(self.byte_ids[b] for b in reversed(word[start:at].encode()))
                else:
                    ids.append(piece)
                at = start
            ids.reverse()
            out[n] = ids
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that marking put in front."""
        raw = take_slices(self.flat, self.starts[ids], self.lengths[ids]).tobytes()
        return raw[1:].decode("utf-8", "surrogatepass") if raw[:1] == b" " else raw.decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def _tools(path: str) -> tuple[Pieces, UnitTable]:
    """One vocabulary and table for a worker process, however many tasks it runs."""
    pieces = Pieces(path)
    return pieces, UnitTable(lambda words: [array("i", ids).tobytes() for ids in pieces.segment(words)], 250_000)


def units(text: str) -> list[str]:
    """The marked words of a text, spaces standing for marks; none for an empty text."""
    return _UNITS.findall(" " + text) if text else []


def encode_batch(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in order, and the offsets of each text's ids."""
    _, table = _tools(path)
    words, ends = [], [0]
    for text in texts:
        words += units(text)
        ends.append(len(words))
    ids, counts = table(words)
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    return ids, sums[ends]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each row's whole ``text``; a null or empty text has no ids."""
    bounded_batches(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches):
        for batch in batches:
            ids, offsets = encode_batch([t or "" for t in batch.column(1).to_pylist()], path)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids read as none."""
    bounded_batches(rows.sparkSession)
    path = path or vocabulary_path()

    def run(batches):
        pieces, _ = _tools(path)
        for batch in batches:
            texts = [pieces.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each row encoded and decoded again.

    Returns doc_id, n_pieces, ids, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers) and exact (decoding gave the text, null as empty). Repeated rows give repeated
    results, a null doc_id stays null, other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches):
        known, _ = _tools(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, offsets = encode_batch(texts, path)
            crcs, exact = [], []
            plain = ids.astype("<u4")
            for k, text in enumerate(texts):
                crcs.append(zlib.crc32(plain[offsets[k] : offsets[k + 1]].tobytes()))
                exact.append(known.decode(ids[offsets[k] : offsets[k + 1]]) == text)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            columns = [batch.column(0), pa.array(np.diff(offsets)), lists, pa.array(crcs, pa.int64()), pa.array(exact)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids", "ids_crc32", "exact"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_pieces long, ids array<int>, ids_crc32 long, exact boolean"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)

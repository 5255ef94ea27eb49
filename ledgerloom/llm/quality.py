"""Quality classifier: averaged hashed word and character n-gram vectors, softmax, SGD in numpy.

Training sees labelled rows only, at most about ``sample`` of them (a documented bound, dealt
evenly over the two labels by a hash of doc_id). It runs in one task and returns one row. As the
text vector is a plain average, the score needs just one number per table position, the vector's
share in the difference of the two outputs; that table (``4 * 2**bits`` bytes, 1 MB) is all that
is broadcast, whatever the input's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import bounded_batches, fresh
from .subwords import families, slice_sums
from .words import text_blocks

#: Table positions (as a power of two), vector length, passes, step size, most labelled rows read.
BITS, DIM, EPOCHS, RATE, SAMPLE = 18, 8, 6, 0.5, 3000


def _examples(texts: pa.Array, bits: int):
    """For each row the distinct positions of its features and their weights, which add up to 1.

    Words, word pairs and n-grams of each length weigh the same, whatever their number; position 0
    is in every text and weighs as much.
    """
    for _, data, offsets in text_blocks(texts):
        kinds = list(families(data, offsets, bits, pairs=True))
        for r in range(len(offsets) - 1):
            mine = [p[b[r] : e[r]] for p, b, e in kinds if e[r] > b[r]]
            parts = [np.zeros(1, np.int32), *mine]
            weights = np.concatenate([np.full(len(p), 1 / len(p) / len(parts)) for p in parts])
            at, back = np.unique(np.concatenate(parts), return_inverse=True)
            yield at, np.bincount(back, weights).astype(np.float32)


def fit(texts: pa.Array, labels: np.ndarray, bits: int = BITS, seed: int = 11) -> np.ndarray:
    """The table of score shares; label 1 has a positive margin. All zeros without both labels."""
    examples = list(_examples(texts, bits))
    if not len(labels) or labels.min() == labels.max():
        return np.zeros(1 << bits, np.float32)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << bits, DIM)).astype(np.float32)
    output = np.zeros((2, DIM), np.float32)
    steps, step = EPOCHS * len(labels), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(labels)):
            rate = RATE * (1 - step / steps)
            step += 1
            at, weight = examples[k]
            hidden = weight @ vectors[at]
            score = output @ hidden
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = output.T @ p
            output -= rate * np.outer(p, hidden).astype(np.float32)
            # An average over many features has a small gradient in each; the step grows with the root of their number.
            vectors[at] -= np.outer(rate * len(at) ** 0.5 * weight, back).astype(np.float32)
    return vectors @ (output[1] - output[0])


def train(labelled: DataFrame, bits: int = BITS, sample: int = SAMPLE) -> np.ndarray:
    """Fit on ``labelled`` (doc_id, text, label 0 or 1): at most about ``sample`` rows, half of each label."""
    bounded_batches(labelled.sparkSession)

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
            texts, labels = rows["text"].combine_chunks(), rows["label"].to_numpy().astype(np.int64)
            if isinstance(texts, pa.ChunkedArray):
                texts = pa.concat_arrays(texts.chunks)
            yield pa.RecordBatch.from_arrays([pa.array([fit(texts, labels, bits).tobytes()], pa.binary())], ["table"])

    row = labelled.repartition(1).mapInArrow(run, "table binary").collect()
    return np.frombuffer(row[0][0], np.float32) if row else np.zeros(1 << bits, np.float32)


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Texts and labels of rows with crc32(doc_id as text) mod 3 other than 1, evenly over the labels.

    ``labels`` has doc_id and quality; null ids or labels other than 0 and 1 are left out, a
    repeated id counts once with its smallest label.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    size = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20))
    share = F.lit(0.0)
    for label, count in size.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, sample / 2 / count))).otherwise(share)
    picked = known.where(draw < share * (1 << 20)).select(F.col("doc_id").alias("_id"), "label")
    # At most about `sample` rows of two numbers: a bounded side.
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "label")


def margins(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Difference of the two outputs for each text of a column; null reads as empty."""
    bits, out = len(table).bit_length() - 1, np.zeros(len(texts))
    for first, data, offsets in text_blocks(texts):
        total = np.full(len(offsets) - 1, float(table[0]))
        count = np.ones(len(offsets) - 1)
        for at, begin, end in families(data, offsets, bits, pairs=True):
            size = end - begin
            total += slice_sums(table[at], begin, end) / np.maximum(size, 1)
            count += size > 0
        out[first : first + len(total)] = total / count
    return out


def score(docs: DataFrame, table: np.ndarray, column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of its ``text``; all rows and columns stay, nothing is shuffled.

    Null and empty texts have the score of the one feature that every text has. A column of the
    same name is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(table)
    rest = [c for c in docs.columns if c.lower() != column.lower()]
    docs = docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches):
        for batch in batches:
            text = batch.column(rest.index("text"))
            value = 1 / (1 + np.exp(-np.clip(margins(text, shared.value), -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*rest, column])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; learned from ``known`` or ``docs`` itself."""
    table = train(labelled_rows(known if known is not None else docs, labels))
    scored = score(docs.select("doc_id", "text"), table).drop("text")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, known: DataFrame, floor: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``floor``."""
    table, name = train(labelled_rows(known, labels)), fresh(docs, "_quality")
    return score(docs, table, name).where(F.col(name) >= floor).drop(name)

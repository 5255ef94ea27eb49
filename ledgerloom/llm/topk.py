"""Exact inner-product search, term at a time, over cells of queries and candidates.

Candidates and queries are dealt by a hash into blocks of about ``CANDIDATES`` and ``QUERIES``
rows; each pair of blocks is one group, whose size doesn't depend on the input's. Inside, the
candidates become postings by dimension. Each dimension of a bundle of sparse query rows scatters
its weighted postings into dense score arrays; partition selection takes the best of the block,
and the blocks' lists are merged for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

K, EVERY, SCALE = 20, 20, 64
CANDIDATES, QUERIES = 16384, 2048
#: Query rows scored together, and candidates whose score array is filled at once.
BUNDLE, STRIP = 64, 1024


def _sparse(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, dimension and whole-number weight of the entries other than 0; saturates at 64 bits."""
    values = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    weights = np.clip(values, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    lengths = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(lists)), lengths)
    dims = np.arange(len(weights)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    used = weights != 0
    return rows[used], dims[used], weights[used]


def _strips(rows, dims, weights, size):
    """For each strip of candidates its postings: dimension, places in the strip, weights."""
    order = np.lexsort((rows, dims, rows // STRIP))
    rows, dims, weights = rows[order], dims[order], weights[order]
    edges = np.flatnonzero(np.diff(rows // STRIP) | np.diff(dims)) + 1
    starts = np.concatenate([[0], edges]) if len(rows) else np.zeros(0, np.int64)
    strips = [[] for _ in range(-(-size // STRIP))]
    for a, b in zip(starts, [*starts[1:], len(rows)]):
        strip = rows[a] // STRIP
        strips[strip].append((int(dims[a]), rows[a:b] - strip * STRIP, weights[a:b]))
    return strips


def search(query_ids, queries: pa.Array, ids, candidates: pa.Array, k: int):
    """For each query (place, candidate id, score) of its ``k`` best candidates of another id."""
    order = np.argsort(ids, kind="stable")  # so that, of equal scores, the earlier place has the smaller id
    ids, candidates = ids[order], candidates.take(pa.array(order))
    rows, dims, weights = _sparse(candidates)
    q_rows, q_dims, q_weights = _sparse(queries)
    largest = [int(np.abs(w).max(initial=0)) for w in (weights, q_weights)]
    width = int(max(dims.max(initial=0), q_dims.max(initial=0))) + 1
    kind = np.int32 if 0 <= largest[0] * largest[1] * width < 2**31 and min(largest) >= 0 else np.int64
    strips = _strips(rows, dims, weights.astype(kind), len(ids))
    for first in range(0, len(query_ids), BUNDLE):
        size = min(BUNDLE, len(query_ids) - first)
        mine = (q_rows >= first) & (q_rows < first + size)
        terms = np.zeros((width, size), kind)
        terms[q_dims[mine], q_rows[mine] - first] = q_weights[mine]
        scores = np.zeros((len(ids), size), kind)
        for s, postings in enumerate(strips):
            strip = scores[s * STRIP : (s + 1) * STRIP]
            for dim, places, weight in postings:
                if len(places) == len(strip):  # every candidate has the dimension: the places are all in order
                    strip += weight[:, None] * terms[dim]
                else:
                    strip[places] += weight[:, None] * terms[dim]
        for q in range(size):
            score = scores[:, q].astype(np.int64)
            places = np.flatnonzero(ids != query_ids[first + q])
            if len(places) > k:
                held = score[places]
                least = np.partition(held, len(held) - k)[len(held) - k]
                places = places[held >= least]
            places = places[np.argsort(-score[places], kind="stable")][:k]
            yield first + q, ids[places], score[places]


def _cell(k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table["is_query"].to_numpy(zero_copy_only=False).astype(bool)
        ids, marks = table["vec_id"].to_numpy(), table["mark"].to_numpy()
        lists = table["embedding"].chunk(0)
        pick = lambda m: lists.take(pa.array(np.flatnonzero(m)))
        out = [np.zeros(0, np.int64) for _ in range(4)]
        if asks.any() and not asks.all():
            found = list(search(ids[asks], pick(asks), ids[~asks], pick(~asks), k))
            counts = [len(x[1]) for x in found]
            out = [np.repeat(ids[asks], counts), np.repeat(marks[asks], counts)]
            out += [np.concatenate([x[n] for x in found]) for n in (1, 2)]
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "mark", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The ``k`` best candidates of each row of ``vectors`` whose vec_id is divisible by ``every``.

    Vectors become floor(64 x); a shorter one has zeros where it ends. Rows with a null vec_id, a
    null vector or a null, NaN or infinite component take no part; an empty vector scores 0.
    Candidates are all rows with another vec_id, repeated rows as often as they come; a query
    repeated with the same vector counts once. Sums are 64-bit and wrap beyond.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where("vec_id is not null and embedding is not null").where(finite)
    asked = F.col("vec_id") % every == 0
    n, nq = rows.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    blocks, bundles = max(1, -(-n // CANDIDATES)), max(1, -(-nq // QUERIES))
    mark = F.xxhash64("embedding")
    here = rows.select(
        "vec_id", "embedding", F.lit(False).alias("is_query"), mark.alias("mark"),
        F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"),
    )
    asks = rows.where(asked).dropDuplicates(["vec_id", "embedding"]).select(
        "vec_id", "embedding", F.lit(True).alias("is_query"), mark.alias("mark"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("embedding", "vec_id"), F.lit(bundles)).cast("int").alias("bundle"),
    )
    cells = here.unionByName(asks).groupBy("block", "bundle")
    best = cells.applyInArrow(_cell(k), "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

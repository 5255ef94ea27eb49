"""Hard negatives by slots: exact windows below each positive, over cells of anchors and candidates.

Two rounds over blocks of candidates and bundles of anchors, whose sizes don't depend on the input's.
The first finds each anchor's best rows of its own label, the positives. Their scores are the upper
limits of windows that overlap; sorted, they cut the scores into disjoint slots. The second round
keeps, for each anchor and slot, the best rows of other labels: a block's lists are merged by slot.
As every score of a slot is above those of the next one, the best rows below a limit are a fold of
the slots from the lowest up, each list going before what was merged so far; one fold answers all
windows of an anchor, and the lower limit only cuts the end of an answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

EVERY, SHIFT, SCALE, POSITIVES, NEGATIVES, SHARE = 100, 7, 256, 5, 5, 80
#: Rows of a block of candidates and of a bundle of anchors; scores held at once.
CANDIDATES, ANCHORS, TILE = 8192, 8192, 1 << 20


def _whole(lists: pa.Array, width: int, scale: int) -> np.ndarray:
    """A row of ``width`` whole numbers for each list, zeros where it has ended."""
    values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    lengths = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(lists)), lengths)
    out = np.zeros((len(lists), width), np.int64)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.clip(values, -(2.0**63), 2.0**63 - 1024)
    return out


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """The quickest type that holds every inner product of the two sides exactly."""
    most = max(1, a.shape[1]) * float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def _first(keys: list[np.ndarray], groups: int, k: int) -> np.ndarray:
    """Places of the first ``k`` rows of each group; the last ``groups`` of ``keys`` (as in lexsort) name the group."""
    order = np.lexsort(keys)
    if not len(order):
        return order
    new = np.zeros(len(order), bool)
    new[0] = True
    for key in keys[-groups:]:
        new[1:] |= key[order][1:] != key[order][:-1]
    starts = np.flatnonzero(new)
    return order[np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)])) < k]


class _Cell:
    """The anchors and candidates of one group, candidates in order of vec_id."""

    def __init__(self, table: pa.Table, scale: int):
        table = table.combine_chunks()
        asks = table["is_anchor"].to_numpy().astype(bool)
        ids = table["vec_id"].to_numpy()
        self.a = np.flatnonzero(asks)
        c = np.flatnonzero(~asks)
        c = c[np.argsort(ids[c], kind="stable")]
        lists = table["embedding"].chunk(0) if table.num_rows else pa.array([], pa.list_(pa.float64()))
        width = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
        self.vectors = _whole(lists.take(pa.array(self.a)), width, scale)
        self.others = _whole(lists.take(pa.array(c)), width, scale)
        kind = _kind(self.vectors, self.others)
        self.vectors, self.others = self.vectors.astype(kind), self.others.astype(kind)
        labels = table["label"].to_numpy()
        self.ids, self.marks, self.labels = ids[self.a], table["mark"].to_numpy()[self.a], labels[self.a]
        self.other_ids, self.other_labels = ids[c], labels[c]
        self.table = table

    def tiles(self, a: np.ndarray, c: np.ndarray):
        """Scores of ``a`` against ``c``, a bounded number at once."""
        wide = max(1, min(len(c), 2048))
        high = max(1, TILE // wide)
        for i in range(0, len(a), high):
            for j in range(0, len(c), wide):
                x, y = a[i : i + high], c[j : j + wide]
                yield x, y, self.vectors[x] @ self.others[y].T


def _positives(k: int, scale: int):
    def run(table: pa.Table) -> pa.Table:
        cell = _Cell(table, scale)
        found = [np.zeros((3, 0), np.int64)]
        for label in np.unique(cell.labels):
            for a, c, score in cell.tiles(np.flatnonzero(cell.labels == label), np.flatnonzero(cell.other_labels == label)):
                allowed = cell.other_ids[c][None, :] != cell.ids[a][:, None]
                if len(c) > k + 1:  # own rows are the only ones not allowed; rows below the k best allowed can go
                    masked = np.where(allowed, score, np.iinfo(np.int64).min if score.dtype == np.int64 else -np.inf)
                    allowed &= score >= np.partition(masked, len(c) - k, axis=1)[:, len(c) - k, None]
                x, y = np.nonzero(allowed)
                found.append(np.array([a[x], cell.other_ids[c][y], score[x, y].astype(np.int64)], np.int64))
            part = np.concatenate(found, axis=1)
            found = [part[:, _first([part[1], -part[2], part[0]], 1, k)]]
        a, ids, scores = found[0] if len(found) == 1 else np.concatenate(found, axis=1)
        return pa.table({"anchor_id": cell.ids[a], "mark": cell.marks[a], "positive_id": ids, "positive_score": scores})

    return run


def _slots(k: int, scale: int):
    def run(table: pa.Table) -> pa.Table:
        cell = _Cell(table, scale)
        limits = cell.table["limits"].take(pa.array(cell.a)).to_pylist()
        most = max(map(len, limits), default=0)
        upper = np.full((len(limits), most), np.iinfo(np.int64).min)
        for r, row in enumerate(limits):
            upper[r, : len(row)] = row
        low = cell.table["low"].take(pa.array(cell.a)).to_numpy()
        held, parts, size = np.zeros((4, 0), np.int64), [], 0
        for a, c, score in cell.tiles(np.arange(len(cell.ids)), np.arange(len(cell.other_ids))):
            inside = (score >= low[a][:, None]) & (score <= upper[a, :1]) & (cell.labels[a][:, None] != cell.other_labels[c][None, :])
            x, y = np.nonzero(inside)
            value = score[x, y].astype(np.int64)
            slot = (upper[a[x]] >= value[:, None]).sum(1) - 1
            parts.append(np.array([a[x], slot, value, cell.other_ids[c][y]], np.int64))
            size += len(x)
            if size > TILE:
                parts, size = [held, *parts], 0
                held = np.concatenate(parts, axis=1)
                held, parts = held[:, _first([held[3], -held[2], held[1], held[0]], 2, k)], []
        held = np.concatenate([held, *parts], axis=1)
        a, slot, value, ids = held[:, _first([held[3], -held[2], held[1], held[0]], 2, k)]
        return pa.table({"anchor_id": cell.ids[a], "mark": cell.marks[a], "slot": slot, "score": value, "negative_id": ids})

    return run


def _cells(rows: DataFrame, anchors: DataFrame, blocks: int, bundles: int):
    """Each candidate once for each bundle of anchors, each anchor once for each block of candidates."""
    here = rows.select(
        "*", F.lit(False).alias("is_anchor"),
        F.pmod(F.xxhash64("vec_id", "mark"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"),
    )
    asks = anchors.select(
        "*", F.lit(True).alias("is_anchor"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("mark", "vec_id"), F.lit(bundles)).cast("int").alias("bundle"),
    )
    return here.unionByName(asks, allowMissingColumns=True).groupBy("block", "bundle")


def hard_negatives(
    vectors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    every: int = EVERY,
    shift: int = SHIFT,
    share: int = SHARE,
    scale: int = SCALE,
) -> DataFrame:
    """For each anchor and positive the first ``negatives`` rows of other labels within the positive's window.

    Reads vec_id, embedding and label. Anchors are rows whose vec_id is divisible by ``every``;
    where ``shift`` divides vec_id the label is (label + 1) % 10 first (0: never). A window reaches
    from ``share`` percent of the positive's score up to that score, so that a negative score has
    none. Rows with a null id, label, vector or a null or non-finite component take no part; a
    shorter vector has zeros where it ends, an empty one scores 0. An anchor repeated with the same
    label and vector counts once, other rows as often as they come; a row is never its own positive.
    Equal scores go by smaller vec_id. Without anchors, or rows of a second label, there are no rows.
    Scores are 64-bit and wrap beyond; other columns are not read.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    embedding = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding"), F.col("label").cast("long").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where("vec_id is not null and embedding is not null and label is not null").where(finite)
    if shift:
        rows = rows.withColumn("label", F.when(F.col("vec_id") % shift == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = rows.withColumn("mark", F.xxhash64("label", "embedding"))
    asked = F.col("vec_id") % every == 0
    n, na = rows.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    blocks, bundles = max(1, -(-n // CANDIDATES)), max(1, -(-na // ANCHORS))
    anchors = rows.where(asked).dropDuplicates(["vec_id", "label", "embedding"])
    key = ["anchor_id", "mark"]

    near = _cells(rows, anchors, blocks, bundles).applyInArrow(
        _positives(positives, scale), "anchor_id long, mark long, positive_id long, positive_score long"
    )
    order = Window.partitionBy(*key).orderBy(F.col("positive_score").desc(), "positive_id")
    near = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= positives).drop("_n")
    near = near.withColumn("low", F.ceil(F.col("positive_score").cast("decimal(20,0)") * share / 100).cast("long"))
    near = stored(near.where("low <= positive_score"), "negatives-positives")

    # At most `positives` limits an anchor.
    limits = near.groupBy(*key).agg(F.sort_array(F.collect_set("positive_score"), False).alias("limits"), F.min("low").alias("low"))
    limited = anchors.join(limits.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "mark"])
    slots = _cells(rows, limited, blocks, bundles).applyInArrow(
        _slots(negatives, scale), "anchor_id long, mark long, slot long, score long, negative_id long"
    )
    best = Window.partitionBy(*key, "slot").orderBy(F.col("score").desc(), "negative_id")
    slots = slots.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= negatives)
    # At most `positives` times `negatives` entries an anchor.
    lists = slots.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("slot", "_n", "score", "negative_id"))).alias("held"))
    lists = lists.join(limits.select(*key, "limits"), key)

    def before(merged, slot):
        mine = F.filter("held", lambda x: x["slot"] == slot)
        below = F.coalesce(F.try_element_at(merged, F.lit(1)), F.filter("held", lambda x: F.lit(False)))
        return F.concat(F.array(F.slice(F.concat(mine, below), 1, negatives)), merged)

    nothing = F.filter(F.array(F.col("held")), lambda x: F.lit(False))
    windows = F.aggregate(F.sequence(F.size("limits") - 1, F.lit(0), F.lit(-1)), nothing, before)
    answered = near.join(lists.select(*key, "limits", windows.alias("windows")), key)
    mine = F.element_at("windows", F.array_position("limits", F.col("positive_score")).cast("int"))
    kept = F.filter(mine, lambda x: x["score"] >= F.col("low"))
    out = answered.select("anchor_id", "positive_id", "positive_score", F.posexplode(kept).alias("rank", "x"))
    return out.select(
        "anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"),
        F.col("x.negative_id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"),
    )


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""

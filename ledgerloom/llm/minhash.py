"""Near-duplicate groups: universal hash minima, banding, verification, connected components.

A document's set holds its distinct shingles of five words. Documents whose sets are equal form a
class, kept as its smallest id. A class representative gets ``BANDS * ROWS`` minima of
multiply-shift hashes; representatives that agree on all minima of a band share a bucket. Two
rounds test the pairs of a bucket without listing them all:

1. a star: each bucket's centre (the member whose buckets hold most documents) against the others;
2. only buckets whose members still lie in several components: pairs across components, in cells
   of about ``CELL`` by ``CELL`` members, so that a large bucket is spread over many groups. A cell
   gives one link for each two components that it joins, not one for each pair.

A pair is first compared by one byte of each minimum, then confirmed on the full sets. The
components of the confirmed links come from alternating large-star and small-star steps.

At a similarity of 0.85 a pair misses all 32 bands of 6 minima with probability 3e-7 (at 0.8 with
6e-5), and the byte comparison loses it with less than 1e-8 (six standard deviations); nothing else
is dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, checkpointed, fresh, stored
from .components import components
from .words import SPACE, byte_codes, chain_hashes, mix, span_hashes, spans, text_blocks

BANDS, ROWS, WIDTH = 32, 6, 5
MINIMA = BANDS * ROWS
#: Members of one side of a cell.
CELL = 512
#: Shingles hashed at once, so that a long text needs no more memory than a short one.
_STEP = 2048

_FACTORS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) + np.uint64(1 << 40))
_CODES = byte_codes(lower=True)


def shingle_sets(column: pa.Array):
    """For each row of a text column, the sorted distinct 64-bit hashes of its shingles."""
    for _, data, offsets in text_blocks(column):
        starts, ends, first = spans(~SPACE[data], offsets)
        hashes = span_hashes(data, starts, ends, _CODES)
        chains = chain_hashes(hashes, WIDTH)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= WIDTH:
                yield np.unique(chains[a : b - WIDTH + 1])
            elif b > a:
                yield chain_hashes(hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash (a * x + b) >> 32 over a set that is not empty."""
    low = np.full(MINIMA, (1 << 32) - 1, np.uint64)
    for k in range(0, len(shingles), _STEP):
        values = _FACTORS[:, None] * shingles[None, k : k + _STEP]
        values += _SHIFTS[:, None]
        low = np.minimum(low, values.min(axis=1) >> np.uint64(32))
    return low


def _band_keys(low: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[r::ROWS])
    return keys.view(np.int64)


_SKETCH = "doc_id long, n_shingles long, d0 long, d1 long, bands array<long>, bytes binary"


def _sketch(batches):
    for batch in batches:
        ids, n, d0, d1, bands, low8 = batch.column(0), [], [], [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            if not len(s):
                d0.append(None), d1.append(None), bands.append(None), low8.append(None)
                continue
            a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            low = minima(s)
            d0.append(int(a)), d1.append(int(b)), bands.append(_band_keys(low))
            low8.append(low.astype(np.uint8).tobytes())
        columns = [ids, pa.array(n, pa.int64()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64())]
        columns += [pa.array(bands, pa.list_(pa.int64())), pa.array(low8, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "d0", "d1", "bands", "bytes"])


def sketches(docs: DataFrame) -> DataFrame:
    """One row per document: set size, 128-bit digest of the set, band keys, a byte per minimum."""
    bounded_batches(docs.sparkSession)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(_sketch, _SKETCH)


def least_bytes(percent: int) -> int:
    """Equal bytes below which a pair of the wanted similarity is ruled out, six deviations down."""
    j = percent / 100
    p = j + (1 - j) / 256
    return int(MINIMA * p - 6 * (MINIMA * p * (1 - p)) ** 0.5)


def _compare(percent: int):
    floor = least_bytes(percent)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, MINIMA) for k in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= floor)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(keep)

    return run


def _sets(batches):
    for batch in batches:
        packed = [s.tobytes() for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "shingles"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity; the places of one in the other give the intersection."""
    if not len(x) or not len(y):
        return False
    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            sets = ((np.frombuffer(x, np.uint64) for x in pair) for pair in zip(*(batch.column(c).to_pylist() for c in (2, 3))))
            keep = pa.array([similar(x, y, percent) for x, y in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(keep)

    return run


def _groups(batches, keys: int):
    """Rows that follow each other with the same first ``keys`` columns, as (key, columns)."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != at:
                if held:
                    yield at, list(zip(*held))
                at, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield at, list(zip(*held))


def _likely(cell, percent: int, same):
    """Places (k, others) of members of a cell that may be linked: rows are those of ``_CELL``.

    A pair counts in the first band that it shares only. ``same`` tells of the places of a member
    and of others whether they are known to lie in one component.
    """
    ids, _, n, low8, bands, band, side = cell[:7]
    ids, n, bands, side = (np.array(c, np.int64) for c in (ids, n, bands, side))
    low8 = np.frombuffer(b"".join(low8), np.uint8).reshape(-1, MINIMA)
    floor, band = least_bytes(percent), band[0]
    for k in np.flatnonzero(side != 1):
        # Side 0 meets side 1; within one block (side 2) each pair comes once.
        others = np.flatnonzero(side == 1) if side[k] == 0 else np.flatnonzero((side == 2) & (ids > ids[k]))
        others = others[100 * np.minimum(n[others], n[k]) >= percent * np.maximum(n[others], n[k])]
        others = others[~same(k, others)]
        others = others[~(bands[others, :band] == bands[k, :band]).any(axis=1)]
        yield k, others[(low8[others] == low8[k]).sum(axis=1) >= floor]


_CELL = ["rep", "component", "n_shingles", "bytes", "bands", "band", "side"]


def _involved(percent: int):
    """The members of each cell that may be linked to a member of another component."""

    def run(batches):
        for key, cell in _groups(batches, 3):
            component = np.array(cell[1], np.int64)
            found = np.zeros(len(component), bool)
            for k, others in _likely(cell, percent, lambda k, o: component[o] == component[k]):
                if len(others):
                    found[k] = found[others] = True
            at = np.flatnonzero(found)
            columns = [pa.array([x] * len(at), t) for x, t in zip(key, (pa.int64(), pa.int32(), pa.int32()))]
            columns += [pa.array([cell[0][k] for k in at], pa.int64()), pa.array([cell[6][k] for k in at], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "i", "j", "rep", "side"])

    return run


def _forest(percent: int):
    """Links between components of a cell by the full sets; one for each that the cell joins, not each pair."""

    def run(batches):
        for _, cell in _groups(batches, 3):
            sets = [np.frombuffer(x, np.uint64) for x in cell[7]]
            _, group = np.unique(np.array(cell[1], np.int64), return_inverse=True)
            links = []
            for k, others in _likely(cell, percent, lambda k, o: group[o] == group[k]):
                for o in others:
                    if group[o] != group[k] and similar(sets[k], sets[o], percent):
                        links.append((cell[0][k], cell[0][o]))
                        group[group == group[o]] = group[k]
            columns = [pa.array([f(x) for x in links], pa.int64()) for f in (min, max)]
            yield pa.RecordBatch.from_arrays(columns, ["u", "v"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Groups of documents linked by ``100 * |A & B| >= percent * |A | B|``.

    Reads ``doc_id`` and ``text`` of ``docs``; returns doc_id, n_shingles, component_id (smallest
    id reachable) and kept (doc_id = component_id).

    Null or wordless texts have an empty set, are linked with nothing and kept. A null doc_id
    names no document: its row has component_id null, is linked with nothing and kept. Repeated
    rows of one id and text are one document with as many result rows. Other columns are not read.
    """
    floor = percent / 100
    sketch = stored(sketches(docs), "minhash-sketch")
    full = sketch.where("doc_id is not null and n_shingles > 0")
    classes = full.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"))
    reps = full.join(classes, ["d0", "d1"]).where("doc_id = rep")
    reps = stored(reps.select("rep", "n_shingles", "bands", "bytes").dropDuplicates(["rep"]), "minhash-classes")

    slots = reps.select(F.posexplode("bands").alias("band", "key"), "rep")
    shared = slots.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = checkpointed(slots.join(shared, "key"))
    reach = members.groupBy("rep").agg(F.sum("size").alias("reach"))
    ranked = members.join(reach, "rep")
    centres = ranked.groupBy("key").agg(F.max(F.struct("reach", (-F.col("rep")).alias("rep"))).alias("top"))
    star = members.join(centres.select("key", (-F.col("top.rep")).alias("centre")), "key").where("rep <> centre")
    star = star.select(F.least("rep", "centre").alias("u"), F.greatest("rep", "centre").alias("v")).distinct()

    sized = reps.select("rep", "n_shingles", "bytes")

    def likely(pairs: DataFrame) -> DataFrame:
        left = sized.select(F.col("rep").alias("u"), F.col("n_shingles").alias("nu"), F.col("bytes").alias("bu"))
        right = sized.select(F.col("rep").alias("v"), F.col("n_shingles").alias("nv"), F.col("bytes").alias("bv"))
        both = pairs.join(left, "u").join(right, "v")
        both = both.where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
        return both.select("u", "v", "bu", "bv").mapInArrow(_compare(percent), "u long, v long")

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def full_sets(ids: DataFrame) -> DataFrame:
        """Sets of the ids in question, built anew from their texts."""
        chosen = texts.join(ids.distinct(), "id", "left_semi").dropDuplicates(["id"])
        return stored(chosen.mapInArrow(_sets, "id long, shingles binary"), "minhash-sets")

    near = checkpointed(likely(star))
    sets = full_sets(near.select(F.col("u").alias("id")).union(near.select("v")))
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
    both = near.join(left, "u").join(right, "v").select("u", "v", "su", "sv")
    links = checkpointed(both.mapInArrow(_confirm(percent), "u long, v long"))
    joined = checkpointed(components(links))

    placed = members.join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    split = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    open_ = placed.join(split.select("key"), "key")
    blocks = F.ceil(F.col("size") / CELL).cast("int")
    open_ = open_.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A member is in the cell of its own block, and once with each other block, as the left or the right side.
    celled = open_.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("b") == F.col("o"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1)
    celled = celled.select(
        "key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "rep", "component", "band", side.alias("side")
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts = reps.select("rep", "n_shingles", "bytes", "bands")

    def dealt(rows: DataFrame, *more: str) -> DataFrame:
        rows = rows.select("key", "i", "j", *_CELL, *more).repartition(n, "key", "i", "j")
        return rows.sortWithinPartitions("key", "i", "j")

    involved = dealt(celled.join(facts, "rep")).mapInArrow(_involved(percent), "key long, i int, j int, rep long, side int")
    involved = checkpointed(involved)
    sets = full_sets(involved.select(F.col("rep").alias("id"))).withColumnRenamed("id", "rep")
    placed = placed.select("key", "rep", "component", "band")
    ready = involved.join(placed, ["key", "rep"]).join(facts, "rep").join(sets, "rep")
    more = checkpointed(dealt(ready, "shingles").mapInArrow(_forest(percent), "u long, v long"))
    stars = joined.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))
    final = components(stars.unionByName(more)).withColumnRenamed("id", "rep")

    grouped = sketch.select("doc_id", "n_shingles", "d0", "d1").join(classes, ["d0", "d1"], "left")
    grouped = grouped.join(final, "rep", "left")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    grouped = grouped.select("doc_id", "n_shingles", group.alias("component_id"))
    return grouped.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns, whose document stands for its group."""
    name = fresh(docs, "_gone")
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM (SELECT DISTINCT doc_id FROM w) w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id WHERE r.c < e.v)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept
FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n
"""

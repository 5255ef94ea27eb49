"""Document fingerprints from spot signatures.

A spot is a common word (an anchor) and the chain of the next ``CHAIN`` content words behind it,
which are the words that are not anchors. A text's fingerprint is its set of distinct spots, as
32-bit hashes, with the number of its length partition in front: partitions are geometric, so that
sets of a similarity of ``LIKE`` or more lie in the same or in neighbouring ones. Chrome around a
text, such as menus, has few common words and so leaves few spots.

Two sets are compared by the Jaccard similarity, pruned: sets whose lengths already rule the wanted
similarity out are not read, and a merge that can't reach it any more stops.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded_batches, stored
from .components import components
from .words import byte_codes, mix, span_hashes, spans, text_blocks

CHAIN, LIKE = 3, 0.8

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by can do for from had has have he her his if in is it its not of on or she that the their "
    "there they this to was we were which will with would you "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im ist mit nach nicht "
    "noch nur oder sein sich sie sind so um und vom von vor war werden wie wird zu zum zur über "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur mais ne nous ont ou où par pas plus pour qui "
    "que sa se ses son sont sur un une vous à "
    "al como con del el ella ellos entre era esta este fue ha hasta las lo los más me mi muy no para pero por porque si sin "
    "sobre son su sus también tiene una uno y ya"
).split()

_CODES = byte_codes(lower=True, seed=5)
_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _hashes(words) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = spans(_INSIDE[data], np.array([0, len(data)]))
    return span_hashes(data, starts, ends, _CODES)


_ANCHOR_HASHES = np.unique(_hashes(ANCHORS))


def spot_sets(column: pa.Array, chain: int = CHAIN):
    """For each row of a text column, the sorted distinct 32-bit hashes of its spots.

    The text's beginning is an anchor as well, so a text with a content word has a spot. A chain
    at the end of a text is as long as what is left. A text without content words has one spot, the
    hash of its anchors in order or, without words, of its bytes; the empty text has none.
    """
    for _, data, offsets in text_blocks(column):
        starts, ends, first = spans(_INSIDE[data], offsets)
        hashes = span_hashes(data, starts, ends, _CODES)
        place = np.searchsorted(_ANCHOR_HASHES, hashes)
        anchor = _ANCHOR_HASHES[np.minimum(place, len(_ANCHOR_HASHES) - 1)] == hashes
        content = np.flatnonzero(~anchor)
        held = hashes[content]
        for r, (a, b) in enumerate(zip(first[:-1], first[1:])):
            lo, hi = np.searchsorted(content, (a, b))
            if lo == hi:
                raw = hashes[a:b].tobytes() or data[offsets[r] : offsets[r + 1]].tobytes()
                yield np.frombuffer(hashlib.blake2b(raw, digest_size=4).digest(), "<u4") if raw else np.zeros(0, "<u4")
                continue
            at = a + np.flatnonzero(anchor[a:b])
            to = np.concatenate([[lo], np.searchsorted(content, at)])
            total = mix(np.concatenate([[np.uint64(1)], hashes[at]]))
            total, to = total[to < hi], to[to < hi]
            for k in range(chain):
                more = to + k < hi
                total[more] = mix(total[more] * np.uint64(0x9E3779B97F4A7C15) + held[to[more] + k])
            yield np.unique((total >> np.uint64(32)).astype("<u4"))


def partition(size: int, like: float = LIKE) -> int:
    """Number of the length partition of a set; sets similar by ``like`` are at most one apart."""
    return int(math.log(size) / -math.log(like)) + 1 if size else 0


def fingerprint(spots: np.ndarray) -> str:
    """Partition and the spots in order, eight hexadecimal digits each."""
    return f"{partition(len(spots))}:{spots.astype('>u4').tobytes().hex()}"


def likeness(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 if it is below ``least``. Two empty sets are equal.

    With a least similarity, lengths that rule it out end the comparison at once, and so does a
    first part of the merge that has missed too many spots.
    """
    if not len(x) and not len(y):
        return 1.0
    if len(x) > len(y):
        x, y = y, x
    if least and (len(x) < least * len(y) or partition(len(y), least) - partition(len(x), least) > 1):
        return 0.0
    need = least / (1 + least) * (len(x) + len(y))
    common = done = 0
    step = max(64, len(x)) if not least else 64
    while done < len(x):
        part = x[done : done + step]
        place = np.minimum(np.searchsorted(y, part), max(len(y) - 1, 0))
        common += int((y[place] == part).sum())
        done += len(part)
        if common + len(x) - done < need - 1e-9:
            return 0.0
    value = common / (len(x) + len(y) - common)
    return value if value >= least else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_spots and fingerprint of each row's whole ``text``; null reads as empty."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            found = list(spot_sets(batch.column(1)))
            columns = [batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([fingerprint(s) for s in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_spots", "fingerprint"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_spots long, fingerprint string")


#: Ranges of doc_id for each shuffle partition, and the most there are, which bounds the plan's literals.
RANGES, MOST_RANGES = 4, 4096


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (range, tail, doc_id, text) dealt so that each document's partition holds the next one, too.

    Ranges of doc_id get a copy of the first row behind them (``tail`` 1); behind the last row comes
    the first. The driver gets one row for each range, ``MOST_RANGES`` at most; a task streams its
    ranges, however large they are.
    A null doc_id sorts first; rows of one doc_id by a hash of their text.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = min(RANGES * n, MOST_RANGES)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 25 * ranges)).first()[0]
    cuts = sorted(set(cuts or []))
    range_ = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(range_).cast("int"))
    least = rows.groupBy("range").agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("none")).collect()
    least = {r["range"]: None if r["none"] else r["id"] for r in least}
    order = sorted(least)
    before = {r: order[k - 1] for k, r in enumerate(order)}
    size = range(len(cuts) + 1)
    firsts = F.array(*[F.lit(least.get(r)).cast("long") for r in size])
    targets = F.array(*[F.lit(before.get(r)).cast("int") for r in size])
    first = F.col("doc_id").eqNullSafe(F.get(firsts, F.col("range")))
    copied = rows.withColumn("_to", F.when(first, F.get(targets, F.col("range"))))
    places = F.filter(
        F.array(
            F.struct(F.col("range").alias("range"), F.lit(0).alias("tail")), F.struct(F.col("_to").alias("range"), F.lit(1).alias("tail"))
        ),
        lambda p: p["range"].isNotNull(),
    )
    dealt = copied.select(F.explode(places).alias("p"), "doc_id", "text").select("p.range", "p.tail", "doc_id", "text")
    dealt = dealt.withColumn("h", F.xxhash64("text")).repartition(n, "range")
    return dealt.sortWithinPartitions("range", "tail", F.col("doc_id").asc_nulls_first(), "h").drop("h")


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike the text is to that and to the next.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null texts are empty; empty sets are alike. A single document is its own next one.
    """
    bounded_batches(docs.sparkSession)
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def done(rows, following):
        """Result rows of (doc_id, text, spots), each followed by the next; ``following`` comes after the last."""
        after = [*rows[1:], following]
        changed = [edited(r[1], a[1]) for r, a in zip(rows, after)]
        spots = list(spot_sets(pa.array(changed, pa.string())))
        columns = [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array([fingerprint(r[2]) for r in rows]),
            pa.array([fingerprint(s) for s in spots]),
            pa.array([likeness(r[2], s) for r, s in zip(rows, spots)]),
            pa.array([likeness(r[2], a[2]) for r, a in zip(rows, after)]),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    def run(batches):
        held, at, ended = [], None, False
        for batch in batches:
            texts = batch.column(3)
            spots = spot_sets(texts)
            for r, tail, doc, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), texts.to_pylist()):
                row = (doc, text, next(spots))
                if r != at:
                    held, at, ended = [], r, False
                if tail:
                    if not ended and held:
                        yield done(held, row)
                    held, ended = [], True
                    continue
                held.append(row)
                if len(held) > 64 and sum(len(x[1]) for x in held) > 1 << 20:
                    yield done(held[:-1], held[-1])
                    held = held[-1:]

    return with_next(docs).mapInArrow(run, schema)


#: Members of one side of a cell of sets that are compared.
CELL = 512


def _joined(like: float):
    """Links between the sets of a cell, whose rows come sorted; one for each two groups that it joins."""

    def links(cell):
        group = list(range(len(cell)))
        sets = [np.array(r[1], np.int64) for r in cell]
        for a, (x, _, side) in enumerate(cell):
            for b, (y, _, other) in enumerate(cell):
                # Side 0 meets side 1; within one block (side 2) each pair comes once.
                pair = other == 1 if side == 0 else side == 2 and a < b
                if pair and group[a] != group[b] and likeness(sets[a], sets[b], like):
                    yield min(x, y), max(x, y)
                    old = group[b]
                    group = [group[a] if g == old else g for g in group]

    def run(batches):
        at, cell, found = None, [], []

        def out():
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, ["u", "v"])

        for batch in batches:
            for *key, rep, spots, side in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    found += links(cell)
                    at, cell = key, []
                cell.append((rep, spots, side))
            yield out()
            found = []
        found += links(cell)
        yield out()

    return run


def near_copies(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of their spots of ``like`` or more.

    Returns doc_id, n_spots, component_id (smallest id reachable) and kept. Documents with equal
    sets form a class. Only classes of the same or neighbouring length partitions are compared, and
    only if they share a spot among the rarest of each set: so many that sets without a common one
    there can't be similar. Cells of ``CELL`` by ``CELL`` sets spread a frequent spot over tasks.

    Null texts are empty; texts without spots are linked with nothing; a row with a null doc_id
    has a null component and is kept.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = list(spot_sets(batch.column(1)))
            columns = [batch.column(0), pa.array([len(s) for s in found], pa.int32())]
            columns += [pa.array([partition(len(s), like) for s in found], pa.int32())]
            columns += [pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64()))]
            columns += [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_spots", "part", "spots", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    sets = stored(rows.mapInArrow(run, "doc_id long, n_spots int, part int, spots array<long>, digest binary"), "spot-sets")
    full = sets.where("doc_id is not null and n_spots > 0")
    classes = stored(full.groupBy("digest").agg(F.min("doc_id").alias("rep")), "spot-classes")
    reps = full.join(classes, "digest").where("doc_id = rep").dropDuplicates(["rep"])
    reps = stored(reps.select("rep", "n_spots", "part", "spots"), "spot-reps")

    spots = reps.select("rep", "n_spots", "part", F.explode("spots").alias("spot"))
    ranked = spots.join(spots.groupBy("spot").agg(F.count("*").alias("docs")), "spot")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("docs", "spot"))
    rare = ranked.withColumn("place", place).where(F.col("place") <= F.col("n_spots") - F.ceil(F.col("n_spots") * like - 1e-9) + 1)
    # The bucket b of a spot holds the partitions b and b + 1, so neighbours meet in one at least.
    slots = rare.where("docs > 1").select("rep", "spot", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("bucket"))
    shared = slots.groupBy("bucket", "spot").agg(F.count("*").alias("size")).where("size > 1")
    members = slots.join(shared, ["bucket", "spot"])
    blocks = F.ceil(F.col("size") / CELL).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("b") == F.col("o"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1)
    cells = members.select("bucket", "spot", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "rep", side.alias("side"))
    cells = cells.join(reps.select("rep", "spots"), "rep").select("bucket", "spot", "i", "j", "rep", "spots", "side")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["bucket", "spot", "i", "j"]
    links = cells.repartition(n, *keys).sortWithinPartitions(*keys, "rep").mapInArrow(_joined(like), "u long, v long")
    final = components(links).withColumnRenamed("id", "rep")
    grouped = sets.select("doc_id", "n_spots", "digest").join(classes, "digest", "left").join(final, "rep", "left")
    group = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_spots") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep")))
    grouped = grouped.select("doc_id", "n_spots", group.alias("component_id"))
    return grouped.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

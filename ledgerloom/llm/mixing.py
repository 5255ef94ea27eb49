"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents are shuffled by a hash and laid end to end; that stream of words, repeated
as often as needed, is cut into blocks of equal length. The schedule has a slot for each block the
mix takes. Slot i falls on the i-th point of the golden-ratio sequence (whole-number arithmetic
modulo 2**31) and goes to the source whose share of the cumulative targets holds the point; the
k-th slot of a source takes its k-th block. What the slots leave open or give too much, up to a
block or so for each source, is settled at the end of its stream, where a block is taken in part. A
document's words taken are its overlaps with what is taken of the blocks.

Nothing is ordered in one task: slots are ranked within runs of 2**16 and documents within
hash ranges of their source, each on top of sums over the earlier ones, so that a source with a
third of all documents is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, ordered, stored

#: Weights of the sources in turn, and how often a source may be repeated.
WEIGHTS, PASSES = (5, 2, 1), 3
#: Words of a block at most; small inputs get so many blocks at least.
BLOCK, LEAST_SLOTS = 4096, 1 << 16
#: An odd number next to 2**31 divided by the golden ratio.
STEP, SPAN, RUN = 1327217885, 1 << 31, 1 << 16
#: Documents of a hash range.
RANGE = 4096
#: Parts of the point range in which slots meet sources.
CELL_BITS = 19

WORDS = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """sid (rank of the source by code point, null last), source, source_size and target in words.

    The weights, repeated in rank order, share the sum of all sizes; a target above ``passes``
    times its source's size stops there and the rest is shared anew. That ends with a level L such
    that every target is the smaller of its cap and L times its weight; ordered by cap per weight,
    the capped sources come first.
    """
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ordered(stats.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"sid": "one"})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * passes)
    caps = caps.withColumn("ratio", F.col("cap") / F.col("weight"))
    caps = stored(ordered(caps, [F.col("ratio"), F.col("sid")], {"cap_before": "cap", "weight_before": "weight"}), "mix-targets")
    total, heavy = caps.agg(F.sum("source_size"), F.sum("weight")).first()  # one row
    total, heavy = total or 0, heavy or 1
    level = (F.lit(float(total)) - F.col("cap_before")) / (F.lit(float(heavy)) - F.col("weight_before"))
    open_ = caps.where(F.col("ratio") > level).agg(F.min_by("cap_before", "weight_before"), F.min("weight_before")).first()
    cap = F.col("cap").cast("double")
    if open_[1] is None:
        target = cap
    else:
        rest, left = float(total) - open_[0], float(heavy) - open_[1]
        target = F.when(F.col("weight_before") < open_[1], cap).otherwise(F.lit(rest) * F.col("weight") / F.lit(left))
    return caps.select("sid", "source", "source_size", target.alias("target"))


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """sid and k for each of ``slots`` slots: the k-th one of its source, from 0."""
    spark = shares.sparkSession
    parts = shares.withColumn("part", (F.col("target") * 16).cast("long"))
    whole = parts.agg(F.sum("part")).first()[0] or 1  # one row
    placed = ordered(parts, [F.col("sid")], {"before": "part"})
    edge = lambda c: F.floor(c.cast("double") / F.lit(float(whole)) * SPAN)
    placed = placed.select("sid", edge(F.col("before")).alias("lo"), edge(F.col("before") + F.col("part")).alias("hi")).where("hi > lo")
    cells = placed.withColumn(
        "cell", F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS)))
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    point = F.pmod((F.col("i") % SPAN) * STEP, F.lit(SPAN))
    points = spark.range(0, slots, 1, n).withColumnRenamed("id", "i").withColumn("point", point)
    points = points.withColumn("cell", F.shiftright("point", CELL_BITS))
    dealt = points.join(cells, "cell").where("point >= lo and point < hi")
    dealt = dealt.select("sid", "i", F.floor(F.col("i") / RUN).alias("run"))
    counts = dealt.groupBy("sid", "run").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("sid", "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "run").orderBy("i")
    ranked = dealt.withColumn("r", F.row_number().over(inside)).join(base, ["sid", "run"])
    return ranked.select("sid", (F.col("base") + F.col("r") - 1).alias("k"))


def streams(sizes: DataFrame, documents: int) -> DataFrame:
    """``sizes`` (doc_id, sid, size, ...) with ``start``, the words of the source's stream before the document.

    A source's hash ranges hold about ``RANGE`` of ``documents`` each, up to 2**16 ranges.
    """
    bits = min(16, max(0, (documents // RANGE).bit_length()))
    digest = F.md5(F.concat_ws(":", F.lit("mix"), F.col("doc_id").cast("string")))
    hashed = sizes.withColumn("_h", digest)
    hashed = hashed.withColumn("_range", F.shiftright(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"), 16 - bits))
    sums = hashed.groupBy("sid", "_range").agg(F.sum("size").alias("_n"))
    ahead = Window.partitionBy("sid").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("sid", "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("sid", "_range").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = hashed.withColumn("_local", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["sid", "_range"])
    return local.withColumn("start", F.col("_base") + F.col("_local")).drop("_h", "_range", "_base", "_local")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    passes: int = PASSES,
    block: int = BLOCK,
) -> DataFrame:
    """How many words of each document the mix takes.

    Reads doc_id, text and source; returns doc_id, source, size, source_size, target, taken. A
    null text has size 0; a null source is a source of its own, the last. Documents without words
    are taken 0 times. Repeated rows are documents of their own; equal ones may swap places. An
    empty table gives no rows. Other columns are not read. The words taken of a source are its
    target, rounded.
    """
    sizes = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size")
    )
    sizes = stored(sizes, "mix-sizes")
    shares = stored(targets(sizes, weights, passes), "mix-shares")
    total = shares.agg(F.sum("source_size")).first()[0] or 0  # one row
    block = max(1, min(block, total // LEAST_SLOTS))
    slots = stored(schedule(shares, -(-total // block)), "mix-slots")
    limits = slots.groupBy("sid").agg((F.count("*") * block).alias("limit"))
    sources = shares.join(limits, "sid", "left").withColumn("limit", F.coalesce("limit", F.lit(0)))
    sources = sources.withColumn("had", F.floor(F.col("limit") / block)).withColumn("limit", F.round("target").cast("long"))
    sources = stored(sources, "mix-settled")
    # Blocks behind those that have a slot: a few for a source, as the slots follow the targets closely.
    need = F.ceil(F.col("limit") / block)
    more = sources.where(need > F.col("had")).select("sid", F.explode(F.sequence("had", need - 1)).alias("k"))
    rest = F.col("limit") - F.col("k") * block
    held = slots.unionByName(more).join(sources.select("sid", "limit"), "sid").where(rest > 0)
    held = held.select("sid", "k", F.least(F.lit(block), rest).cast("long").alias("held"))
    sources = sources.drop("had")
    named = sizes.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    empty = named.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    placed = streams(named.where("size > 0"), sizes.count())
    last = F.least(F.lit(passes - 1), F.floor((F.col("limit") - 1 - F.col("start")) / F.col("source_size")))
    turns = F.when(F.col("limit") > F.col("start"), F.sequence(F.lit(0).cast("long"), last.cast("long")))
    keys = ["doc_id", "source", "sid", "size", "source_size", "target", "start"]
    taken = placed.select(*keys, F.explode_outer(turns).alias("turn"))
    taken = taken.withColumn("lo", F.col("start") + F.col("turn") * F.col("source_size"))
    cut = lambda c: F.floor(c / block).cast("long")
    taken = taken.select("*", F.explode_outer(F.sequence(cut(F.col("lo")), cut(F.col("lo") + F.col("size") - 1))).alias("k"))
    met = taken.join(held, ["sid", "k"], "left")
    overlap = F.least(F.col("lo") + F.col("size"), F.col("k") * block + F.col("held")) - F.greatest(F.col("lo"), F.col("k") * block)
    summed = met.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("held").isNotNull() & (overlap > 0), overlap)), F.lit(0)).alias("taken"))
    return summed.select("doc_id", "source", "size", "source_size", "target", "taken").unionByName(empty)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, as often as the mix takes them.

    Blocks take a prefix of a source's stream after its full rounds, so at most one document of a
    source is taken in part; it stays whole. Documents that the mix takes no word of go.
    """
    plan = mix(docs, weights, passes).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    doc, source, size, most, turn = (fresh(docs, c) for c in ("_id", "_source", "_size", "_times", "_turn"))
    plan = plan.groupBy(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("size").alias(size)).agg(F.max(times).alias(most))
    same = (
        F.col("doc_id").eqNullSafe(F.col(doc))
        & F.col("source").cast("string").eqNullSafe(F.col(source))
        & (words(F.col("text").cast("string")) == F.col(size))
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    turns = F.explode(F.sequence(F.lit(1), F.col(most)))
    return docs.join(plan, same).select(*columns, turns.alias(turn)).drop(turn)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
st AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
rk AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS sid FROM st),
cp AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM rk),
od AS (SELECT *, cap::DOUBLE / weight AS ratio,
    coalesce(sum(cap) OVER w, 0)::DOUBLE AS cb, coalesce(sum(weight) OVER w, 0)::DOUBLE AS wb
  FROM cp WINDOW w AS (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tot AS (SELECT sum(source_size)::DOUBLE AS t, sum(weight)::DOUBLE AS w FROM od),
op AS (SELECT arg_min(cb, wb) AS cb, min(wb) AS wb FROM od, tot WHERE ratio > (t - od.cb) / (w - od.wb)),
tg AS (SELECT sid, source, source_size,
    CASE WHEN op.wb IS NULL OR od.wb < op.wb THEN cap::DOUBLE ELSE (t - op.cb) * weight / (w - op.wb) END AS target
  FROM od, tot, op),
lm AS (SELECT *, round(target)::BIGINT AS lim FROM tg),
ps AS (SELECT d.doc_id, d.size, lm.*, coalesce(sum(d.size) OVER (PARTITION BY sid ORDER BY md5('mix:' || doc_id), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM d JOIN lm ON d.source IS NOT DISTINCT FROM lm.source)
SELECT doc_id, source, size, source_size, target,
  (greatest(0, least(size, lim - a)) + greatest(0, least(size, lim - a - source_size))
   + greatest(0, least(size, lim - a - 2 * source_size)))::BIGINT AS taken
FROM ps
"""

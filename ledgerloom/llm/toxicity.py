"""Toxic passages: token log-odds with Dirichlet priors, maximum-scoring segments, extreme-value calibration.

Counting. A word of the labelled texts counts once for each distinct word in front of it, separately
in toxic and in other texts, so that copies and shared passages, which repeat the same neighbours,
count once. The prior of a word is what the letters it begins with say (3, 4, 5, 6 code points, each
the prior of the next), down to the share of all words; rare and unseen forms get the log-odds of
their beginning. Only features that stand out by ``Z`` standard errors, and those that take back what
a beginning says, enter the table; any other word costs ``DRIFT``.

Scan. All maximal segments of positive score of a text are found in one linear pass that looks at the
toxic words only, as the words between two of them cost ``DRIFT`` each.

Calibration. Rows kept aside from the counting give the two constants of the extreme-value law of
segment scores in clean texts: the expected number of segments of score S or more in n words is
K n exp(-lambda S). A text's segments are summed up (the sum statistic of the r best, for the best r),
and a logistic curve turns the logarithm of that p-value into a probability.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import bounded_batches, fresh, stored
from .quality import held_out
from .words import byte_codes, span_hashes, spans, text_blocks

#: Lengths of beginnings; weight of a prior in occurrences; standard errors a feature must stand out by; cost of a word.
BEGINNINGS, PRIOR, Z, DRIFT = (3, 4, 5, 6), 10.0, 3.0, 0.25
#: Most labelled rows read for counting and for calibration (a quarter of them toxic at most), most features kept.
SAMPLE, ASIDE, FEATURES = 24000, 8000, 1 << 17
PREDICTED = 0.7

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_INSIDE = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _INSIDE[_low : _high + 1] = False
_INSIDE[65:91] = True  # lower-cased
_CODES = byte_codes(lower=True, seed=11)


@dataclass
class Model:
    """Feature hashes in order and their scores, a hash array for each kind (beginnings, whole words); calibration."""

    hashes: list[np.ndarray]
    scores: list[np.ndarray]
    scale: float = 1.0
    density: float = 1.0
    slope: float = 0.0
    offset: float = 0.0


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int, aside: int) -> DataFrame:
    """text, toxic and aside (kept for calibration) of rows that may be learned from.

    Those have crc32(doc_id as text) mod 3 other than 1. At most about ``sample`` + ``aside`` rows
    are read, a quarter of them toxic at most. A repeated id counts once with its largest label;
    equal texts of one label count once.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("_id").cast("string")) % 3 != 1)
    size = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    draw = F.pmod(F.xxhash64(F.lit("toxic"), "_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.lit(0.0)
    for toxic, count in size.items():
        part = (sample + aside) * (0.25 if toxic else 0.75)
        share = F.when(F.col("toxic") == toxic, F.lit(min(1.0, part / count))).otherwise(share)
    picked = known.where(draw < share).withColumn("aside", F.pmod(F.xxhash64(F.lit("aside"), "_id"), F.lit(1 << 20)) < F.lit((aside << 20) // (sample + aside)))
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # At most about `sample` + `aside` rows of two numbers.
    joined = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", "toxic", "aside")
    mark = F.xxhash64("text")
    return joined.groupBy(mark.alias("m"), F.length("text").alias("l"), "toxic").agg(F.first("text").alias("text"), F.min("aside").alias("aside"))


def features(rows: DataFrame, prior: float = PRIOR, z: float = Z, most: int = FEATURES) -> DataFrame:
    """kind (code points of a beginning, 0: whole word), name and score of the features that stand out.

    ``rows`` has text and toxic. The score is the log-odds that an occurrence is from a toxic text,
    less those of all words.
    """
    words = F.regexp_extract_all(_lower(F.col("text")), F.lit(WORD), F.lit(0))
    listed = rows.select("toxic", words.alias("word"))
    paired = F.arrays_zip("word", F.concat(F.array(F.lit("")), "word").alias("ahead"))
    found = listed.select("toxic", F.explode(paired).alias("x")).where("x.word is not null").select("toxic", "x.word", "x.ahead")
    seen = found.select("word", F.xxhash64("ahead").alias("ahead"), "toxic").groupBy("word", "ahead").agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("c"))
    counts = seen.groupBy("word").agg(F.sum("t").cast("double").alias("t"), F.sum("c").cast("double").alias("c"))
    counts = stored(counts, "toxic-words")
    base_t, base_c = (x or 0.0 for x in counts.agg(F.sum("t"), F.sum("c")).first())
    base = (base_t + 1) / (base_t + base_c + 2)
    # Each beginning with its sums and what the shorter one says; a word shorter than a beginning has none.
    rate, level, tables = F.lit(base), counts, []
    kinds = [*BEGINNINGS, 0]
    for kind in kinds:
        name = F.substring("word", 1, kind) if kind else F.col("word")
        if kind:
            same = Window.partitionBy(*[F.substring("word", 1, k) for k in BEGINNINGS if k <= kind])
            level = level.withColumn(f"t{kind}", F.sum("t").over(same)).withColumn(f"c{kind}", F.sum("c").over(same))
            t, c, has = F.col(f"t{kind}"), F.col(f"c{kind}"), F.length("word") >= kind
        else:
            t, c, has = F.col("t"), F.col("c"), F.lit(True)
        level = level.withColumn(f"p{kind}", rate)
        level = level.withColumn(f"r{kind}", F.when(has, (t + prior * rate) / (t + c + prior)).otherwise(rate))
        rate = F.col(f"r{kind}")
        tables.append((kind, name, t, c, has))
    odds = lambda r: F.log(r / (1 - r))
    entries = []
    for kind, name, t, c, has in tables:
        r, p = F.col(f"r{kind}"), F.col(f"p{kind}")
        score, above = odds(r) - F.lit(math.log(base / (1 - base))), odds(p) - F.lit(math.log(base / (1 - base)))
        error = F.sqrt(1 / (t + prior * p) + 1 / (c + prior * (1 - p)))
        entries.append(F.struct(
            F.lit(kind).alias("kind"), F.when(has, name).alias("name"), score.alias("score"), (score / error).alias("z"), above.alias("above"), t.alias("t"), c.alias("c"),
        ))
    level = level.select(F.explode(F.array(*entries)).alias("f")).select("f.*").where("name is not null").dropDuplicates(["kind", "name"])
    stands = (F.col("z") >= z) & (F.col("score") >= 1)
    # What a longer form takes back: its beginning is toxic, the form itself is not.
    takes_back = (F.col("above") >= 1) & (F.col("score") < 1)
    kept = level.where(stands | takes_back).withColumn("score", F.when(F.col("score") >= 1, F.col("score")).otherwise(F.lit(0.0)))
    return kept.orderBy(F.col("z").desc(), "kind", "name").limit(most).select("kind", "name", "score")


def _table(found: DataFrame) -> Model:
    rows = found.collect()  # at most FEATURES rows
    hashes, scores = [], []
    for kind in (*BEGINNINGS, 0):
        mine = [r for r in rows if r["kind"] == kind]
        names = [r["name"].encode() for r in mine]
        ends = np.cumsum([len(n) for n in names], dtype=np.int64) if names else np.zeros(0, np.int64)
        h = span_hashes(np.frombuffer(b"".join(names), np.uint8), ends - [len(n) for n in names], ends, _CODES) if names else np.zeros(0, np.uint64)
        order = np.argsort(h)
        hashes.append(h[order])
        scores.append(np.array([r["score"] for r in mine])[order] if mine else np.zeros(0))
    return Model(hashes, scores)


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model) -> np.ndarray:
    """For each word the score of its longest known feature, the whole word first; 0 without one."""
    letters = np.flatnonzero((data & 0xC0) != 0x80)
    first, last = np.searchsorted(letters, starts), np.searchsorted(letters, ends)
    letters = np.append(letters, len(data))
    out = np.zeros(len(starts))
    for kind, hashes, scores in zip((*BEGINNINGS, 0), model.hashes, model.scores):
        if not len(hashes):
            continue
        has = np.flatnonzero(last - first >= kind)
        stop = letters[first[has] + kind] if kind else ends[has]
        h = span_hashes(data, starts[has], stop, _CODES)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        known = hashes[at] == h
        out[has[known]] = scores[at[known]]
    return out


def segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, last word, score) of a text, in one linear scan.

    ``places`` are the words of positive score, in order; all others cost ``drift``. Candidates keep
    the running sum in front of them and at their end. A new one joins the nearest earlier candidate
    that starts at a smaller sum, unless that one ends at a sum as high as its own.
    """
    held: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, the nearest earlier start that is lower
    total, behind = 0.0, 0
    for place, score in zip(places, scores):
        total -= drift * (place - behind)
        behind = place + 1
        first, before = place, total
        total += score
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= before:
                j = held[j][4]
            if j < 0 or held[j][3] >= total:
                held.append((first, place, before, total, j))
                break
            first, before = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, after - before) for a, b, before, after, _ in held]


def log_p(scores: list[float], words: int, scale: float, density: float) -> float:
    """Minus the logarithm of the chance of such segments in a clean text, the best r taken together."""
    best, total = 0.0, 0.0
    level = math.log(max(density * max(words, 1), 1e-300))
    for r, score in enumerate(sorted(scores, reverse=True), 1):
        total += scale * score - level
        # Sum statistic of r segments; another r costs a factor of two.
        value = total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2)
        best = max(best, value)
    return best


def passages(texts: pa.Array, model: Model):
    """For each text its number of words and its segments."""
    for _, data, offsets in text_blocks(texts):
        starts, ends, cut = spans(_INSIDE[data], offsets)
        score = word_scores(data, starts, ends, model)
        hit = np.flatnonzero(score > 0)
        bounds = np.searchsorted(hit, cut)
        for r in range(len(offsets) - 1):
            mine = hit[bounds[r] : bounds[r + 1]]
            yield int(cut[r + 1] - cut[r]), segments((mine - cut[r]).tolist(), score[mine].tolist())


def _map(rows: DataFrame, schema: T.StructType, keep: list[str], model: Model, make):
    spark = rows.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most FEATURES hashes and scores
    names = rows.columns

    def run(batches):
        for batch in batches:
            found = list(passages(batch.column(names.index("text")), shared.value))
            columns = make(found, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(names.index(c)) for c in keep] + columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and offset of a logistic curve by Newton's method, with a slight pull to a slope of 0."""
    if not len(y):
        return 0.0, 0.0
    design, weight = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    pull = np.diag([1e-2, 1e-6])
    weight[1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weight, -500, 500)))
        gradient = design.T @ (p - y) + pull @ weight
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + pull, gradient)
        weight -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(weight[0])), float(weight[1])


#: log p-values are turned into evidence by a logarithm, so that long toxic texts don't outweigh all others in the fit.
def _evidence(value: float) -> float:
    return math.log1p(value)


def calibrate(aside: DataFrame, model: Model) -> Model:
    """``model`` with the constants of the extreme-value law and of the logistic curve, from ``aside`` (text, toxic).

    ``aside`` is bounded; each of its rows comes to the driver as its label, words, and segment scores.
    """
    schema = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("words", T.LongType()), T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def make(found, _):
        return [pa.array([n for n, _ in found], pa.int64()), pa.array([[s for _, _, s in x] for _, x in found], pa.list_(pa.float64()))]

    rows = _map(aside.select("toxic", "text"), schema, ["toxic"], model, make).collect()
    clean = [s for r in rows if not r["toxic"] for s in r["scores"]]
    words = sum(r["words"] for r in rows if not r["toxic"]) + 1
    highest = max([float(s.max(initial=0)) for s in model.scores] + [1.0])
    # One segment as high as a single word can be is added, so that clean samples without any have a law too.
    clean = np.array([*clean, highest])
    lowest = float(clean.min())
    model.scale = 1 / max(float(clean.mean()) - lowest, highest / 8)
    model.density = len(clean) * math.exp(model.scale * lowest) / words
    x = np.array([_evidence(log_p(r["scores"], r["words"], model.scale, model.density)) for r in rows])
    y = np.array([r["toxic"] for r in rows], np.float64)
    model.slope, model.offset = _logistic(x, y)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, aside: int = ASIDE) -> Model:
    rows = stored(labelled_rows(docs, labels, sample, aside), "toxic-rows")
    return calibrate(rows.where("aside"), _table(features(rows.where("not aside"))))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with n_passages, passages (first and last word, score of each significant segment) and a score from 0 to 1.

    A segment is significant if a clean text of that length has one like it with a chance below 1 %.
    Columns of these names are replaced; all rows stay, nothing is shuffled.
    """
    new = [column, "n_passages", "passages"]
    rest = [c for c in docs.columns if c.lower() not in {x.lower() for x in new}]
    docs = docs.select(*[F.col(f"`{c}`") for c in rest])
    item = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType()), T.StructField("n_passages", T.LongType()), T.StructField("passages", T.ArrayType(item))])
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def make(found, model):
        value, kept = [], []
        for words, mine in found:
            x = _evidence(log_p([s for _, _, s in mine], words, model.scale, model.density))
            value.append(1 / (1 + math.exp(-max(-500.0, min(500.0, model.slope * x + model.offset)))))
            least = (math.log(max(model.density * max(words, 1), 1e-300)) - math.log(0.01)) / model.scale
            kept.append([{"first": a, "last": b, "score": s} for a, b, s in mine if s >= least])
        return [pa.array(value, pa.float64()), pa.array([len(x) for x in kept], pa.int64()), pa.array(kept, kind)]

    return _map(docs, schema, rest, model, make)


def toxicity(docs: DataFrame, labels: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and the significant passages for each row of ``docs``.

    Learned from ``known`` (doc_id, text), or from ``docs``, and ``labels`` (doc_id, toxic); only
    text, and never another column, enters a score. Null and empty texts have no passage and the
    score of a text without one. Without labels of both kinds every score is the share of toxic
    labels. Repeated rows are scored each; an empty table gives no rows; other columns are not read.
    """
    model = train(known if known is not None else docs, labels)
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).drop("text")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= PREDICTED, 1).otherwise(0).cast("int").alias("predicted"), "n_passages", "passages",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, known: DataFrame, ceiling: float = PREDICTED) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``ceiling``."""
    names = [fresh(docs, n) for n in ("_toxic",)]
    model = train(known, labels)
    marked = score(docs, model, names[0])
    return marked.where(F.col(names[0]) < ceiling).select(*[F.col(f"`{c}`") for c in docs.columns])

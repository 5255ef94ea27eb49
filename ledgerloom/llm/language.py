"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

The text gives log likelihoods under hashed word and n-gram models, one per language, counted over
a bounded sample of labelled texts. A first pass turns them into posteriors, whose sums by declared
language, by suffix and by host (grouped aggregation, so a host with a third of all rows is a sum
of partial sums) become the other evidence:

* P(declared | language) and P(suffix | language), with additive smoothing;
* P(language | host), smoothed towards its parent domain, which is smoothed towards all rows.

The posterior is proportional to the product of all four. Neighbouring features of a text repeat
each other, so its log likelihood counts with the exponent ``TEMPER``.

That a text is in none of the languages is a hypothesis of its own, and a matter of the text alone.
Under it each trigram of the text's letters, case folded, has the same likelihood: half way (in logs)
between what the languages' own texts reach and what the texts of one language reach under the
others. The other side is the likeliest language of each trigram, so a text of several known
languages is a known one. Signs, digits, addresses and words with digits don't count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, fresh, stored
from .subwords import families, slice_sums
from .words import text_blocks

BITS, NGRAMS, TEMPER, STRENGTH = 15, (3,), 0.1, 4.0
#: About so many labelled texts of each language are read to fit the text models.
SAMPLE = 1500
#: Table size for trigrams of letters, the exponent of their likelihoods, and the prior of no known language.
LETTER_BITS, REACH, NONE = 16, 0.3, 0.01
#: Web and mail addresses, words with digits, and runs without letters.
NO_LETTERS = r"(?:https?://\S+|[\w.%+-]{1,64}@[\w.-]+|[\pL\pM]*\pN[\pL\pM\pN]*|[^\pL\pM]+)+"


def letters(texts: pa.Array) -> pa.Array:
    """Words of letters in lower case with a blank between them; null reads as empty."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), NO_LETTERS, " ")


def _letter_trigrams(texts: pa.Array):
    """Blocks (first row, positions, each row's slice of them, its words of letters)."""
    for first, data, offsets in text_blocks(letters(texts)):
        (_, first_word, last_word), (at, begin, end) = families(data, offsets, LETTER_BITS, (3,))
        yield first, at, begin, end, last_word - first_word


def known_letters(counts: np.ndarray) -> np.ndarray:
    """Log ratio of some known language to none, by position of a trigram of letters.

    ``counts`` holds the labelled texts' trigrams by language. What a language's own texts reach is
    taken with one occurrence left out, so that rare trigrams don't look expected.
    """
    smooth = counts + 0.5
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    uniform = np.full(counts.shape[1], -np.log(counts.shape[1]))
    own, other = [], []
    for k, n in enumerate(counts):
        if n.any():
            share = n / n.sum()
            own.append(share @ np.log(np.maximum(smooth[k] - 1, 0.5) / (smooth[k].sum() - 1)))
            other.append(share @ (np.delete(logs, k, 0).max(axis=0) if len(logs) > 1 else uniform))
    level = (np.mean(own) + np.mean(other)) / 2 if own else 0.0
    return (logs.max(axis=0) - level).astype(np.float32)


def text_models(labelled: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log probabilities by language and table position, and ``known_letters``.

    ``labelled`` has text and lang; rows with a null are left out. Counts are summed by Spark; what
    comes back is at most languages times ``2**bits + 2**LETTER_BITS`` numbers. Of each language about ``sample``
    texts are read, drawn by a hash of the text.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    rows = labelled.where("text is not null and lang is not null")
    # Stored, so that the planner knows its size (a row for each language) and need not shuffle the texts.
    sizes = stored(rows.groupBy("lang").count(), "language-sizes")
    draw = F.pmod(F.xxhash64(F.lit("language"), "text"), F.lit(1 << 20))
    chosen = rows.join(sizes, "lang").where(draw < F.least(F.lit(1.0), sample / F.col("count")) * (1 << 20))

    def count(batches):
        for batch in batches:
            langs, out = np.array(batch.column(0).to_pylist(), object), {}
            for first, data, offsets in text_blocks(batch.column(1)):
                for at, begin, end in families(data, offsets, bits, NGRAMS):
                    for r in range(len(offsets) - 1):
                        total = out.setdefault(langs[first + r], np.zeros((1 << bits) + (1 << LETTER_BITS), np.int64))
                        np.add.at(total, at[begin[r] : end[r]], 1)
            for first, at, begin, end, _ in _letter_trigrams(batch.column(1)):
                for r in range(len(begin)):
                    np.add.at(out[langs[first + r]], at[begin[r] : end[r]] + (1 << bits), 1)
            for lang, total in out.items():
                used = np.flatnonzero(total)
                columns = [pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(total[used])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "at", "n"])

    summed = chosen.select("lang", "text").mapInArrow(count, "lang string, at long, n long")
    found = summed.groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    totals = np.zeros((len(langs), (1 << bits) + (1 << LETTER_BITS)))
    for k, lang in enumerate(langs):
        mine = found[found["lang"] == lang]
        totals[k, mine["at"].to_numpy(np.int64)] = mine["n"].to_numpy(np.float64)
    counts = totals[:, : 1 << bits] + 0.5
    table = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    return langs, table, known_letters(totals[:, 1 << bits :]) if langs else np.zeros(1 << LETTER_BITS, np.float32)


def likelihoods(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each text under each language, and its number of features; null reads as empty."""
    bits = table.shape[1].bit_length() - 1
    total, count = np.zeros((len(texts), len(table))), np.zeros(len(texts), np.int64)
    for first, data, offsets in text_blocks(texts):
        to = slice(first, first + len(offsets) - 1)
        for at, begin, end in families(data, offsets, bits, NGRAMS):
            count[to] += end - begin
            for k in range(len(table)):
                total[to, k] += slice_sums(table[k][at], begin, end)
    return total, count


def none_of_these(texts: pa.Array, known: np.ndarray) -> np.ndarray:
    """Probability that a text is in none of the languages; 1 for a text without a word of letters."""
    ratio, words = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for first, at, begin, end, n in _letter_trigrams(texts):
        to = slice(first, first + len(begin))
        ratio[to] += slice_sums(known[at], begin, end)
        words[to] += n
    odds = np.clip(REACH * ratio + np.log((1 - NONE) / NONE), -500, 500)
    return np.where(words > 0, 1 / (1 + np.exp(odds)), 1.0)


def _softmax(logs: np.ndarray) -> np.ndarray:
    powers = np.exp(logs - logs.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def identify(rows: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Language of each row of ``rows`` (id, text, declared, suffix, host, parent; any may be null).

    Returns id, lang, probability, text_lang (by the text alone), declared, host and n_features.
    A text that is likelier in none of the languages than in one, a text without a single word of
    letters, and any text where no language is known, has lang and text_lang 'und' and probability 0;
    such texts don't count as evidence. Else the probability includes that of a known language. Null evidence counts as a value of its own; repeated rows give repeated results.
    """
    spark = rows.sparkSession
    langs, table, known = text_models(labelled, sample)
    size = range(len(langs))
    shared, shared_known = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(known)
    facts = ["id", "declared", "suffix", "host", "parent"]
    kinds = dict(rows.select(*facts, "text").dtypes)

    def run(batches):
        for batch in batches:
            logs, count = likelihoods(batch.column(5), shared.value)
            none = none_of_these(batch.column(5), shared_known.value)
            found = np.hstack([TEMPER * logs, _softmax(TEMPER * logs) * (1 - none)[:, None]]) if langs else logs
            found = [pa.array(np.ascontiguousarray(x)) for x in [*found.T, none]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found, pa.array(count)], [*facts, *names, "none", "n"])

    names = [f"{c}{k}" for c in "lp" for k in size]
    schema = ", ".join(f"{c} {kinds[c]}" for c in facts) + "".join(f", {c} double" for c in names) + ", none double, n long"
    seen = stored(rows.select(*facts, "text").mapInArrow(run, schema), "language-text")
    if not langs:
        return seen.select(
            "id", F.lit("und").alias("lang"), F.lit(0.0).alias("probability"), F.lit("und").alias("text_lang"),
            "declared", "host", F.col("n").alias("n_features"),
        )

    soft = seen.where("n > 0 and none <= 0.5")
    sums = [F.sum(f"p{k}").alias(f"p{k}") for k in size]
    # One row for each host; everything else is summed from it.
    by_host = stored(soft.groupBy("host", "parent", "suffix", "declared").agg(*sums), "language-host")

    def summed(*keys: str) -> DataFrame:
        return by_host.groupBy(*keys).agg(*sums)

    whole = by_host.agg(*sums).first()  # one row
    whole = np.array([x or 0.0 for x in whole], float) + 1
    prior = whole / whole.sum()

    def evidence(key: str, name: str) -> DataFrame:
        """log P(value | language), additively smoothed."""
        values = summed(key)
        return values.select(key, *[F.log((F.col(f"p{k}") + 0.1) / (float(whole[k]) + 0.1)).alias(f"{name}{k}") for k in size])

    def share(frame: DataFrame, base: list[Column], name: str, *keys: str) -> DataFrame:
        """P(language | key), smoothed towards ``base`` with the weight of STRENGTH rows."""
        n = sum((F.col(f"p{k}") for k in size), F.lit(0.0))
        return frame.select(*keys, *[((F.col(f"p{k}") + STRENGTH * base[k]) / (n + STRENGTH)).alias(f"{name}{k}") for k in size])

    parents = share(summed("parent"), [F.lit(float(x)) for x in prior], "q", "parent")
    hosts = summed("host", "parent").alias("h").join(parents.alias("d"), F.expr("h.parent <=> d.parent"), "left")
    hosts = hosts.select("h.*", *[f"q{k}" for k in size])
    hosts = share(hosts, [F.col(f"q{k}") for k in size], "h", "host", "parent")

    def attach(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        right = stored(right, "language-evidence")
        same = [left[k].eqNullSafe(right[k]) for k in keys]
        return left.join(right, same, "left").drop(*[right[k] for k in keys])

    fused = attach(attach(attach(seen, evidence("declared", "d"), "declared"), evidence("suffix", "s"), "suffix"), hosts, "host", "parent")
    start = np.log(prior)

    def decide(batches):
        """The product of the evidence; a value that no row with words has says nothing."""
        named = np.array([*langs, "und"], object)
        for batch in batches:
            columns = {c: batch.column(k) for k, c in enumerate(kept)}
            logs = np.zeros((batch.num_rows, len(langs)))
            for k in size:
                for c in "ldsh":
                    value = columns[f"{c}{k}"].to_numpy(zero_copy_only=False).astype(float)
                    value = np.log(value) if c == "h" else value
                    logs[:, k] += np.where(np.isnan(value), start[k] if c == "h" else 0.0, value)
            text = np.stack([columns[f"l{k}"].to_numpy() for k in size], axis=1)
            none = columns["none"].to_numpy()
            known = (columns["n"].to_numpy() > 0) & (none <= 0.5)
            chosen = np.where(known, logs.argmax(axis=1), len(langs))
            alone = np.where(known, text.argmax(axis=1), len(langs))
            sure = np.where(known, _softmax(logs).max(axis=1) * (1 - none), 0.0)
            out = [columns["id"], pa.array(named[chosen], pa.string()), pa.array(sure), pa.array(named[alone], pa.string())]
            out += [columns["declared"], columns["host"], columns["n"]]
            yield pa.RecordBatch.from_arrays(out, ["id", "lang", "probability", "text_lang", "declared", "host", "n_features"])

    kept = ["id", "declared", "host", "none", "n", *[f"{c}{k}" for c in "ldsh" for k in size]]
    return fused.select(*kept).mapInArrow(
        decide,
        f"id {kinds['id']}, lang string, probability double, text_lang string, declared {kinds['declared']}, host {kinds['host']}, n_features long",
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """The evidence of web pages (page_id, url, html) for ``identify``; null html is an empty text."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-zA-Z0-9#]+;", " ")
    return pages.select(
        F.col("page_id").alias("id"),
        F.lower(F.regexp_extract(html, r"(?is)<html[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1)).alias("declared"),
        F.substring_index(host, ".", -1).alias("suffix"),
        host.alias("host"),
        F.when(host.contains("."), F.substring_index(host, ".", -2)).otherwise(host).alias("parent"),
        bare.alias("text"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """The evidence of documents: their declared lang, their source as host."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("declared"), none.alias("suffix"),
        F.col("source").alias("host"), none.alias("parent"), F.col("text").alias("text"),
    )


def keep_identified(docs: DataFrame, labelled: DataFrame, floor: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a language with a probability of ``floor`` or more.

    Rejects are matched by doc_id; a row without one can't be and stays.
    """
    found = identify(document_rows(docs), labelled)
    name = fresh(docs, "_gone")
    gone = found.where((F.col("lang") == "und") | (F.col("probability") < floor)).select(F.col("id").alias(name)).distinct()
    return docs.join(stored(gone, "language-rejects"), F.col("doc_id") == F.col(name), "left_anti")

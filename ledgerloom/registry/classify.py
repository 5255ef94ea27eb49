"""Checks of rules, classification, training frames and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalise
from ..models import evaluation, forest, mllib, naive_bayes, selection, vectors
from ..operators import classify as cl
from ..params import DEFAULTS
from ..schema import rnd
from ..session import stored
from . import fixtures as fx
from . import register
from .ledger import KEY, texts
from .sqltext import C, L, N, norm, r


def _rule_sql(raw: str, text: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{n}'" for p, n in cl.RULES)
    w = cl.WITHDRAWAL.replace("(?iU)", "(?i)")
    return f"CASE WHEN {text} = '' THEN NULL WHEN regexp_matches({raw}, '{w}') THEN 'Cash Withdrawal' {cases} END"


RULED = f"""RULED AS (SELECT N.*, {norm('description')} AS text FROM N),
RU AS (SELECT *, {_rule_sql('description', 'text')} AS ruled FROM RULED)"""


@register("ml_rule_category", f"WITH {L}, {N}, {RULED} SELECT {KEY}, ruled FROM RU")
def _(spark, sf):
    rows = fx.ledger(spark, sf, named=True).select("user_id", "txn_key", "description")
    return cl.with_rule_category(rows, "ruled").drop("description")


@register(
    "ml_rule_category_documents",
    f"""WITH D AS (SELECT doc_id, text AS raw, {norm('text')} AS text FROM documents)
    SELECT doc_id, {_rule_sql('raw', 'text')} AS ruled FROM D""",
)
def _(spark, sf):
    rows = fx.table(spark, sf, "documents").select("doc_id", "text")
    return cl.with_rule_category(rows, "ruled", "text").drop("text")


_CLASS = f"""CL AS (SELECT user_id, txn_key, coalesce(ruled, 'Uncategorised') AS category_name,
  CASE WHEN ruled IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS category_confidence,
  CASE WHEN ruled IS NULL THEN 'default' ELSE 'rule' END AS category_source FROM RU)"""


@register("ml_classify", f"WITH {L}, {N}, {RULED}, {_CLASS} SELECT * FROM CL")
def _(spark, sf):
    return cl.classify(fx.ledger(spark, sf, named=True)).select(
        "user_id", "txn_key", "category_name", "category_confidence", "category_source"
    )


def _frame(spark, sf):
    """Training rows labelled by rule, so that the text decides the class."""
    ruled = cl.classify(fx.ledger(spark, sf, named=True)).withColumn(
        "category_source", F.when(F.col("txn_key").endswith("0"), "user").otherwise(F.col("category_source"))
    )
    return cl.training_frame(ruled, fx.category_dim(spark), ("txn_key", "user_id")).withColumnRenamed("txn_key", "row_id")


@register(
    "ml_training_frame",
    f"""WITH {L}, {N}, {C} SELECT txn_key, {norm('description')} AS text, CAST(amount AS DOUBLE) AS amount,
    (dayofweek(txn_date) + 6) % 7 AS day_of_week, day(txn_date) AS day_of_month, category_name, category_source,
    CASE WHEN category_source = 'user' THEN 3 ELSE 1 END AS weight
    FROM N JOIN C USING (category_name) WHERE txn_type = 'DEBIT' AND category_name <> 'Uncategorised'""",
)
def _(spark, sf):
    return texts(cl.training_frame(fx.ledger(spark, sf, named=True), fx.category_dim(spark), ("txn_key",)))


@register(
    "sc_features",
    f"""WITH {L}, {N} SELECT {KEY}, {norm('description')} AS text, CAST(amount AS DOUBLE) AS amount,
    (dayofweek(txn_date) + 6) % 7 AS day_of_week, day(txn_date) AS day_of_month FROM N""",
)
def _(spark, sf):
    rows = cl.features(fx.ledger(spark, sf, named=True))
    return texts(rows.select("user_id", "txn_key", "text", "amount", "day_of_week", "day_of_month"))


@register(
    "se_training_union",
    f"""WITH {L}, {N}, {C} SELECT category_name, sum(CASE WHEN category_source = 'user' THEN 3 ELSE 1 END) AS n
    FROM N JOIN C USING (category_name) WHERE txn_type = 'DEBIT' AND category_name <> 'Uncategorised' GROUP BY ALL""",
)
def _(spark, sf):
    frame = cl.training_frame(fx.ledger(spark, sf, named=True), fx.category_dim(spark))
    return cl.repeated(frame).groupBy("category_name").agg(F.count("*").alias("n"))


def _seed(spark):
    """A short curated list in the seed's shape."""
    rows = [
        ("corner supermarket", "Groceries"), ("town taxi fare", "Transport"), ("video subscription", "Subscriptions"),
        ("pizza house", "Dining Out"), ("monthly rent", "Housing"), ("school fees term", "Education"),
    ]
    values = ", ".join(f"('{a}', '{b}')" for a, b in rows)
    return spark.sql(
        f"""SELECT text, 0D AS amount, 0 AS day_of_week, 1 AS day_of_month, category_name, 'seed' AS category_source
        FROM VALUES {values} AS t(text, category_name)"""
    )


@register(
    "ml_bootstrap_gate",
    f"""WITH {L}, {N}, {C}, F AS (SELECT user_id, category_name, CASE WHEN category_source = 'user' THEN 3 ELSE 1 END AS weight
      FROM N JOIN C USING (category_name) WHERE txn_type = 'DEBIT' AND category_name <> 'Uncategorised'
      AND (user_id < 20 OR category_name = 'Groceries')),
    G AS (SELECT user_id, count(*) AS n, sum(weight) AS w, count(DISTINCT category_name) AS k FROM F GROUP BY ALL)
    SELECT user_id, n + CASE WHEN w < 20 OR k < 2 THEN 6 ELSE 0 END AS n FROM G""",
)
def _(spark, sf):
    """Accounts from 20 on have one class only in this case, so they get the seed."""
    ledger = fx.ledger(spark, sf, named=True).filter((F.col("user_id") < 20) | (F.col("category_name") == "Groceries"))
    frame = cl.training_frame(ledger, fx.category_dim(spark), ("user_id",))
    return cl.with_bootstrap(frame, _seed(spark)).groupBy("user_id").agg(F.count("*").alias("n"))


@register(
    "ml_relabel",
    f"""WITH {L}, {N}, {RULED} SELECT user_id, txn_key,
    CASE WHEN hit THEN coalesce(ruled, 'Uncategorised') ELSE category_name END AS category_name,
    CASE WHEN hit THEN CASE WHEN ruled IS NULL THEN 'default' ELSE 'rule' END ELSE category_source END AS category_source
    FROM (SELECT *, coalesce(txn_type = 'DEBIT' AND category_name = 'Uncategorised' AND category_source <> 'user', false) AS hit FROM RU)""",
)
def _(spark, sf):
    return cl.relabel(fx.ledger(spark, sf, named=True)).select("user_id", "txn_key", "category_name", "category_source")


@register(
    "ml_apply_corrections",
    f"""WITH {L}, {C}, K AS (SELECT txn_key, CASE WHEN amount > 60000 THEN 'Housing' WHEN amount > 40000 THEN 'Nonsense'
        ELSE 'Transport' END AS category_name, 1 AS seq FROM L WHERE txn_type = 'DEBIT'
      UNION ALL SELECT txn_key, 'Utilities', 2 FROM L WHERE amount > 80000),
    X AS (SELECT txn_key, max_by(category_name, seq) AS fixed FROM K JOIN C USING (category_name) GROUP BY ALL)
    SELECT user_id, txn_key, coalesce(fixed, category_name) AS category_name,
    CASE WHEN fixed IS NULL THEN category_source ELSE 'user' END AS category_source FROM L LEFT JOIN X USING (txn_key)""",
)
def _(spark, sf):
    ledger = fx.ledger(spark, sf)
    first = ledger.filter("txn_type = 'DEBIT'").select(
        "txn_key",
        F.when(F.col("amount") > 60000, "Housing").when(F.col("amount") > 40000, "Nonsense").otherwise("Transport").alias("category_name"),
        F.lit(1).alias("corrected_at"),
    )
    second = ledger.filter("amount > 80000").select(
        "txn_key", F.lit("Utilities").alias("category_name"), F.lit(2).alias("corrected_at")
    )
    fixed = cl.apply_corrections(ledger, first.unionByName(second), fx.category_dim(spark))
    return fixed.select("user_id", "txn_key", "category_name", "category_source")


# --- TF-IDF and naive Bayes --------------------------------------------------------

# Distinct (merchant text, category) pairs of the ledger are the documents.
DOCS = f"""DOCS AS (SELECT txn_key AS doc_id, text, ruled AS label FROM RU WHERE txn_type = 'DEBIT' AND ruled IS NOT NULL),
WORDS AS (SELECT doc_id, label, list_filter(string_split(text, ' '), lambda w: length(w) >= 2) AS ws FROM DOCS),
TM AS (SELECT doc_id, label, unnest(list_concat(ws, list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM WORDS),
TF AS (SELECT doc_id, label, term, count(*) AS tf FROM TM GROUP BY ALL),
IDF AS (SELECT term, ln((1 + (SELECT count(*) FROM DOCS)) / (1 + count(*))) + 1 AS idf FROM TF GROUP BY ALL),
WT AS (SELECT doc_id, label, term, (1 + ln(tf)) * idf AS w FROM TF JOIN IDF USING (term)),
WN AS (SELECT doc_id, label, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM WT)"""


def _docs(spark, sf):
    debits = fx.ledger(spark, sf, named=True).filter("txn_type = 'DEBIT'").select(
        F.col("txn_key").alias("doc_id"), "description", normalise("description").alias("text")
    )
    return cl.with_rule_category(debits, text="text").filter("category_name IS NOT NULL").select("doc_id", "text", "category_name")


@register("ml_tfidf", f"WITH {L}, {N}, {RULED}, {DOCS} SELECT doc_id, term, {r('weight', 6)} AS weight FROM WN")
def _(spark, sf):
    return vectors.tfidf(_docs(spark, sf)).select("doc_id", "term", rnd("weight", 6).alias("weight"))


@register(
    "ml_naive_bayes",
    f"""WITH {L}, {N}, {RULED}, {DOCS}, LB AS (SELECT label, count(*) AS n FROM DOCS GROUP BY ALL),
    V AS (SELECT count(*) AS v FROM IDF), CT AS (SELECT label, sum(weight) AS t FROM WN GROUP BY ALL),
    TC AS (SELECT label, term, sum(weight) AS s FROM WN GROUP BY ALL),
    LP AS (SELECT IDF.term, LB.label, ln((coalesce(s, 0) + 0.1) / (t + 0.1 * v)) AS lp
      FROM IDF JOIN LB ON true JOIN CT ON CT.label = LB.label JOIN V ON true LEFT JOIN TC ON TC.term = IDF.term AND TC.label = LB.label),
    SC AS (SELECT doc_id, LP.label, sum(weight * lp) + ln(any_value(n) / (SELECT sum(n) FROM LB)) AS score
      FROM WN JOIN LP USING (term) JOIN LB ON LB.label = LP.label GROUP BY ALL)
    SELECT doc_id, max_by(label, score) AS predicted_category, {r('1 / sum(exp(score - best))', 4)} AS probability
    FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM SC) GROUP BY doc_id""",
)
def _(spark, sf):
    docs = _docs(spark, sf)
    said = naive_bayes.fit(docs).predict(docs.select("doc_id", "text").distinct())
    return said.select("doc_id", "predicted_category", rnd("predicted_probability", 4).alias("probability"))


@register("ml_classify_model")
def _(spark, sf):
    """Classification with the fitted model in front of the rules."""
    ledger = fx.ledger(spark, sf, named=True)
    return cl.classify(ledger, naive_bayes.fit(_docs(spark, sf))).select(
        "user_id", "txn_key", "category_name", rnd("category_confidence", 4).alias("category_confidence"), "category_source"
    )


@register("ml_naive_bayes_mllib")
def _(spark, sf):
    frame = _frame(spark, sf)
    said = mllib.fit(frame).predict(frame)
    return evaluation.macro_f1(said.select(F.col("category_name").alias("y"), F.col("predicted_category").alias("pred")))


# The frame's rows: labelled by rule, a correction counting three times.
FRAME = """FR AS (SELECT txn_key AS row_id, text, ruled AS label, CASE WHEN txn_key LIKE '%0' THEN 3 ELSE 1 END AS weight,
    (row_number() OVER (PARTITION BY ruled ORDER BY md5(txn_key), txn_key) - 1) % 5 AS fold
  FROM RU WHERE txn_type = 'DEBIT' AND ruled IS NOT NULL)"""


@register(
    "ml_random_forest",
    f"""WITH {L}, {N}, {RULED}, {FRAME} SELECT CAST(sum(weight) AS BIGINT) AS samples, count(DISTINCT label) AS classes,
    200 AS trees, true AS good FROM FR""",
)
def _(spark, sf):
    """200 trees without a set depth; whether macro F1 on the frame reaches the target."""
    frame = stored(_frame(spark, sf), "frame")
    ready = selection.gate(frame)
    model = forest.fit(frame)
    said = model.predict(frame).select(F.col("category_name").alias("y"), F.col("predicted_category").alias("pred"))
    good = evaluation.class_report(said).agg((F.avg("f1") >= DEFAULTS.target_f1).alias("good"))
    return good.crossJoin(model.trees.agg(F.count("*").cast("int").alias("trees"))).select(
        F.lit(ready.samples).cast("bigint").alias("samples"), F.lit(ready.classes).cast("bigint").alias("classes"), "trees", "good"
    )


@register(
    "ml_cv_folds",
    f"""WITH {L}, {N}, {RULED} SELECT txn_key AS row_id, (row_number() OVER (PARTITION BY coalesce(ruled, 'Uncategorised')
    ORDER BY md5(txn_key), txn_key) - 1) % 5 AS fold FROM RU WHERE txn_type = 'DEBIT' AND ruled IS NOT NULL""",
)
def _(spark, sf):
    return texts(selection.with_folds(_frame(spark, sf), 5).select("row_id", "fold"))


# Model m of each fold learns from the rows of the others; every text is scored under every label.
_CV = f"""{FRAME}, DT AS (SELECT text, label, fold, sum(weight) AS weight FROM FR GROUP BY ALL), M AS (SELECT unnest(range(5)) AS m),
TX AS (SELECT text, list_filter(string_split(text, ' '), lambda w: length(w) >= 2) AS ws FROM DT GROUP BY ALL),
TT AS (SELECT text, unnest(list_concat(ws, list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM TX),
TF AS (SELECT text, term, count(*) AS tf FROM TT GROUP BY ALL),
MN AS (SELECT m, sum(weight) AS n FROM DT JOIN M ON fold <> m GROUP BY ALL),
IDF AS (SELECT m, term, ln((1 + any_value(n)) / (1 + sum(weight))) + 1 AS idf
  FROM DT JOIN M ON fold <> m JOIN MN USING (m) JOIN TF USING (text) GROUP BY m, term),
WT AS (SELECT m, text, term, (1 + ln(tf)) * idf AS w FROM TF JOIN IDF USING (term)),
WN AS (SELECT m, text, term, w / sqrt(sum(w * w) OVER (PARTITION BY m, text)) AS u FROM WT),
TC AS (SELECT m, label, term, sum(weight * u) AS s FROM WN JOIN DT USING (text) WHERE fold <> m GROUP BY ALL),
CT AS (SELECT m, label, sum(s) AS t FROM TC GROUP BY ALL), V AS (SELECT m, count(*) AS v FROM IDF GROUP BY ALL),
PR AS (SELECT m, label, ln(sum(weight) / any_value(n)) AS prior FROM DT JOIN M ON fold <> m JOIN MN USING (m) GROUP BY m, label),
LP AS (SELECT IDF.m, IDF.term, PR.label, ln((coalesce(s, 0) + 0.1) / (t + 0.1 * v)) AS lp
  FROM IDF JOIN PR USING (m) JOIN CT ON CT.m = IDF.m AND CT.label = PR.label JOIN V ON V.m = IDF.m
  LEFT JOIN TC ON TC.m = IDF.m AND TC.term = IDF.term AND TC.label = PR.label),
AK AS (SELECT fold AS m, text FROM DT GROUP BY ALL),
SC AS (SELECT AK.m, AK.text, PR.label, any_value(prior) + coalesce(sum(u * lp), 0) AS score FROM AK JOIN PR USING (m)
  LEFT JOIN WN ON WN.m = AK.m AND WN.text = AK.text LEFT JOIN LP ON LP.m = AK.m AND LP.term = WN.term AND LP.label = PR.label GROUP BY ALL),
SD AS (SELECT m, text, max_by(label, score) AS pred FROM SC GROUP BY ALL),
CM AS (SELECT label AS y, pred, sum(weight) AS n FROM DT JOIN SD ON SD.text = DT.text AND SD.m = DT.fold GROUP BY ALL),
F1 AS (SELECT l.label, 2 * coalesce(sum(n) FILTER (y = l.label AND pred = l.label), 0)
    / (coalesce(sum(n) FILTER (y = l.label), 0) + coalesce(sum(n) FILTER (pred = l.label), 0)) AS f1
  FROM (SELECT y AS label FROM CM UNION SELECT pred FROM CM) l JOIN CM ON y = l.label OR pred = l.label GROUP BY l.label)"""


@register(
    "ml_cv_select",
    f"""WITH {L}, {N}, {RULED}, {_CV}, S AS (SELECT CAST(sum(weight) AS BIGINT) AS samples, count(DISTINCT label) AS classes FROM FR)
    SELECT 'MultinomialNB' AS algorithm, {r('avg(f1)', 6)} AS macro_f1, avg(f1) >= 0.85 AS good, 5 AS folds, any_value(samples) AS samples,
    any_value(classes) AS classes FROM F1, S UNION ALL SELECT 'RandomForest', NULL, true, 5, samples, classes FROM S""",
)
def _(spark, sf):
    """Both classifiers by stratified folds; the forest's own F1 is no SQL, only whether it reaches the target."""
    chosen = selection.select_classifier(stored(_frame(spark, sf), "frame"))
    rows = [
        (name, round(score, 6) if name == "MultinomialNB" else None, score >= DEFAULTS.target_f1, chosen.folds, chosen.samples, chosen.classes)
        for name, score in chosen.scores.items()
    ]
    return spark.createDataFrame(rows, "algorithm STRING, macro_f1 DOUBLE, good BOOLEAN, folds INT, samples BIGINT, classes BIGINT")


_PRED = """PR AS (SELECT doc_id, lang AS y, CASE WHEN n_chars % 5 = 0 THEN 'en' WHEN n_chars % 7 = 0 THEN 'xx' ELSE lang END AS pred FROM documents),
LAB AS (SELECT y AS label FROM PR UNION SELECT pred FROM PR),
RP AS (SELECT label, count(*) FILTER (y = label) AS support, count(*) FILTER (pred = label) AS predicted,
  count(*) FILTER (y = label AND pred = label) AS hits FROM PR JOIN LAB ON y = label OR pred = label GROUP BY ALL),
RQ AS (SELECT label, support, hits, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p,
  CASE WHEN support > 0 THEN hits / support ELSE 0 END AS rc, CASE WHEN hits > 0 THEN 2 * hits / (support + predicted) ELSE 0 END AS f FROM RP)"""


@register(
    "ag_macro_f1",
    f"""WITH {_PRED} SELECT label, {r('p', 6)} AS precision, {r('rc', 6)} AS recall, {r('f', 6)} AS f1, support FROM RQ
    UNION ALL SELECT 'macro', {r('avg(p)', 6)}, {r('sum(hits) / sum(support)', 6)}, {r('avg(f)', 6)}, CAST(sum(support) AS BIGINT) FROM RQ""",
)
def _(spark, sf):
    n = F.col("n_chars")
    said = fx.table(spark, sf, "documents").select(
        F.col("lang").alias("y"), F.when(n % 5 == 0, "en").when(n % 7 == 0, "xx").otherwise(F.col("lang")).alias("pred")
    )
    return evaluation.macro_f1(said)


@register(
    "src_seed_labels",
    """SELECT p_name AS text, p_type AS category_name, 0.0::DOUBLE AS amount, 0::BIGINT AS day_of_week, 1::BIGINT AS day_of_month,
    'seed' AS category_source FROM part WHERE p_size % 10 <> 0 AND p_size % 7 <> 0""",
)
def _(spark, sf):
    """Write merchant labels of the given parts as a seed file and read it back."""
    from ..session import scratch_path
    from ..sources.statements import read_seed

    path = scratch_path(spark, "seed")
    part = fx.table(spark, sf, "part")
    part.select(
        F.when(F.col("p_size") % 10 == 0, "  ").otherwise(F.col("p_name")).alias("description"),
        F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_type")).alias("category"),
    ).write.option("header", True).option("emptyValue", "").csv(path)
    return texts(read_seed(spark, path))

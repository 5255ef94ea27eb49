"""Checks of single expressions over whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, keys, money, text
from ..schema import rnd
from ..sources import statements as st
from . import fixtures as fx
from . import register
from .fixtures import AS_OF
from .ledger import texts
from .sqltext import AS_OF as AS_OF_SQL
from .sqltext import E, M, PARSED, S, day, mkey, norm, parse_amount, parse_date, r

ROW = ("file", "pos")


@register("sc_normalise", f"SELECT doc_id, {norm('text')} AS normalised FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.normalise("text").alias("normalised"))


@register("sc_merchant_key", f"SELECT doc_id, {mkey('text')} AS key FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.merchant_key("text").alias("key"))


@register(
    "sc_parse_amount",
    f"""WITH {S}, X AS (SELECT file, pos, coalesce(amount, nullif(debit, ''), credit) AS raw FROM S)
    SELECT file, pos, {parse_amount('raw')} AS value FROM X""",
)
def _(spark, sf):
    raw = F.coalesce("amount", F.nullif("debit", F.lit("")), "credit")
    return fx.statements(spark, sf).select(*ROW, money.parse_amount(raw).alias("value"))


@register("sc_parse_date", f"WITH {S} SELECT file, pos, {day(parse_date('date'))} AS txn_date FROM S")
def _(spark, sf):
    return texts(fx.statements(spark, sf).select(*ROW, dates.parse_date("date").alias("txn_date")))


@register(
    "sc_date_in_range",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN CAST(l_shipdate AS DATE) > {AS_OF_SQL} + 3
    THEN 'Date ' || {day('l_shipdate')} || ' is in the future'
    WHEN CAST(l_shipdate AS DATE) - 3000 < {AS_OF_SQL} - 5478 THEN 'Date ' || {day('CAST(l_shipdate AS DATE) - 3000')} || ' is more than 15 years old'
    END AS reason FROM lineitem""",
)
def _(spark, sf):
    shipped = F.to_date("l_shipdate")
    future = dates.date_reject(shipped, AS_OF)
    old = dates.date_reject(F.date_sub(shipped, 3000), AS_OF)
    return texts(
        fx.table(spark, sf, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(future, old).alias("reason")
        )
    )


@register(
    "sc_row_type",
    f"WITH {PARSED} SELECT file, pos, CASE WHEN type_reason IS NULL THEN txn_type END AS txn_type, CASE WHEN type_reason IS NULL THEN num END AS value, type_reason AS reason FROM T1",
)
def _(spark, sf):
    typed = money.with_row_type(fx.statements(spark, sf))
    return typed.select(*ROW, "txn_type", "value", F.col("type_reason").alias("reason"))


@register("sc_reject_reason", f"WITH {PARSED} SELECT file, pos, reject_reason FROM T")
def _(spark, sf):
    return st.clean_rows(fx.statements(spark, sf), AS_OF).select(*ROW, "reject_reason")


@register(
    "sc_dom_distance",
    """SELECT o_orderkey, least(abs(day(o_orderdate) - (1 + o_custkey % 31)), 31 - abs(day(o_orderdate) - (1 + o_custkey % 31))) AS gap FROM orders""",
)
def _(spark, sf):
    gap = dates.dom_distance(F.dayofmonth("o_orderdate"), 1 + F.col("o_custkey") % 31)
    return fx.table(spark, sf, "orders").select("o_orderkey", gap.cast("bigint").alias("gap"))


@register(
    "sc_last_payday",
    """WITH D AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(1 + o_custkey % 31 AS INTEGER) AS p FROM orders),
    X AS (SELECT *, unnest(generate_series(0, 40)) AS back FROM D)
    SELECT o_orderkey, strftime(max(d - CAST(back AS INTEGER)), '%Y-%m-%d') AS last_payday FROM X
    WHERE day(d - CAST(back AS INTEGER)) = least(p, day(last_day(d - CAST(back AS INTEGER)))) GROUP BY ALL""",
)
def _(spark, sf):
    pay = dates.last_payday(F.to_date("o_orderdate"), 1 + F.col("o_custkey") % 31)
    return texts(fx.table(spark, sf, "orders").select("o_orderkey", pay.alias("last_payday")))


@register(
    "sc_cycle_position",
    """WITH D AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(1 + o_custkey % 31 AS INTEGER) AS p FROM orders),
    X AS (SELECT *, unnest(generate_series(0, 40)) AS back FROM D)
    SELECT o_orderkey, min(back) AS position, least(4, min(back) // 7 + 1) AS week FROM X
    WHERE day(d - CAST(back AS INTEGER)) = least(p, day(last_day(d - CAST(back AS INTEGER)))) GROUP BY ALL""",
)
def _(spark, sf):
    d, p = F.to_date("o_orderdate"), 1 + F.col("o_custkey") % 31
    return texts(
        fx.table(spark, sf, "orders").select(
            "o_orderkey", dates.cycle_position(d, p).alias("position"), dates.cycle_week(d, p).alias("week")
        )
    )


@register(
    "sc_cycle_week",
    """WITH D AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(1 + o_custkey % 31 AS INTEGER) AS p FROM orders),
    X AS (SELECT *, CASE WHEN day(d) >= least(p, day(last_day(d))) THEN date_trunc('month', d) ELSE date_trunc('month', d) - INTERVAL 1 MONTH END AS m FROM D),
    Y AS (SELECT *, CAST(m AS DATE) + CAST(least(p, day(last_day(m))) - 1 AS INTEGER) AS paid FROM X)
    SELECT o_orderkey, least(4, datediff('day', paid, d) // 7 + 1) AS week FROM Y""",
)
def _(spark, sf):
    d, p = F.to_date("o_orderdate"), 1 + F.col("o_custkey") % 31
    return texts(fx.table(spark, sf, "orders").select("o_orderkey", dates.cycle_week(d, p).alias("week")))


@register(
    "sc_import_hash",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sha256(concat_ws('|', CAST(l_suppkey AS VARCHAR), {day('l_shipdate')},
    {norm('l_shipinstruct')}, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), l_returnflag, CAST(l_linenumber AS VARCHAR))) AS hash
    FROM (SELECT *, l_linestatus || ' #' || l_returnflag || '!' AS l_shipinstruct FROM lineitem)""",
)
def _(spark, sf):
    words = F.concat("l_linestatus", F.lit(" #"), "l_returnflag", F.lit("!"))
    made = keys.import_hash("l_suppkey", F.to_date("l_shipdate"), words, "l_extendedprice", "l_returnflag", "l_linenumber")
    return texts(
        fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", made.alias("hash"))
    )


@register(
    "sc_message_hash",
    f"""WITH {M} SELECT event_id, CASE WHEN currency IS NOT NULL THEN 'email-fx-' ELSE 'email-' END
    || left(sha256(CAST(user_id AS VARCHAR) || '|' || message_key), 40) AS hash FROM M""",
)
def _(spark, sf):
    made = keys.message_hash("user_id", "message_key", F.col("currency").isNotNull())
    return fx.messages(spark, sf).select("event_id", made.alias("hash"))


@register(
    "sc_message_key",
    f"""WITH {M} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {day('sent_on')} || '|' || sender_addr || '|' || subject
    ELSE message_key END AS key FROM M""",
)
def _(spark, sf):
    missing = F.col("event_id") % 3 == 0
    own = F.when(~missing, F.concat(F.lit(" "), "message_key"))
    made = text.message_key(own, F.date_format("sent_on", "yyyy-MM-dd"), "sender_addr", "subject")
    return fx.messages(spark, sf).select("event_id", made.alias("key"))


_EDGE = "(^|[^\\p{{L}}\\p{{N}}_])({})([^\\p{{L}}\\p{{N}}_]|$)".format
_HEAD = "(^|[^\\p{{L}}\\p{{N}}_]){}".format


@register(
    "sc_currency",
    f"""SELECT doc_id, CASE WHEN regexp_matches(text, '{_EDGE("ZMW|ZK")}|{_HEAD("K")}[\\s\\p{{Z}}]?\\p{{Nd}}') THEN NULL
    WHEN regexp_matches(text, '\\$|{_EDGE("USD")}') THEN 'USD' WHEN regexp_matches(text, '€|{_EDGE("EUR")}') THEN 'EUR'
    WHEN regexp_matches(text, '£|{_EDGE("GBP")}') THEN 'GBP'
    WHEN regexp_matches(text, '{_EDGE("ZAR")}|{_HEAD("R")}[\\s\\p{{Z}}]?\\p{{Nd}}') THEN 'ZAR' END AS currency FROM documents""",
)
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.currency("text").alias("currency"))


@register(
    "sc_fx_tolerance",
    f"""WITH {E} SELECT txn_key, CASE WHEN category_name = 'purchase' THEN {r('CAST(amount AS DOUBLE) * 0.05')} ELSE 0.01::DOUBLE END AS tolerance FROM E""",
)
def _(spark, sf):
    made = rnd(text.fx_tolerance("amount", F.col("category_name") == "purchase"))
    return fx.events_ledger(spark, sf).select("txn_key", made.alias("tolerance"))


def _keyword_sql(clean: str) -> str:
    words = ", ".join(f"'{w}'" for w in text.RECEIPT_MERCHANTS)
    return (
        f"list_filter([{words}], lambda w: contains({clean}, w))"
    )


@register(
    "sc_emails_receipt",
    f"SELECT doc_id, len({_keyword_sql('n')}) > 0 AS emails FROM (SELECT doc_id, {norm('text')} AS n FROM documents)",
)
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.emails_receipt("text").alias("emails"))


@register(
    "sc_message_merchant",
    f"""WITH {M} SELECT event_id, keyword, CASE event_id % 3 WHEN 0 THEN 'Uber Receipts' WHEN 1 THEN 'Netflix' END AS merchant FROM M""",
)
def _(spark, sf):
    found = text.message_merchant("sender_name", "sender_addr", "subject")
    return fx.messages(spark, sf).withColumn("f", found).select("event_id", "f.keyword", "f.merchant")


@register(
    "sc_message_merchant_documents",
    f"""WITH X AS (SELECT doc_id, {_keyword_sql('n')} AS hits FROM (SELECT doc_id, {norm('text')} AS n FROM documents)),
    Y AS (SELECT doc_id, list_max(list_transform(hits, lambda h: length(h))) AS longest FROM X)
    SELECT doc_id, longest FROM Y""",
)
def _(spark, sf):
    found = F.length(text.receipt_keyword("text")).cast("bigint")
    return fx.table(spark, sf, "documents").select("doc_id", found.alias("longest"))


@register(
    "sc_free_trial",
    f"""WITH {M} SELECT event_id, event_id % 4 = 3 AND NOT coalesce(amount > 0, false) AS trial FROM M""",
)
def _(spark, sf):
    return fx.messages(spark, sf).select("event_id", text.free_trial("subject", "body_text", "amount").alias("trial"))


@register(
    "sc_sender",
    f"""WITH {M}, T AS (SELECT event_id, CAST(ts AS DATE) AS d FROM events) SELECT event_id, CASE WHEN event_id % 2 = 0 THEN sender_name ELSE '' END AS name,
    sender_addr AS address, {day('d')} AS sent_on FROM M JOIN T USING (event_id)""",
)
def _(spark, sf):
    n = F.col("event_id")
    head = F.when(n % 4 == 0, F.format_string('"%s" <%s>', "sender_name", F.upper("sender_addr"))).when(
        n % 2 == 0, F.format_string("%s <%s>", "sender_name", "sender_addr")
    ).otherwise(F.col("sender_addr"))
    local = F.col("ts") + F.expr("INTERVAL 2 HOURS")
    stamp = F.concat(F.date_format(local, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    rows = fx.messages(spark, sf).join(fx.table(spark, sf, "events").select("event_id", "ts"), "event_id")
    return texts(
        rows.withColumn("s", text.sender(head)).select(
            "event_id", "s.name", "s.address", text.sent_date(stamp).alias("sent_on")
        )
    )


@register(
    "sc_phone_mask",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN NULL
      WHEN c_custkey % 2 = 0 THEN '096 ••• ' || right('0000' || CAST(c_custkey % 10000 AS VARCHAR), 4) END AS mask FROM customer""",
)
def _(spark, sf):
    key = F.col("c_custkey")
    tail = F.lpad((key % 10000).cast("string"), 4, "0")
    raw = (
        F.when(key % 5 == 4, F.concat(F.lit("0123 "), tail))
        .when(key % 4 == 0, F.concat(F.lit("+260 961 23 "), tail))
        .otherwise(F.concat(F.lit("096 123 "), tail))
    )
    wallet = F.when(key % 2 == 0, "mtn").otherwise("airtel")
    return fx.table(spark, sf, "customer").select("c_custkey", text.phone_mask(raw, wallet).alias("mask"))

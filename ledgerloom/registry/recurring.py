"""Checks of the recurring-charge operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recurring
from . import fixtures as fx
from . import register
from .ledger import SPEND, texts
from .sqltext import L, day, mkey, r

KEYED = f"""KEYED AS (SELECT user_id, {mkey('description')} AS key, txn_date, txn_key, description, flat_amount AS amount
  FROM L WHERE {SPEND}),
GAPS AS (SELECT *, datediff('day', lag(txn_date) OVER (PARTITION BY user_id, key ORDER BY txn_date, txn_key), txn_date) AS gap
  FROM KEYED WHERE key <> ''),
REC0 AS (SELECT user_id, key, median(CAST(amount AS DOUBLE)) AS med, median(gap) AS mg, count(*) AS n,
  max(CAST(amount AS DOUBLE)) AS hi, min(CAST(amount AS DOUBLE)) AS lo, min(txn_date) AS a, max(txn_date) AS z,
  max_by(description, (txn_date, txn_key)) AS label, list_sort(list(txn_key)) AS txn_keys FROM GAPS GROUP BY ALL),
REC AS (SELECT user_id, key, label, {r('med')} AS monthly_amount, n AS occurrences, CAST(floor(mg) AS BIGINT) AS median_interval_days,
  {day('a')} AS first_seen, {day('z')} AS last_seen, {r('med * 12')} AS annualised, txn_keys FROM REC0
  WHERE n >= 3 AND med > 0 AND hi - med <= 0.15 * med AND med - lo <= 0.15 * med AND mg BETWEEN 24 AND 38)"""


@register("ag_recurring", f"WITH {L}, {KEYED} SELECT * REPLACE (array_to_string(txn_keys, ',') AS txn_keys) FROM REC")
def _(spark, sf):
    found = recurring.recurring(fx.ledger(spark, sf, flat=True))
    return texts(found.withColumn("txn_keys", F.array_join("txn_keys", ",")))


@register(
    "ag_recurring_flag",
    f"""WITH {L}, {KEYED} SELECT user_id, txn_key, txn_key IN (SELECT unnest(txn_keys) FROM REC) AS is_subscription FROM L""",
)
def _(spark, sf):
    ledger = fx.ledger(spark, sf, flat=True)
    return recurring.flag_recurring(ledger, recurring.recurring(ledger)).select("user_id", "txn_key", "is_subscription")


@register(
    "ag_recurring_summary",
    f"""WITH {L}, {KEYED} SELECT user_id, count(*) AS count, {r('sum(monthly_amount)')} AS monthly_total,
    {r('sum(monthly_amount) * 12')} AS annual_total FROM REC GROUP BY ALL""",
)
def _(spark, sf):
    return recurring.recurring_summary(recurring.recurring(fx.ledger(spark, sf, flat=True)))


@register(
    "wn_gaps",
    f"""WITH {L}, {KEYED}, D AS (SELECT user_id, key, txn_date, count(*) AS charges FROM KEYED WHERE key <> '' GROUP BY ALL)
    SELECT user_id, key, {day('txn_date')} AS txn_date, charges, charges - 1 AS same_day,
    CAST(datediff('day', lag(txn_date) OVER (PARTITION BY user_id, key ORDER BY txn_date), txn_date) AS BIGINT) AS gap FROM D""",
)
def _(spark, sf):
    return texts(recurring.charge_gaps(fx.ledger(spark, sf, flat=True)))

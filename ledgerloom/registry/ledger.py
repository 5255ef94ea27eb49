"""Checks of ledger views, sinks, category joins and the basic aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalise
from ..operators import cycles, insights, spend, views
from ..schema import rnd
from ..sources import sinks
from . import fixtures as fx
from . import register
from .fixtures import AS_OF
from .sqltext import AS_OF as AS_OF_SQL
from .sqltext import C, E, GOALS, L, N, P, day, last_payday, mkey, month, norm, r

KEY = "user_id, txn_key"


def texts(df: DataFrame) -> DataFrame:
    """Dates as text and decimals as doubles, for the comparison."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


SPEND = "txn_type = 'DEBIT' AND coalesce(category_name,'') <> 'Cash Withdrawal'"
D = "CAST({} AS DOUBLE)".format

# --- Joins with the category dimension ---------------------------------------


@register("jn_category_inner", f"WITH {L}, {C} SELECT {KEY}, category_name, category_type FROM L JOIN C USING (category_name)")
def _(spark, sf):
    return spend.with_category(fx.ledger(spark, sf), fx.category_dim(spark)).select(
        "user_id", "txn_key", "category_name", "category_type"
    )


@register("jn_category_left", f"WITH {L}, {C} SELECT {KEY}, L.category_name, category_type FROM L LEFT JOIN C USING (category_name)")
def _(spark, sf):
    return spend.with_category_left(fx.ledger(spark, sf), fx.category_dim(spark)).select(
        "user_id", "txn_key", "category_name", "category_type"
    )


@register(
    "jn_category_default",
    "WITH " + E + ", " + C + """ SELECT txn_key, coalesce(C.category_name, 'Uncategorised') AS category_name
    FROM (SELECT txn_key, CASE description WHEN 'click' THEN 'Groceries' WHEN 'view' THEN 'Transport'
      ELSE description END AS name FROM E) LEFT JOIN C ON name = C.category_name""",
)
def _(spark, sf):
    named = fx.events_ledger(spark, sf).withColumn(
        "category_name",
        F.when(F.col("description") == "click", "Groceries")
        .when(F.col("description") == "view", "Transport")
        .otherwise(F.col("description")),
    )
    return spend.with_known_category(named, fx.category_dim(spark)).select("txn_key", "category_name")


@register("jn_spend_anti", f"WITH {L} SELECT {KEY} FROM L WHERE coalesce(category_name,'') NOT IN ('Cash Withdrawal')")
def _(spark, sf):
    return spend.without_withdrawals(fx.ledger(spark, sf)).select("user_id", "txn_key")


@register("sc_is_spend", f"WITH {L} SELECT {KEY}, ({SPEND}) AS is_spend FROM L")
def _(spark, sf):
    return fx.ledger(spark, sf).select("user_id", "txn_key", spend.is_spend().alias("is_spend"))


# --- Aggregates -----------------------------------------------------------------

MONTHLY = f"""SPENT AS (SELECT user_id, category_name, CAST(date_trunc('month', txn_date) AS DATE) AS month,
  sum(amount) AS amount FROM L JOIN C USING (category_name) WHERE {SPEND} GROUP BY ALL)"""

GRID = f"""{MONTHLY}, BOUNDS AS (SELECT user_id, min(month) AS lo, max(month) AS hi FROM SPENT GROUP BY ALL),
MONTHS AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM BOUNDS),
GRID AS (SELECT k.user_id, k.category_name, m.month, coalesce(CAST(s.amount AS DOUBLE), 0) AS amount
  FROM (SELECT DISTINCT user_id, category_name FROM SPENT) k JOIN MONTHS m USING (user_id)
  LEFT JOIN SPENT s ON s.user_id = k.user_id AND s.category_name = k.category_name AND s.month = m.month)"""


@register(
    "ag_actual_spend",
    f"WITH {L}, {C}, {MONTHLY} SELECT user_id, {month('month')} AS month, category_name, {r('amount')} AS spent FROM SPENT",
)
def _(spark, sf):
    return spend.actual_spend(fx.ledger(spark, sf), fx.category_dim(spark))


@register("sc_month_key", f"WITH {L} SELECT {KEY}, {month('txn_date')} AS month FROM L")
def _(spark, sf):
    return fx.ledger(spark, sf).select("user_id", "txn_key", spend.month_key("txn_date").alias("month"))


MONTH_TOTALS = f"""TOTALS AS (SELECT user_id, {month('txn_date')} AS month,
  sum(CASE WHEN txn_type = 'CREDIT' THEN amount ELSE 0 END) AS income,
  sum(CASE WHEN txn_type = 'CREDIT' THEN 0 ELSE amount END) AS expenditure
  FROM L WHERE coalesce(category_name,'') <> 'Cash Withdrawal' GROUP BY ALL)"""


@register(
    "ag_month_totals",
    f"""WITH {L}, {MONTH_TOTALS} SELECT user_id, month, {r('income')} AS income, {r('expenditure')} AS expenditure,
    {r('income - expenditure')} AS net FROM TOTALS""",
)
def _(spark, sf):
    return spend.month_totals(fx.ledger(spark, sf))


@register(
    "ag_monthly_matrix",
    f"""WITH {L}, {C}, {GRID} SELECT user_id, category_name, {day('month')} AS month, amount FROM GRID
    WHERE month < date_trunc('month', {AS_OF_SQL})""",
)
def _(spark, sf):
    spent = spend.monthly_spend(fx.ledger(spark, sf), fx.category_dim(spark))
    return texts(spend.month_grid(spent, AS_OF))


@register("jn_month_grid", f"WITH {L}, {C}, {GRID} SELECT user_id, category_name, {day('month')} AS month, amount FROM GRID")
def _(spark, sf):
    return texts(spend.month_grid(spend.monthly_spend(fx.ledger(spark, sf), fx.category_dim(spark))))


@register(
    "ag_monthly_matrix_wide",
    f"""WITH {L}, {C}, {GRID} SELECT user_id, {day('month')} AS month,
    sum(amount) FILTER (category_name = 'Groceries') AS Groceries,
    sum(amount) FILTER (category_name = 'Transport') AS Transport,
    sum(amount) FILTER (category_name = 'Dining Out') AS Dining_Out
    FROM GRID WHERE month < date_trunc('month', {AS_OF_SQL}) GROUP BY ALL""",
)
def _(spark, sf):
    spent = spend.monthly_spend(fx.ledger(spark, sf), fx.category_dim(spark))
    wide = spend.month_matrix_wide(spent, fx.category_dim(spark), AS_OF)
    return texts(wide.select("user_id", "month", "Groceries", "Transport", F.col("Dining Out").alias("Dining_Out")))


@register(
    "wn_trailing3",
    f"""WITH {L}, {C}, {GRID} SELECT user_id, category_name, {day('month')} AS month, amount,
    {r('avg(amount) OVER w')} AS mean3, {r('median(amount) OVER w')} AS median3, (sum(amount) OVER w = 0) AS dormant
    FROM GRID WINDOW w AS (PARTITION BY user_id, category_name ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf):
    spent = spend.monthly_spend(fx.ledger(spark, sf), fx.category_dim(spark))
    return texts(spend.trailing3(spend.month_grid(spent)))


@register(
    "ag_learning_status",
    f"""WITH {L}, A AS (SELECT user_id, min(txn_date) AS a, max(txn_date) AS z, count(*) AS n FROM L GROUP BY ALL),
    B AS (SELECT *, datediff('day', a, greatest(z, {AS_OF_SQL})) AS days FROM A)
    SELECT user_id, {day('a')} AS started_on, {day('a + 30')} AS completes_on, days AS days_observed, n AS transactions,
    {r('100 * least(1, days / 30, n / 15)', 1)} AS progress, (days >= 30 AND n >= 15) AS complete,
    CASE WHEN days >= 30 AND n >= 15 THEN 'complete' WHEN days < 30 THEN 'needs_days' ELSE 'needs_transactions' END AS state
    FROM B""",
)
def _(spark, sf):
    return texts(spend.learning_status(fx.ledger(spark, sf), AS_OF))


@register(
    "ag_savings_pool",
    f"""WITH {L}, A AS (SELECT user_id, sum(CASE WHEN txn_type = 'CREDIT' THEN amount ELSE 0 END) AS i,
      sum(CASE WHEN txn_type = 'CREDIT' THEN 0 ELSE amount END) AS e
      FROM L WHERE coalesce(category_name,'') <> 'Cash Withdrawal' GROUP BY ALL)
    SELECT user_id, {r('i')} AS income, {r('e')} AS expenses, {r('greatest(0, i - e)')} AS pool FROM A""",
)
def _(spark, sf):
    return spend.savings_pool(fx.ledger(spark, sf))


@register("available_months", f"WITH {L} SELECT DISTINCT user_id, {month('txn_date')} AS month FROM L")
def _(spark, sf):
    return spend.available_months(fx.ledger(spark, sf))


def _hex(start: int) -> str:
    return f"sum(CAST('0x' || substr(h, {start}, 12) AS BIGINT))"


SIGNATURE = f"""H AS (SELECT user_id, md5(concat_ws('|', txn_key, coalesce(category_name,''), CAST(amount AS VARCHAR),
  {day('txn_date')})) AS h FROM L WHERE txn_type = 'DEBIT')"""


@register(
    "ag_signature",
    f"""WITH {L}, {SIGNATURE} SELECT user_id, md5(concat_ws('|', CAST(count(*) AS VARCHAR),
    CAST({_hex(1)} AS VARCHAR), CAST({_hex(13)} AS VARCHAR), '2001-08')) AS signature FROM H GROUP BY user_id""",
)
def _(spark, sf):
    return spend.forecast_signature(fx.ledger(spark, sf), AS_OF)


@register(
    "ag_signature_changed",
    f"""WITH {L} SELECT DISTINCT user_id FROM L WHERE txn_type = 'DEBIT'
    AND txn_date = (SELECT max(txn_date) FROM L WHERE txn_type = 'DEBIT')""",
)
def _(spark, sf):
    ledger = fx.ledger(spark, sf)
    newest = ledger.filter(spend.is_debit()).agg(F.max("txn_date").alias("txn_date"))
    before = ledger.join(newest, "txn_date", "left_anti")
    return spend.changed_accounts(spend.forecast_signature(before, AS_OF), spend.forecast_signature(ledger, AS_OF))


CYCLES = f"""DAYS AS (SELECT user_id, txn_date, category_type, sum(amount) AS amount FROM L JOIN C USING (category_name)
  WHERE {SPEND} GROUP BY ALL),
CY AS (SELECT d.user_id, {last_payday('txn_date', 'salary_day')} AS start, txn_date, amount, category_type,
  {last_payday(AS_OF_SQL, 'salary_day')} AS cur FROM DAYS d JOIN P USING (user_id)),
PC AS (SELECT user_id, start, cur,
  sum(CASE WHEN w = 1 THEN amount ELSE 0 END) AS w1, sum(CASE WHEN w = 2 THEN amount ELSE 0 END) AS w2,
  sum(CASE WHEN w = 3 THEN amount ELSE 0 END) AS w3, sum(CASE WHEN w = 4 THEN amount ELSE 0 END) AS w4,
  sum(CASE WHEN category_type = 'ESSENTIAL' THEN amount ELSE 0 END) AS ess,
  sum(CASE WHEN category_type = 'ESSENTIAL' THEN 0 ELSE amount END) AS disc
  FROM (SELECT *, least(4, datediff('day', start, txn_date) // 7 + 1) AS w FROM CY) GROUP BY ALL),
HASDONE AS (SELECT user_id, bool_or(start <> cur) AS done FROM PC GROUP BY ALL),
USED AS (SELECT PC.*, done FROM PC JOIN HASDONE USING (user_id) WHERE NOT done OR start <> cur),
CP0 AS (SELECT user_id, {r('CAST(sum(w1) AS DOUBLE) / count(*)')} AS week1, {r('CAST(sum(w2) AS DOUBLE) / count(*)')} AS week2,
  {r('CAST(sum(w3) AS DOUBLE) / count(*)')} AS week3, {r('CAST(sum(w4) AS DOUBLE) / count(*)')} AS week4,
  count(*) AS cycles, NOT bool_or(done) AS partial_only, CAST(sum(ess) AS DOUBLE) / count(*) AS ess,
  CAST(sum(disc) AS DOUBLE) / count(*) AS disc FROM USED GROUP BY ALL),
CYCLE AS (SELECT user_id, week1, week2, week3, week4, {r('week1+week2+week3+week4')} AS total, cycles, partial_only,
  {r('week1/(week1+week2+week3+week4)*100', 1)} AS surge_share, {r('ess')} AS essential, {r('disc')} AS discretionary,
  {r('disc/(week1+week2+week3+week4)*100', 1)} AS discretionary_share,
  round(week1/(week1+week2+week3+week4)*100, 8) >= 35 AS has_surge FROM CP0)"""


@register("ag_cycle_profile", f"WITH {L}, {C}, {P}, {CYCLES} SELECT * FROM CYCLE")
def _(spark, sf):
    return cycles.cycle_profile(fx.ledger(spark, sf), fx.category_dim(spark), fx.profile(spark, sf), AS_OF)


@register(
    "so_cycle_chart",
    f"""WITH {L}, {C}, {P}, {CYCLES} SELECT user_id, CAST(replace(week, 'week', '') AS BIGINT) AS week, amount
    FROM (UNPIVOT (SELECT user_id, week1, week2, week3, week4 FROM CYCLE) ON week1, week2, week3, week4
    INTO NAME week VALUE amount)""",
)
def _(spark, sf):
    profile = cycles.cycle_profile(fx.ledger(spark, sf), fx.category_dim(spark), fx.profile(spark, sf), AS_OF)
    return texts(cycles.cycle_chart(profile))


@register(
    "wn_detect_salary",
    f"""WITH {L}, {P}, K AS (SELECT L.user_id, txn_key, {month('txn_date')} AS m,
      least(abs(day(txn_date) - salary_day), 31 - abs(day(txn_date) - salary_day)) AS dd, abs(amount - salary_credit) AS gap,
      abs(amount - salary_credit) <= salary_credit * 0.15 AS near
      FROM L JOIN P USING (user_id) WHERE txn_type = 'CREDIT')
    SELECT user_id, txn_key FROM K WHERE near AND dd <= 7
    QUALIFY row_number() OVER (PARTITION BY user_id, m ORDER BY dd, gap, txn_key) = 1""",
)
def _(spark, sf):
    flagged = cycles.detect_salary(fx.ledger(spark, sf), fx.profile(spark, sf, "40000"))
    return flagged.filter("is_salary").select("user_id", "txn_key")


@register(
    "wn_detect_salary_kept",
    f"""WITH {L}, {P}, K AS (SELECT L.user_id, txn_key, txn_date, {month('txn_date')} AS m,
      least(abs(day(txn_date) - salary_day), 31 - abs(day(txn_date) - salary_day)) AS dd, abs(amount - salary_credit) AS gap,
      abs(amount - salary_credit) <= salary_credit * 0.15 AS near, amount > 100000 AS old
      FROM L JOIN P USING (user_id) WHERE txn_type = 'CREDIT'),
    NEW AS (SELECT * FROM K WHERE near AND dd <= 7
      QUALIFY row_number() OVER (PARTITION BY user_id, m ORDER BY dd, gap, txn_key) = 1),
    KEPT AS (SELECT * FROM K WHERE old AND (user_id, m) NOT IN (SELECT (user_id, m) FROM NEW)
      QUALIFY row_number() OVER (PARTITION BY user_id, m ORDER BY txn_date DESC, txn_key DESC) = 1)
    SELECT user_id, txn_key FROM NEW UNION ALL SELECT user_id, txn_key FROM KEPT""",
)
def _(spark, sf):
    before = fx.ledger(spark, sf).withColumn("is_salary", (F.col("txn_type") == "CREDIT") & (F.col("amount") > 100000))
    return cycles.detect_salary(before, fx.profile(spark, sf, "40000")).filter("is_salary").select("user_id", "txn_key")


# --- Insights --------------------------------------------------------------------

_TRIPS = "('Groceries','Shopping','Personal Care')"


@register(
    "ag_high_frequency",
    f"""WITH {E} SELECT user_id, {month('txn_date')} AS month, {mkey('description')} AS key,
    min_by(description, (txn_date, txn_key)) AS merchant, count(*) AS visits, {r('sum(amount)')} AS total
    FROM E WHERE txn_type = 'DEBIT' GROUP BY ALL HAVING count(*) > 4""",
)
def _(spark, sf):
    from ..params import Params

    trips = Params(trip_categories=("view", "click", "purchase", "error"))
    return insights.high_frequency(fx.events_ledger(spark, sf), trips)


HIGH = f"""HIGH AS (SELECT user_id, {month('txn_date')} AS month, {mkey('description')} AS key,
  min_by(description, (txn_date, txn_key)) AS merchant, count(*) AS visits, {r('sum(amount)')} AS total
  FROM N WHERE {SPEND} AND category_name IN {_TRIPS} GROUP BY ALL HAVING count(*) > 4)"""

CONC = f"""R0 AS (SELECT user_id, {month('txn_date')} AS month, category_name, {mkey('description')} AS key, amount,
    description, txn_date, txn_key FROM N JOIN C USING (category_name)
    WHERE {SPEND} AND category_type = 'DISCRETIONARY' AND category_name <> 'Uncategorised'),
  MN AS (SELECT user_id, month, key, min_by(description, (txn_date, txn_key)) AS merchant FROM R0 GROUP BY ALL),
  PM AS (SELECT user_id, month, category_name, key, sum(amount) AS spend, count(*) AS n FROM R0 GROUP BY ALL),
  PCAT AS (SELECT user_id, month, category_name, sum(spend) AS total, sum(n) AS n, max(spend) AS spend,
    max_by(key, (spend, key)) AS key FROM PM GROUP BY ALL),
  CONC AS (SELECT user_id, month, category_name, merchant, 'shop_around' AS variant, {r('spend')} AS spend,
    {r('CAST(spend AS DOUBLE) / CAST(total AS DOUBLE) * 100', 1)} AS share, CAST(0 AS DOUBLE) AS annual
    FROM PCAT JOIN MN USING (user_id, month, key) WHERE n >= 2 AND total > 0
    AND round(CAST(spend AS DOUBLE) / CAST(total AS DOUBLE), 8) > 0.5)"""


@register("ag_concentration", f"WITH {L}, {N}, {C}, {CONC} SELECT * FROM CONC")
def _(spark, sf):
    return insights.concentration(fx.ledger(spark, sf, named=True), fx.category_dim(spark))


AUDIT = f"""AUD0 AS (SELECT user_id, {month('txn_date')} AS month, count(*) AS charges, sum(amount) AS total
    FROM N WHERE txn_type = 'DEBIT' AND {mkey('description')} = 'netflix com' GROUP BY ALL HAVING count(*) >= 2),
  AUD AS (SELECT user_id, month, charges, {r('total')} AS total,
    {r('CAST(total AS DOUBLE) / CAST(salary_amount AS DOUBLE) * 100', 1)} AS salary_share
    FROM AUD0 JOIN P USING (user_id) WHERE CAST(total AS DOUBLE) >= 0.05 * salary_amount)"""


def _subscribed(ledger: DataFrame) -> DataFrame:
    from ..functions.text import merchant_key

    return ledger.withColumn("is_subscription", merchant_key("description") == "netflix com")


@register("ag_subscription_audit", f"WITH {L}, {N}, {P}, {AUDIT} SELECT * FROM AUD")
def _(spark, sf):
    return insights.subscription_audit(_subscribed(fx.ledger(spark, sf, named=True)), fx.profile(spark, sf))


@register(
    "bd_suggestions",
    f"""WITH {L}, {N}, {C}, {P}, {CONC}, {HIGH}, {AUDIT},
    FL AS (SELECT DISTINCT user_id, month, key FROM R0 WHERE key = 'netflix com'),
    CV AS (SELECT c.user_id, c.month, c.category_name, c.merchant, c.spend,
      CASE WHEN p.key = 'netflix com' THEN 'subscription' ELSE 'shop_around' END AS variant
      FROM CONC c JOIN PCAT p USING (user_id, month, category_name)),
    U AS (SELECT user_id, month, 'warning' AS severity, 'concentration:' || variant AS kind,
        category_name || '/' || merchant AS subject, spend AS amount FROM CV
      UNION ALL SELECT user_id, month, 'warning', 'subscription_audit', CAST(charges AS VARCHAR) || ' charges', total FROM AUD
      UNION ALL SELECT user_id, month, 'info', 'high_frequency', merchant, total FROM HIGH)
    SELECT *, CASE severity WHEN 'warning' THEN 1 ELSE 2 END AS priority FROM U""",
)
def _(spark, sf):
    ledger = _subscribed(fx.ledger(spark, sf, named=True))
    return texts(insights.suggestions(ledger, fx.category_dim(spark), fx.profile(spark, sf)))


ESS = f"""ESS AS (SELECT user_id, {month('txn_date')} AS month, category_name, sum(amount) AS amount
  FROM L JOIN C USING (category_name) WHERE txn_type = 'DEBIT' AND category_type = 'ESSENTIAL' GROUP BY ALL)"""


def _pairs(spark, sf):
    return (
        fx.table(spark, sf, "nation")
        .select(F.floor(F.col("n_nationkey") / 2).alias("k"))
        .distinct()
        .select((F.col("k") * 2).alias("a"), (F.col("k") * 2 + 1).alias("b"))
    )


_HOUSE = """PAIRED AS (SELECT (user_id // 2) * 2 AS a, (user_id // 2) * 2 + 1 AS b, user_id, month, category_name, amount FROM ESS)"""
_HSUM = """sum(CASE WHEN user_id = a THEN amount ELSE 0 END) AS x, sum(CASE WHEN user_id = b THEN amount ELSE 0 END) AS y"""


@register(
    "ag_household",
    f"""WITH {L}, {C}, {ESS}, {_HOUSE}, G AS (SELECT a, b, month, {_HSUM} FROM PAIRED GROUP BY ALL)
    SELECT a, b, month, {r('x')} AS a_spend, {r('y')} AS b_spend, {r('CAST(x + y AS DOUBLE) / 2')} AS fair_share,
    {r('CAST(greatest(x, y) AS DOUBLE) - CAST(x + y AS DOUBLE) / 2')} AS owes, CASE WHEN x > y THEN b ELSE a END AS ower FROM G""",
)
def _(spark, sf):
    return insights.household(fx.ledger(spark, sf), fx.category_dim(spark), _pairs(spark, sf))


@register(
    "jn_household",
    f"""WITH {L}, {C}, {ESS}, {_HOUSE}, G AS (SELECT a, b, month, category_name, {_HSUM} FROM PAIRED GROUP BY ALL)
    SELECT a, b, month, category_name, {r('x')} AS a_spent, {r('y')} AS b_spent, {r('x + y')} AS total_spent FROM G""",
)
def _(spark, sf):
    return insights.household_split(fx.ledger(spark, sf), fx.category_dim(spark), _pairs(spark, sf))


CHANNEL = """CASE WHEN starts_with(coalesce(import_hash,''), 'sync-momo-mtn-') OR contains(lower(description), 'mtn momo')
  OR contains(lower(description), 'momo pay') THEN 'mtn'
  WHEN starts_with(coalesce(import_hash,''), 'sync-momo-airtel-') OR contains(lower(description), 'airtel money') THEN 'airtel'
  WHEN starts_with(coalesce(import_hash,''), 'manual-') THEN 'cash' ELSE 'bank' END"""


@register("sc_channel", f"WITH {L}, {N} SELECT {KEY}, {CHANNEL} AS channel FROM N")
def _(spark, sf):
    from ..functions.text import channel

    return fx.ledger(spark, sf, named=True).select(
        "user_id", "txn_key", channel("import_hash", "description").alias("channel")
    )


@register(
    "ag_channels",
    f"""WITH {L}, {N}, G AS (SELECT user_id, {month('txn_date')} AS month, {CHANNEL} AS channel, sum(amount) AS total,
      count(*) AS n FROM N WHERE {SPEND} GROUP BY ALL HAVING sum(amount) > 0)
    SELECT user_id, month, channel, {r('total')} AS total, n,
    {r('CAST(total AS DOUBLE) / CAST(sum(total) OVER (PARTITION BY user_id, month) AS DOUBLE) * 100', 1)} AS share FROM G""",
)
def _(spark, sf):
    return insights.channel_totals(fx.ledger(spark, sf, named=True))


def _topn(by: str) -> str:
    return f"""WITH {L}, {N}, G AS (SELECT user_id, {month('txn_date')} AS month, coalesce({by}, 'Uncategorised') AS name,
      sum(amount) AS total FROM N WHERE {SPEND} GROUP BY ALL),
    H AS (SELECT *, sum(total) OVER (PARTITION BY user_id, month) AS grand,
      row_number() OVER (PARTITION BY user_id, month ORDER BY total DESC, name) AS position FROM G)
    SELECT user_id, month, position, name, {r('total')} AS total,
    {r('CAST(total AS DOUBLE) / CAST(grand AS DOUBLE) * 100', 1)} AS share FROM H WHERE position <= 3"""


@register("ag_topn", _topn("category_name"))
def _(spark, sf):
    return texts(views.top_spending(fx.ledger(spark, sf, named=True)))


@register("ag_topn_places", _topn("description"))
def _(spark, sf):
    return texts(views.top_spending(fx.ledger(spark, sf, named=True), by="description"))


# --- Lists and slices ---------------------------------------------------------------

_MATCH = "contains(lower(description), 'blue') AND category_name = 'Groceries'"


@register(
    "ledger_list",
    f"""WITH {L}, F AS (SELECT * FROM L WHERE {_MATCH}),
    K AS (SELECT user_id, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages FROM F GROUP BY ALL),
    R AS (SELECT user_id, txn_key, row_number() OVER (PARTITION BY user_id ORDER BY txn_date DESC, txn_key DESC) AS position FROM F)
    SELECT user_id, txn_key, position, total_pages FROM R JOIN K USING (user_id) WHERE position <= 50""",
)
def _(spark, sf):
    page = views.ledger_page(fx.ledger(spark, sf), category="Groceries", q="BLUE")
    return texts(page.select("user_id", "txn_key", "position", "total_pages"))


@register(
    "ledger_list_after",
    f"""WITH {L}, R AS (SELECT user_id, txn_key, row_number() OVER (PARTITION BY user_id ORDER BY txn_date DESC, txn_key DESC)
      AS position FROM L) SELECT user_id, txn_key, position - 50 AS position FROM R WHERE position BETWEEN 51 AND 100""",
)
def _(spark, sf):
    ledger = fx.ledger(spark, sf)
    last = views.rank_latest(ledger, ["user_id"], views.newest_first(), 50).filter("position = 50")
    after = last.select("user_id", F.col("txn_date").alias("last_date"), F.col("txn_key").alias("last_key"))
    return texts(views.page_after(ledger, after).select("user_id", "txn_key", "position"))


ITEMS = """ITEMS AS (SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
  CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS txn_key, p_name AS item_name,
  CAST(p_retailprice AS DECIMAL(18,2)) AS amount, CASE WHEN l_quantity <= 40 THEN CAST(l_quantity AS INTEGER) END AS quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F')"""


@register(
    "ledger_with_items",
    f"""WITH {L}, {ITEMS}, R AS (SELECT user_id, txn_key, row_number() OVER (PARTITION BY user_id
      ORDER BY txn_date DESC, txn_key DESC) AS position FROM L)
    SELECT R.user_id, R.txn_key, count(item_name) AS n_items, coalesce(CAST(sum(amount) AS DOUBLE), 0) AS items_total
    FROM R LEFT JOIN ITEMS USING (txn_key) WHERE position <= 50 GROUP BY ALL""",
)
def _(spark, sf):
    page = views.ledger_page(fx.ledger(spark, sf)).select("user_id", "txn_key")
    nested = views.with_items(page, fx.receipt_items(spark, sf))
    total = F.aggregate("items", F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + x["amount"]).cast("decimal(18,2)"))
    return nested.select(
        "user_id",
        "txn_key",
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce(total.cast("double"), F.lit(0.0)).alias("items_total"),
    )


@register(
    "unitemised",
    f"""WITH {L}, {N}, {ITEMS}, A AS (SELECT * FROM N WHERE txn_type = 'DEBIT' AND txn_key NOT IN (SELECT txn_key FROM ITEMS)
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY txn_date DESC, txn_key DESC) <= 40)
    SELECT user_id, txn_key, row_number() OVER (PARTITION BY user_id ORDER BY txn_date DESC, txn_key DESC) AS position
    FROM A WHERE regexp_matches(lower(description), 'shoprite|netflix|kfc|airtel')
    QUALIFY position <= 15""",
)
def _(spark, sf):
    rows = views.unitemised(fx.ledger(spark, sf, named=True), fx.receipt_items(spark, sf))
    return texts(rows.select("user_id", "txn_key", "position"))


@register(
    "period_slice",
    f"""WITH {L}, {N} SELECT {KEY} FROM N WHERE {SPEND} AND txn_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
    AND category_name IN ('Groceries','Shopping') AND {CHANNEL} = 'bank'
    AND contains(' ' || {norm('description')} || ' ', ' kfc cairo ')""",
)
def _(spark, sf):
    return views.period_slice(
        fx.ledger(spark, sf, named=True),
        dt.date(2000, 1, 1),
        dt.date(2000, 12, 31),
        ("Groceries", "Shopping"),
        "bank",
        "kfc cairo",
    ).select("user_id", "txn_key")


@register(
    "wn_rank_latest",
    f"""WITH {L} SELECT {KEY}, row_number() OVER (PARTITION BY user_id ORDER BY txn_date DESC, txn_key DESC) AS position
    FROM L QUALIFY position <= 5""",
)
def _(spark, sf):
    rows = views.rank_latest(fx.ledger(spark, sf), ["user_id"], views.newest_first(), 5)
    return texts(rows.select("user_id", "txn_key", "position"))


@register("sc_search", f"WITH {L} SELECT {KEY} FROM L WHERE contains(lower(description), lower('E B')) OR contains(description, '%')")
def _(spark, sf):
    from ..functions.text import search

    rows = fx.ledger(spark, sf)
    return rows.filter(search("description", F.lit("E B")) | search("description", F.lit("%"))).select("user_id", "txn_key")


@register("jn_has_items", f"WITH {L}, {ITEMS} SELECT {KEY}, txn_key IN (SELECT txn_key FROM ITEMS) AS has_items FROM L")
def _(spark, sf):
    return views.has_items(fx.ledger(spark, sf), fx.receipt_items(spark, sf)).select("user_id", "txn_key", "has_items")


@register(
    "jn_items_txn",
    f"""WITH {L}, {ITEMS} SELECT txn_key, L.user_id, {day('txn_date')} AS txn_date, description, item_name,
    CAST(ITEMS.amount AS DOUBLE) AS amount FROM ITEMS JOIN L USING (txn_key)""",
)
def _(spark, sf):
    rows = views.items_with_ledger(fx.receipt_items(spark, sf), fx.ledger(spark, sf))
    return texts(rows.select("txn_key", "user_id", "txn_date", "description", "item_name", "amount"))


@register(
    "se_distinct_terms",
    f"""WITH {L}, {N}, {ITEMS} SELECT DISTINCT user_id, {norm('description')} AS term FROM N WHERE txn_type = 'DEBIT'
    UNION SELECT user_id, {norm('item_name')} FROM ITEMS JOIN L USING (txn_key)""",
)
def _(spark, sf):
    ledger = fx.ledger(spark, sf, named=True)
    places = ledger.filter(spend.is_debit()).select("user_id", normalise("description").alias("term"))
    items = fx.receipt_items(spark, sf).join(ledger.select("txn_key", "user_id"), "txn_key").select(
        "user_id", normalise("item_name").alias("term")
    )
    return places.unionByName(items).distinct()


# --- Validation ---------------------------------------------------------------------

@register(
    "goal_validate",
    f"""SELECT c_custkey AS goal_id, CASE
      WHEN c_custkey % 9 = 0 THEN 'name missing' WHEN c_custkey % 9 = 1 THEN 'name too long'
      WHEN c_custkey % 9 = 2 THEN 'target is not a number'
      WHEN c_acctbal <= 0 THEN 'target must be positive'
      WHEN c_custkey % 9 = 3 THEN 'date invalid'
      WHEN make_date(2001 + c_custkey % 6, 1 + c_custkey % 12, 15) <= {AS_OF_SQL} THEN 'date not in the future'
      END AS reason FROM customer""",
)
def _(spark, sf):
    key = F.col("c_custkey")
    day_text = F.date_format(
        F.make_date((2001 + key % 6).cast("int"), (1 + key % 12).cast("int"), F.lit(15)), "yyyy-MM-dd"
    )
    forms = fx.table(spark, sf, "customer").select(
        key.alias("goal_id"),
        F.when(key % 9 == 0, "   ").when(key % 9 == 1, F.repeat(F.lit("x"), 81)).otherwise(F.col("c_name")).alias("goal_name"),
        F.when(key % 9 == 2, "nan").otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("target_amount"),
        F.when(key % 9 == 3, "2001-02-31").otherwise(day_text).alias("target_date"),
    )
    return views.validate_goals(forms, AS_OF).select("goal_id", "reason")


@register(
    "item_validate",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 10 = 0 THEN 'name missing'
      WHEN l_suppkey % 10 = 1 OR l_extendedprice > 100000 THEN 'amount out of range'
      WHEN l_quantity > 40 THEN 'quantity out of range' END AS reason FROM lineitem""",
)
def _(spark, sf):
    supp = F.col("l_suppkey")
    forms = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(supp % 10 == 0, " ").otherwise("thing").alias("item_name"),
        F.when(supp % 10 == 1, "inf").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("amount"),
        F.when(F.col("l_quantity") > 40, "1000").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("quantity"),
    )
    rows = views.validate_items(forms)
    return texts(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "reason"))


@register(
    "profile_validate",
    """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 7 = 0 THEN 'name invalid'
      WHEN c_custkey % 7 = 1 THEN 'salary is not a number' WHEN c_acctbal <= 0 THEN 'salary must be positive'
      WHEN c_custkey % 40 NOT BETWEEN 1 AND 31 THEN 'pay day out of range' END AS reason,
      (reason IS NULL AND (c_custkey % 2 = 1 OR c_custkey % 40 <> 25)) AS income_changed FROM customer""",
)
def _(spark, sf):
    key, pay = F.col("c_custkey"), F.col("c_acctbal").cast("decimal(18,2)")
    customers = fx.table(spark, sf, "customer")
    old = customers.select(
        key.alias("user_id"),
        F.when(key % 2 == 1, pay + 10).otherwise(pay).alias("salary_amount"),
        F.lit(25).alias("salary_day"),
    )
    new = customers.select(
        key.alias("user_id"),
        F.when(key % 7 == 0, " ").otherwise(F.col("c_name")).alias("full_name"),
        F.when(key % 7 == 1, "abc").otherwise(pay.cast("string")).alias("salary_amount"),
        (key % 40).cast("string").alias("salary_day"),
    )
    return views.validate_profiles(old, new).select("user_id", "reason", "income_changed")


# --- Sinks ----------------------------------------------------------------------------

_CUT_OLD, _CUT_NEW = "DATE '2000-06-01'", "DATE '2000-01-01'"


def _halves(spark, sf):
    """The ledger up to a day, and a batch that overlaps its last months."""
    rows = fx.ledger(spark, sf).filter(F.col("import_hash").isNotNull())
    return rows.filter(F.col("txn_date") < dt.date(2000, 6, 1)), rows.filter(F.col("txn_date") >= dt.date(2000, 1, 1))


_NEW = f"""OLD AS (SELECT user_id, import_hash FROM L WHERE import_hash IS NOT NULL AND txn_date < {_CUT_OLD}),
BATCH AS (SELECT * FROM L WHERE import_hash IS NOT NULL AND txn_date >= {_CUT_NEW}),
NEW AS (SELECT DISTINCT user_id, txn_key, import_hash FROM BATCH WHERE (user_id, import_hash) NOT IN
  (SELECT (user_id, import_hash) FROM OLD))"""


@register(
    "snk_ledger_append",
    f"""WITH {L}, {_NEW} SELECT b.user_id, b.n AS rows, coalesce(a.n, 0) AS imported, b.n - coalesce(a.n, 0) AS duplicates
    FROM (SELECT user_id, count(*) AS n FROM BATCH GROUP BY ALL) b
    LEFT JOIN (SELECT user_id, count(*) AS n FROM NEW GROUP BY ALL) a USING (user_id)""",
)
def _(spark, sf):
    ledger, batch = _halves(spark, sf)
    return sinks.append_counts(batch, ledger)


@register(
    "jn_dedup_anti",
    f"WITH {L}, {_NEW} SELECT {KEY} FROM NEW",
)
def _(spark, sf):
    ledger, batch = _halves(spark, sf)
    return sinks.new_rows(batch, ledger).select("user_id", "txn_key")


@register(
    "snk_atomic_import",
    f"""WITH {L}, {_NEW} SELECT user_id, count(*) AS n FROM
    (SELECT user_id FROM OLD UNION ALL SELECT user_id FROM NEW) GROUP BY ALL""",
)
def _(spark, sf):
    """Publish the ledger, insert the overlapping batch twice, and read the newest version."""
    from ..session import scratch_path

    ledger, batch = _halves(spark, sf)
    path = scratch_path(spark, "ledger")
    sinks.publish(ledger, path)
    for _ in range(2):
        sinks.publish_rows(batch, path)
    return sinks.read_published(spark, path).groupBy("user_id").agg(F.count("*").alias("n"))


_LINES = f"""SELECT user_id, {month('txn_date')} AS month, category_name, {r('sum(amount)')} AS recommended FROM L
  WHERE category_name IS NOT NULL GROUP BY ALL"""


@register(
    "snk_upsert_budget",
    f"""WITH {L}, A AS ({_LINES}) SELECT user_id, month, category_name,
    CASE WHEN month >= '2001-01' THEN {r('recommended * 2')} ELSE recommended END AS recommended
    FROM A WHERE month < '2001-06' OR month >= '2001-01'""",
)
def _(spark, sf):
    lines = (
        fx.ledger(spark, sf)
        .filter(F.col("category_name").isNotNull())
        .groupBy("user_id", spend.month_key("txn_date").alias("month"), "category_name")
        .agg(rnd(F.sum("amount")).alias("recommended"))
    )
    new = lines.filter("month >= '2001-01'").withColumn("recommended", rnd(F.col("recommended") * 2))
    return sinks.upsert_budget(lines.filter("month < '2001-06'"), new)


_METRICS = """MT AS (SELECT event_id AS metric_id, event_type AS model_type, date_trunc('day', ts) AS trained_at,
  CASE WHEN event_id % 3 = 0 THEN value / 100 END AS per_category_mae_ratio,
  CASE event_id % 3 WHEN 1 THEN 'x; per-category MAE ratio ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)
    WHEN 2 THEN 'none' END AS notes FROM events)"""


def _metrics(spark, sf):
    n = F.col("event_id")
    noted = F.concat(F.lit("x; per-category MAE ratio "), F.col("value").cast("decimal(18,2)").cast("string"))
    return fx.table(spark, sf, "events").select(
        n.alias("metric_id"),
        F.col("event_type").alias("model_type"),
        F.date_trunc("day", "ts").alias("trained_at"),
        F.when(n % 3 == 0, F.col("value") / 100).alias("per_category_mae_ratio"),
        F.when(n % 3 == 1, noted).when(n % 3 == 2, "none").alias("notes"),
    )


@register(
    "snk_metric_append",
    f"""WITH {_METRICS} SELECT model_type, metric_id FROM MT
    QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY trained_at DESC, metric_id DESC) = 1""",
)
def _(spark, sf):
    """Append in two batches, then read the newest of each type."""
    from ..session import scratch_path

    metrics, path = _metrics(spark, sf), scratch_path(spark, "metrics")
    early = F.col("trained_at") < F.lit("2024-01-15").cast("timestamp")
    metrics.filter(early).write.mode("append").parquet(path)
    metrics.filter(~early).write.mode("append").parquet(path)
    return sinks.latest_metric(spark.read.parquet(path)).select("model_type", "metric_id")


@register(
    "metric_latest",
    f"""WITH {_METRICS} SELECT model_type, metric_id FROM MT
    QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY trained_at DESC, metric_id DESC) = 1""",
)
def _(spark, sf):
    return sinks.latest_metric(_metrics(spark, sf)).select("model_type", "metric_id")


@register(
    "metric_ratio_fallback",
    f"""WITH {_METRICS} SELECT metric_id, coalesce(per_category_mae_ratio,
    TRY_CAST(nullif(regexp_extract(coalesce(notes,''), 'per-category MAE ratio ([0-9.]+)', 1), '') AS DOUBLE)) AS ratio FROM MT""",
)
def _(spark, sf):
    return sinks.metric_ratio(_metrics(spark, sf)).select("metric_id", "ratio")


@register(
    "snk_delete_by_source",
    f"""WITH {L}, {ITEMS}, K AS (SELECT * FROM L WHERE NOT coalesce(starts_with(import_hash, 'sync-bank-'), false))
    SELECT 'ledger' AS part, user_id, count(*) AS n FROM K GROUP BY ALL
    UNION ALL SELECT 'items', user_id, count(*) FROM ITEMS JOIN K USING (txn_key) GROUP BY ALL""",
)
def _(spark, sf):
    ledger, items = sinks.drop_source(fx.ledger(spark, sf), fx.receipt_items(spark, sf), "sync-bank-")
    owners = fx.ledger(spark, sf).select("txn_key", "user_id")
    a = ledger.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("part", F.lit("ledger"))
    b = items.join(owners, "txn_key").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("part", F.lit("items"))
    return a.unionByName(b)


@register("snk_delete_manual_only", f"WITH {L} SELECT {KEY} FROM L WHERE starts_with(import_hash, 'manual-')")
def _(spark, sf):
    return sinks.deletable(fx.ledger(spark, sf)).select("user_id", "txn_key")


@register(
    "snk_reset_imports",
    f"""WITH {L} SELECT CASE WHEN import_hash IS NOT NULL THEN 'remove' ELSE 'keep' END AS action, count(*) AS n,
    {day('min(txn_date)')} AS first, {day('max(txn_date)')} AS last, {r('sum(amount)')} AS total FROM L GROUP BY ALL""",
)
def _(spark, sf):
    return texts(sinks.reset_summary(fx.ledger(spark, sf), sinks.imported()))


@register(
    "snk_reset_imports_apply",
    f"""WITH {L}, {ITEMS} SELECT user_id, count(*) AS items FROM ITEMS JOIN L USING (txn_key)
    WHERE import_hash IS NULL GROUP BY ALL""",
)
def _(spark, sf):
    kept, items = sinks.reset_imports(fx.ledger(spark, sf), fx.receipt_items(spark, sf), sinks.imported())
    return items.join(kept.select("txn_key", "user_id"), "txn_key").groupBy("user_id").agg(F.count("*").alias("items"))


@register(
    "snk_purge_account",
    f"""WITH {L}, {ITEMS}, {GOALS}, {P}, GONE AS (SELECT n_nationkey AS user_id FROM nation WHERE n_regionkey = 1),
    K AS (SELECT * FROM L WHERE user_id NOT IN (SELECT user_id FROM GONE))
    SELECT 'ledger' AS part, count(*) AS n FROM K UNION ALL
    SELECT 'items', count(*) FROM ITEMS WHERE txn_key IN (SELECT txn_key FROM K) UNION ALL
    SELECT 'goals', count(*) FROM GOALS WHERE user_id NOT IN (SELECT user_id FROM GONE) UNION ALL
    SELECT 'profile', count(*) FROM P WHERE user_id NOT IN (SELECT user_id FROM GONE)""",
)
def _(spark, sf):
    gone = fx.table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("user_id"))
    left = sinks.purge_accounts(
        {
            "ledger": fx.ledger(spark, sf),
            "items": fx.receipt_items(spark, sf),
            "goals": fx.goals(spark, sf),
            "profile": fx.profile(spark, sf),
        },
        gone,
    )
    counts = [df.agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@register(
    "snk_export",
    f"""WITH {L} SELECT user_id, {day('txn_date')} AS "Date", description AS "Description", CAST(amount AS VARCHAR) AS "Amount",
    txn_type AS "Type", category_name AS "Category", 'No' AS "Is Subscription" FROM L
    WHERE category_name = 'Groceries' AND {month('txn_date')} = '2000-03' AND contains(lower(description), 'gear')""",
)
def _(spark, sf):
    return sinks.export_rows(fx.ledger(spark, sf), "Groceries", "2000-03", " gear ")


@register(
    "dim_add_category",
    f"""WITH {C}, NEW AS (SELECT upper(p_name[1]) || lower(split_part(p_name,' ',1)[2:]) || ' ' ||
      upper(split_part(p_name,' ',2)[1]) || lower(split_part(p_name,' ',2)[2:]) AS category_name,
      max(CASE WHEN p_size % 2 = 0 THEN 'ESSENTIAL' ELSE 'DISCRETIONARY' END) AS category_type FROM part
      WHERE p_size % 10 <> 9 GROUP BY ALL)
    SELECT * FROM C UNION ALL SELECT * FROM NEW WHERE category_name NOT IN (SELECT category_name FROM C)""",
)
def _(spark, sf):
    size = F.col("p_size")
    new = fx.table(spark, sf, "part").select(
        F.concat(F.lit(" "), F.upper("p_name")).alias("category_name"),
        F.when(size % 10 == 9, "OTHER").when(size % 2 == 0, "ESSENTIAL").otherwise("DISCRETIONARY").alias("category_type"),
    )
    return sinks.add_categories(fx.category_dim(spark), new)


@register(
    "ml_migrate_labels",
    f"""WITH {L}, {N}, X AS (SELECT user_id, txn_key, category_source, txn_type, description,
      CASE WHEN category_name = 'Dining Out' THEN 'Transfers' ELSE category_name END AS category_name, import_hash FROM N)
    SELECT user_id, txn_key, CASE WHEN category_name = 'Transfers' AND txn_type = 'DEBIT' AND category_source <> 'user'
      AND starts_with(lower(description), 'atm') THEN 'Cash Withdrawal' ELSE category_name END AS category_name,
    CASE WHEN import_hash IS NULL THEN 'legacy-' || txn_key
      WHEN starts_with(import_hash, 'sync-momo-') AND NOT regexp_matches(import_hash, '^sync-momo-(mtn|airtel)-')
      THEN 'sync-momo-airtel-' || substr(import_hash, 11) ELSE import_hash END AS import_hash FROM X""",
)
def _(spark, sf):
    rows = fx.ledger(spark, sf, named=True).withColumn(
        "category_name",
        F.when(F.col("category_name") == "Dining Out", "Transfers").otherwise(F.col("category_name")),
    )
    return sinks.migrate_labels(rows, "airtel").select("user_id", "txn_key", "category_name", "import_hash")

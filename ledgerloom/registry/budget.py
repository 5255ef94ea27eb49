"""Checks of goals, budgets, alerts, reports and the answers made from them."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import cycles, recurring, spend
from ..operators import forecast as fc
from ..plans import budget as bd
from ..schema import rnd
from ..session import stored
from . import fixtures as fx
from . import register
from .fixtures import AS_OF
from .forecast import FC
from .ledger import CYCLES, MONTH_TOTALS, SPEND, texts
from .recurring import KEYED
from .sqltext import AS_OF as AS_OF_SQL
from .sqltext import GOALS, C, L, P, day, last_payday, month, norm, r

MONTH = bd.month_of(AS_OF)


def pool(ledger):
    """A fortieth of all income, so that part of the goals is funded."""
    credits = ledger.filter(spend.is_credit()).groupBy("user_id").agg(F.sum("amount").alias("total"))
    return credits.select("user_id", rnd(F.col("total").cast("double") / 40).alias("pool"))


WF = f"""{GOALS}, POOL AS (SELECT user_id, {r('CAST(sum(amount) AS DOUBLE) / 40')} AS pool FROM L
  WHERE txn_type = 'CREDIT' GROUP BY ALL),
W0 AS (SELECT g.*, CAST(target_amount AS DOUBLE) AS t, coalesce(pool, 0) AS pool, CAST(coalesce(sum(target_amount) OVER
    (PARTITION BY g.user_id ORDER BY target_date, goal_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS prev,
  greatest(1, (year(target_date) - 2001) * 12 + month(target_date) - 8) AS mr FROM GOALS g LEFT JOIN POOL USING (user_id)),
W1 AS (SELECT *, greatest(0, least(pool - prev, t)) AS sv FROM W0),
WF AS (SELECT user_id, goal_id, goal_name, t AS target_amount, target_date, mr AS months_remaining, {r('sv')} AS saved,
  {r('greatest(0, t - sv)')} AS shortfall, {r('least(100, sv / t * 100)', 1)} AS progress,
  {r('greatest(0, t - sv) / mr')} AS monthly_required, target_date < {AS_OF_SQL} AS overdue FROM W1)"""


@register("wn_goal_waterfall", f"WITH {L}, {WF} SELECT * REPLACE ({day('target_date')} AS target_date) FROM WF")
def _(spark, sf):
    ledger = fx.ledger(spark, sf)
    return texts(bd.goal_waterfall(fx.goals(spark, sf), pool(ledger), AS_OF))


@register(
    "sc_months_until",
    """SELECT c_custkey AS goal_id, greatest(1, (c_custkey % 6) * 12 + (1 + c_custkey % 12) - 8) AS months FROM customer""",
)
def _(spark, sf):
    from ..functions.dates import months_until

    return fx.goals(spark, sf).select(
        "goal_id", months_until("target_date", F.lit(AS_OF)).cast("bigint").alias("months")
    )


def parts(spark, sf, ledger=None):
    """Budget of the current month with the frames it was made from."""
    # A ledger is a stored table in use: the tables behind it are joined and read once.
    ledger = stored(fx.ledger(spark, sf), "ledger") if ledger is None else ledger
    category, profile = fx.category_dim(spark), fx.profile(spark, sf)
    spent = spend.monthly_spend(ledger, category)
    goals = bd.goal_waterfall(fx.goals(spark, sf), pool(ledger), AS_OF)
    forecasts = fc.forecast(spent, AS_OF)
    actual = spent.select("user_id", spend.month_key("month").alias("month"), "category_name", rnd("amount").alias("spent"))
    made = bd.build_budget(
        profile, forecasts, actual, bd.month_debits(ledger, MONTH), goals, category, MONTH
    )
    return made, forecasts, goals, ledger, category, profile


BUD = f"""{FC}, {WF}, FA AS (SELECT user_id, category_name, method, {r('amount')} AS forecast FROM F_FC),
ACT AS (SELECT user_id, category_name, {r('amount')} AS spent FROM SPENT WHERE {month('month')} = '{MONTH}'),
W AS (SELECT f.*, category_type, coalesce(spent, 0) AS spent, {r('forecast * 1.05')} AS ess FROM FA f
  JOIN C USING (category_name) LEFT JOIN ACT USING (user_id, category_name)),
TOT AS (SELECT user_id, {r("sum(CASE WHEN category_type = 'ESSENTIAL' THEN ess ELSE 0 END)")} AS et,
  {r("sum(CASE WHEN category_type = 'ESSENTIAL' THEN 0 ELSE forecast END)")} AS df FROM W GROUP BY ALL),
GT AS (SELECT user_id, {r('sum(monthly_required)')} AS gt FROM WF GROUP BY ALL),
DEB AS (SELECT user_id, {r('sum(amount)')} AS st FROM L WHERE {SPEND} AND {month('txn_date')} = '{MONTH}' GROUP BY ALL),
FR AS (SELECT P.user_id, CAST(salary_amount AS DOUBLE) AS salary, coalesce(et, 0) AS et, coalesce(df, 0) AS df,
  coalesce(gt, 0) AS gt, coalesce(st, 0) AS st FROM P LEFT JOIN TOT USING (user_id) LEFT JOIN GT USING (user_id) LEFT JOIN DEB USING (user_id)),
FR2 AS (SELECT *, salary - et - gt AS av, (df > 0 AND round(salary - et - gt - df, 8) < 0) AS oc FROM FR),
FR3 AS (SELECT *, CASE WHEN oc THEN greatest(0, av / df) ELSE 1.0 END AS scale FROM FR2),
LN0 AS (SELECT W.*, salary, oc, CASE WHEN category_type = 'ESSENTIAL' THEN ess ELSE {r('forecast * scale')} END AS rec
  FROM W JOIN FR3 USING (user_id)),
LN1 AS (SELECT *, CASE WHEN rec <> 0 THEN {r('spent / rec * 100', 1)} ELSE 0 END AS used_pct FROM LN0),
LINES AS (SELECT user_id, '{MONTH}' AS month, category_name, category_type, forecast, method, rec AS recommended, spent,
  {r('rec - spent')} AS remaining, used_pct, {r('rec / salary * 100', 1)} AS pct_of_salary,
  (category_type <> 'ESSENTIAL' AND oc) AS scaled,
  CASE WHEN rec <> 0 AND spent >= rec THEN 'over' WHEN rec <> 0 AND used_pct >= 80 THEN 'warning' ELSE 'ok' END AS status FROM LN1),
LT AS (SELECT user_id, {r("sum(CASE WHEN category_type = 'ESSENTIAL' THEN 0 ELSE recommended END)")} AS dtot,
  {r('sum(greatest(0, remaining))')} AS ob FROM LINES GROUP BY ALL),
SM0 AS (SELECT FR3.*, coalesce(dtot, 0) AS dtot, coalesce(ob, 0) AS ob FROM FR3 LEFT JOIN LT USING (user_id)),
SM AS (SELECT user_id, '{MONTH}' AS month, salary, et AS essential_total, dtot AS discretionary_total, {r('et + dtot')} AS allocated_total,
  {r('salary - et - dtot - gt')} AS surplus, {r('greatest(0, salary - st - ob)')} AS recommended_savings,
  {r('greatest(0, salary - st - ob) / salary * 100', 1)} AS savings_rate, gt AS goal_total, oc AS overcommitted,
  round(et - salary, 8) > 0 AS essentials_exceed_income, {r('greatest(0, et + dtot + gt - salary)')} AS deficit,
  {r('scale', 3)} AS scale, st AS spent_total FROM SM0)"""

HEAD = f"WITH {L}, {C}, {P}, {BUD}"
LINE_COLUMNS = (
    "user_id", "month", "category_name", "category_type", "forecast", "method", "recommended", "spent", "remaining",
    "used_pct", "pct_of_salary", "scaled", "status",
)


@register("bd_budget", f"{HEAD} SELECT * FROM LINES")
def _(spark, sf):
    return parts(spark, sf)[0].lines.select(*LINE_COLUMNS)


@register("bd_budget_summary", f"{HEAD} SELECT * FROM SM")
def _(spark, sf):
    return parts(spark, sf)[0].summary


@register(
    "so_budget_rows",
    f"""{HEAD} SELECT user_id, category_name, recommended, spent,
    row_number() OVER (PARTITION BY user_id ORDER BY recommended DESC, category_name) AS position FROM LINES QUALIFY position <= 8""",
)
def _(spark, sf):
    rows = bd.chart_lines(parts(spark, sf)[0].lines)
    return texts(rows.select("user_id", "category_name", "recommended", "spent", "position"))


ALERTS = f"""RS AS (SELECT user_id, count(*) AS n, {r('sum(monthly_amount)')} AS mt FROM REC GROUP BY ALL),
AL AS (SELECT user_id, CASE status WHEN 'over' THEN 'critical' ELSE 'warning' END AS severity,
    CASE status WHEN 'over' THEN 'over_budget' ELSE 'near_budget' END AS kind, category_name AS subject,
    CASE status WHEN 'over' THEN {r('spent - recommended')} ELSE remaining END AS amount FROM LINES
    WHERE recommended > 0 AND status <> 'ok'
  UNION ALL SELECT user_id, 'critical', CASE WHEN essentials_exceed_income THEN 'essentials_exceed_income' ELSE 'overcommitted' END,
    'Budget', CASE WHEN essentials_exceed_income THEN deficit ELSE {r('essential_total + goal_total')} END FROM SM
    WHERE essentials_exceed_income OR overcommitted
  UNION ALL SELECT user_id, 'critical', 'goals_slipping', 'Savings', {r('goal_total - recommended_savings')} FROM SM
    WHERE recommended_savings < goal_total
  UNION ALL SELECT user_id, 'info', 'recurring_charges', CAST(n AS VARCHAR) || ' recurring charges', mt FROM RS WHERE mt > 0
  UNION ALL SELECT user_id, 'info', 'payday_surge', 'Spending pattern', surge_share FROM CYCLE WHERE has_surge)"""


def _alerts(spark, sf):
    both = stored(fx.ledger(spark, sf, both=True), "ledger")
    made, _, _, ledger, category, profile = parts(spark, sf, both.drop("flat_amount"))
    flat = both.withColumn("amount", F.col("flat_amount")).drop("flat_amount")
    charges = recurring.recurring_summary(recurring.recurring(flat))
    return bd.alerts(made, charges, cycles.cycle_profile(ledger, category, profile, AS_OF))


@register("bd_alerts", f"{HEAD}, {KEYED}, {CYCLES}, {ALERTS} SELECT * FROM AL")
def _(spark, sf):
    return _alerts(spark, sf).select("user_id", "severity", "kind", "subject", "amount")


@register(
    "so_alert_priority",
    f"""{HEAD}, {KEYED}, {CYCLES}, {ALERTS} SELECT user_id, CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS BIGINT) AS priority,
    count(*) AS n FROM AL GROUP BY ALL""",
)
def _(spark, sf):
    return texts(_alerts(spark, sf).groupBy("user_id", "priority").agg(F.count("*").alias("n")))


@register(
    "bd_savings",
    f"""{HEAD}, PL AS (SELECT user_id, sum(CASE WHEN txn_type = 'CREDIT' THEN amount ELSE 0 END) AS i,
      sum(CASE WHEN txn_type = 'CREDIT' THEN 0 ELSE amount END) AS e FROM L WHERE coalesce(category_name,'') <> 'Cash Withdrawal' GROUP BY ALL),
    AG AS (SELECT user_id, {r('sum(saved)')} AS al FROM WF GROUP BY ALL)
    SELECT WF.user_id, goal_id, saved, shortfall, monthly_required, {r('i')} AS income, {r('e')} AS expenses, pool,
    {r('greatest(0, pool - al)')} AS unallocated, recommended_savings AS recommended_monthly,
    monthly_required <= recommended_savings AS on_track
    FROM WF JOIN PL USING (user_id) JOIN POOL USING (user_id) JOIN AG USING (user_id) JOIN SM USING (user_id)""",
)
def _(spark, sf):
    made, _, goals, ledger, _, _ = parts(spark, sf)
    totals = spend.savings_pool(ledger).drop("pool").join(pool(ledger), "user_id")
    return bd.savings_position(goals, totals, made.summary).select(
        "user_id", "goal_id", "saved", "shortfall", "monthly_required", "income", "expenses", "pool", "unallocated",
        "recommended_monthly", "on_track",
    )


_REC = f"""SPENT2 AS (SELECT user_id, {month('txn_date')} AS month, category_name, {r('sum(amount)')} AS actual
  FROM L JOIN C USING (category_name) WHERE {SPEND} GROUP BY ALL),
RECOM AS (SELECT user_id, {month('txn_date')} AS month, category_name, {r('sum(flat_amount) * 40')} AS recommended
  FROM L WHERE txn_type = 'CREDIT' AND category_name IS NOT NULL GROUP BY ALL),
RL0 AS (SELECT user_id, month, category_name, coalesce(actual, 0) AS actual, recommended
  FROM SPENT2 FULL JOIN RECOM USING (user_id, month, category_name)),
RL AS (SELECT RL0.*, coalesce(category_type, '') AS category_type, {r('recommended - actual')} AS variance,
  CASE WHEN round(recommended - actual, 8) < 0 THEN 'over' WHEN recommended IS NOT NULL THEN 'under' ELSE 'no-budget' END AS status
  FROM RL0 LEFT JOIN C USING (category_name))"""


def _report(spark, sf):
    ledger, category = fx.ledger(spark, sf), fx.category_dim(spark)
    flat = fx.ledger(spark, sf, flat=True)
    recommended = (
        flat.filter(spend.is_credit() & F.col("category_name").isNotNull())
        .groupBy("user_id", spend.month_key("txn_date").alias("month"), "category_name")
        .agg(rnd(F.sum("amount") * 40).alias("recommended"))
    )
    return bd.report_lines(spend.actual_spend(ledger, category), recommended, category), ledger


@register("jn_report_full", f"WITH {L}, {C}, {_REC} SELECT * FROM RL")
def _(spark, sf):
    return _report(spark, sf)[0]


@register(
    "se_category_union",
    f"WITH {L}, {C}, {_REC} SELECT user_id, month, count(*) AS names FROM RL GROUP BY ALL",
)
def _(spark, sf):
    return _report(spark, sf)[0].groupBy("user_id", "month").agg(F.count("*").alias("names"))


@register(
    "bd_month_report",
    f"""WITH {L}, {C}, {_REC}, {MONTH_TOTALS} SELECT t.user_id, t.month, {r('income')} AS income, {r('expenditure')} AS expenditure,
    {r('income - expenditure')} AS net, category_name, category_type, actual, recommended, variance, status
    FROM TOTALS t LEFT JOIN RL USING (user_id, month) WHERE t.month = '2001-03'""",
)
def _(spark, sf):
    lines, ledger = _report(spark, sf)
    return bd.month_report(lines, spend.month_totals(ledger), "2001-03")


CYC = f"""CYC AS (SELECT P.user_id, salary_day, CAST(salary_amount AS DOUBLE) AS salary, coalesce((SELECT CAST(sum(amount) AS DOUBLE) FROM L
    WHERE L.user_id = P.user_id AND {SPEND} AND txn_date BETWEEN {last_payday(AS_OF_SQL, 'P.salary_day')} AND {AS_OF_SQL}), 0) AS cs FROM P)"""
_NEXT = last_payday(f"CAST({last_payday(AS_OF_SQL, 'salary_day')} + 32 AS DATE)", "salary_day")


def _learning(ledger, as_of=AS_OF):
    return spend.learning_status(ledger, as_of)


@register(
    "sc_next_payday",
    f"""WITH {P}, D AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 25 AS user_id FROM orders),
    X AS (SELECT o_orderkey, d, salary_day, {last_payday('d', 'salary_day')} AS last FROM D JOIN P USING (user_id)),
    Y AS (SELECT *, {last_payday('CAST(last + 32 AS DATE)', 'salary_day')} AS n FROM X)
    SELECT o_orderkey, {day('last')} AS last_payday, datediff('day', last, d) AS position,
    least(4, datediff('day', last, d) // 7 + 1) AS week,
    {day('CASE WHEN n > d THEN n ELSE ' + last_payday('CAST(n + 32 AS DATE)', 'salary_day') + ' END')} AS next_payday FROM Y""",
)
def _(spark, sf):
    from ..functions import dates

    days = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("d"), (F.col("o_orderkey") % 25).alias("user_id")
    )
    return texts(
        days.join(fx.profile(spark, sf), "user_id").select(
            "o_orderkey",
            dates.last_payday("d", "salary_day").alias("last_payday"),
            dates.cycle_position("d", "salary_day").alias("position"),
            dates.cycle_week("d", "salary_day").alias("week"),
            dates.next_payday("d", "salary_day").alias("next_payday"),
        )
    )


@register(
    "bd_safe_to_spend",
    f"""{HEAD}, {CYC}, S2 AS (SELECT user_id, {r('sum(remaining)')} AS lf,
      coalesce(array_to_string(list_sort(list(category_name) FILTER (status = 'over')), ', '), '') AS over FROM LINES GROUP BY ALL)
    SELECT user_id, 'budget' AS basis, coalesce(lf, 0) AS "left", {day(_NEXT)} AS payday,
    greatest(1, datediff('day', {AS_OF_SQL}, {_NEXT})) AS days,
    {r(f"greatest(0, coalesce(lf, 0)) / greatest(1, datediff('day', {AS_OF_SQL}, {_NEXT}))")} AS per_day, coalesce(over, '') AS over
    FROM CYC LEFT JOIN S2 USING (user_id)""",
)
def _(spark, sf):
    made, _, _, ledger, _, profile = parts(spark, sf)
    return texts(bd.safe_to_spend(made, _learning(ledger), bd.cycle_spend(ledger, profile, AS_OF), AS_OF))


@register(
    "bd_safe_to_spend_learning",
    f"""WITH {L}, {P}, {CYC} SELECT user_id, 'salary' AS basis, {r('salary - cs')} AS "left", {day(_NEXT)} AS payday,
    greatest(1, datediff('day', {AS_OF_SQL}, {_NEXT})) AS days,
    {r(f"greatest(0, salary - cs) / greatest(1, datediff('day', {AS_OF_SQL}, {_NEXT}))")} AS per_day, '' AS over FROM CYC""",
)
def _(spark, sf):
    made, _, _, ledger, _, profile = parts(spark, sf)
    unfinished = _learning(ledger).withColumn("complete", F.lit(False))
    return texts(bd.safe_to_spend(made, unfinished, bd.cycle_spend(ledger, profile, AS_OF), AS_OF))


def _asks(spark, sf):
    """A question per order: an amount, and a category for two of three."""
    key = F.col("o_orderkey")
    return fx.table(spark, sf, "orders").select(
        key.alias("ask_id"),
        (key % 25).alias("user_id"),
        F.when(key % 10 != 0, F.col("o_totalprice")).alias("amount"),
        F.when(key % 3 == 0, F.array(F.lit("Dining Out")))
        .when(key % 3 == 1, F.array(F.lit("Groceries"), F.lit("Dining Out")))
        .otherwise(F.array().cast("array<string>"))
        .alias("categories"),
        F.when(key % 4 == 0, "what if I cancel Blue Bolt?")
        .when(key % 4 == 1, "if I cut spending")
        .when(key % 4 == 2, "what if i cancel my gym")
        .otherwise("what if i drop red ring and green gear")
        .alias("text"),
    )


_ROOM = """ROOM AS (SELECT user_id, sum(CASE WHEN category_name IN ('Dining Out') THEN greatest(0, remaining) ELSE 0 END) AS r0,
  sum(CASE WHEN category_name IN ('Dining Out', 'Groceries') THEN greatest(0, remaining) ELSE 0 END) AS r1,
  sum(CASE WHEN category_type = 'DISCRETIONARY' THEN greatest(0, remaining) ELSE 0 END) AS r2 FROM LINES GROUP BY ALL)"""


@register(
    "bd_afford",
    f"""{HEAD}, {_ROOM}, A AS (SELECT o_orderkey AS ask_id, o_orderkey % 25 AS user_id,
      CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS amount, o_orderkey % 3 AS k FROM orders),
    X AS (SELECT A.*, {r('coalesce(CASE k WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END, 0)')} AS pool, recommended_savings AS rs
      FROM A LEFT JOIN ROOM USING (user_id) LEFT JOIN SM USING (user_id))
    SELECT ask_id, user_id, amount, pool, CASE WHEN amount IS NULL THEN 'ask_price' WHEN round(amount - pool, 8) <= 0 THEN 'yes'
      WHEN round(amount - pool - rs, 8) <= 0 THEN 'from_savings' ELSE 'not_now' END AS verdict FROM X""",
)
def _(spark, sf):
    made, _, _, ledger, _, profile = parts(spark, sf)
    cycle = bd.cycle_spend(ledger, profile, AS_OF)
    return bd.afford(_asks(spark, sf), made, _learning(ledger), cycle)


def stopwords():
    from ..plans import questions

    return questions.stopwords()


@register(
    "bd_whatif",
    f"""{HEAD}, {KEYED}, AK AS (SELECT o_orderkey AS ask_id, o_orderkey % 25 AS user_id, o_orderkey % 3 AS k, o_orderkey % 4 AS w,
      CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice END AS amount FROM orders),
    RW AS (SELECT user_id, label, monthly_amount, key, list_has_any(string_split({norm("label || ' ' || key")}, ' '), ['blue','bolt']) AS w0,
      list_has_any(string_split({norm("label || ' ' || key")}, ' '), ['red','ring','green','gear']) AS w3 FROM REC),
    CH AS (SELECT ask_id, label, monthly_amount FROM AK JOIN RW USING (user_id) WHERE (w = 0 AND w0) OR (w = 3 AND w3)
      QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY monthly_amount DESC, key) = 1),
    CB AS (SELECT user_id, sum(CASE WHEN category_name IN ('Dining Out') THEN recommended END) AS c0,
      sum(CASE WHEN category_name IN ('Dining Out', 'Groceries') THEN recommended END) AS c1 FROM LINES GROUP BY ALL),
    NG AS (SELECT user_id, min_by(goal_name, (target_date, goal_id)) AS goal_name, min_by(shortfall, (target_date, goal_id)) AS sf
      FROM WF WHERE shortfall > 0 GROUP BY ALL),
    X AS (SELECT AK.*, label, monthly_amount AS ch, {r('0.2 * CASE k WHEN 0 THEN c0 WHEN 1 THEN c1 END')} AS trim, goal_name, sf,
      coalesce(recommended_savings, 0) AS rate
      FROM AK LEFT JOIN CH USING (ask_id) LEFT JOIN CB USING (user_id) LEFT JOIN NG USING (user_id) LEFT JOIN SM USING (user_id)),
    Y AS (SELECT *, CASE WHEN ch IS NULL AND w IN (0, 2) AND amount IS NULL AND k = 2 THEN 'unknown_charge' WHEN ch IS NOT NULL THEN 'cancel'
      WHEN amount > 0 THEN 'amount' WHEN trim > 0 THEN 'trim' ELSE 'none' END AS source FROM X),
    Z AS (SELECT *, CASE source WHEN 'cancel' THEN ch WHEN 'amount' THEN amount WHEN 'trim' THEN trim END AS sv FROM Y)
    SELECT ask_id, user_id, source, CASE WHEN source = 'cancel' THEN label END AS label, {r('sv')} AS monthly_saving,
    {r('sv * 12')} AS annual_saving, CASE WHEN sv > 0 THEN goal_name END AS goal_name,
    CASE WHEN sv > 0 AND rate > 0 THEN CAST(greatest(1, ceil(sf / rate)) AS BIGINT) END AS months_before,
    CASE WHEN sv > 0 THEN CAST(greatest(1, ceil(sf / (rate + sv))) AS BIGINT) END AS months_after FROM Z""",
)
def _(spark, sf):
    made, _, goals, _, _, _ = parts(spark, sf)
    charges = recurring.recurring(fx.ledger(spark, sf, flat=True))
    asks = _asks(spark, sf).withColumn("amount", F.when(F.col("ask_id") % 10 == 0, F.col("amount")))
    key = F.col("ask_id")
    priced = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ask_id"), "o_totalprice")
    asks = (
        asks.drop("amount")
        .join(priced, "ask_id")
        .withColumn("amount", F.when(key % 10 == 0, F.col("o_totalprice")))
        .drop("o_totalprice")
    )
    return bd.whatif(asks, charges, made, goals, stopwords())


@register(
    "bd_cutback",
    f"""{HEAD} SELECT * FROM (SELECT user_id, 'over' AS kind, category_name, {r('spent - recommended')} AS amount FROM LINES WHERE status = 'over'
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY recommended DESC, category_name) <= 3)
    UNION ALL SELECT * FROM (SELECT user_id, 'near', category_name, {r('spent / recommended * 100', 1)} FROM LINES WHERE status = 'warning'
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY recommended DESC, category_name) <= 3)
    UNION ALL SELECT * FROM (SELECT user_id, 'trim', category_name, {r('spent * 0.2')} FROM LINES WHERE category_type = 'DISCRETIONARY' AND spent > 0
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY spent DESC, recommended DESC, category_name) = 1)""",
)
def _(spark, sf):
    return bd.cutback(parts(spark, sf)[0].lines)


@register(
    "bd_forecast_summary",
    f"""{HEAD} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY forecast DESC, category_name) AS position, category_name,
    forecast AS amount, method, {r('sum(forecast) OVER (PARTITION BY user_id)')} AS total FROM FA QUALIFY position <= 3""",
)
def _(spark, sf):
    spent = spend.monthly_spend(fx.ledger(spark, sf), fx.category_dim(spark))
    return texts(bd.forecast_summary(fc.forecast(spent, AS_OF)))


@register(
    "bd_kpis",
    f"""{HEAD} SELECT LINES.user_id, category_name, {r('essential_total / SM.salary * 100', 1)} AS essential_share,
    {r('discretionary_total / SM.salary * 100', 1)} AS discretionary_share, {r('allocated_total / SM.salary * 100', 1)} AS allocated_share,
    CASE WHEN used_pct < 75 THEN 'green' WHEN used_pct < 95 THEN 'yellow' ELSE 'red' END AS band
    FROM LINES JOIN SM USING (user_id)""",
)
def _(spark, sf):
    return bd.kpis(parts(spark, sf)[0])


@register(
    "bd_goal_bands",
    f"""WITH {L}, {WF} SELECT user_id, goal_id, CASE WHEN progress < 40 THEN 'red' WHEN progress < 80 THEN 'yellow' ELSE 'green' END AS band FROM WF""",
)
def _(spark, sf):
    goals = bd.goal_waterfall(fx.goals(spark, sf), pool(fx.ledger(spark, sf)), AS_OF)
    return goals.select("user_id", "goal_id", bd.goal_band(F.col("progress")).alias("band"))


@register(
    "snk_upsert_budget_files",
    f"{HEAD} SELECT user_id, month, category_name, {r('recommended * 2')} AS recommended FROM LINES",
)
def _(spark, sf):
    """Write the month's lines, write them again doubled, read back one line per key."""
    from ..session import scratch_path
    from ..sources import sinks

    made, path = parts(spark, sf)[0], scratch_path(spark, "budget")
    lines = made.lines.select("user_id", "month", "category_name", "recommended")
    lines.write.partitionBy("month").parquet(path)
    stored = spark.read.schema("user_id BIGINT, category_name STRING, recommended DOUBLE, month STRING").parquet(path)
    again = lines.withColumn("recommended", rnd(F.col("recommended") * 2))
    target = scratch_path(spark, "budget")
    sinks.write_budget(spark, target, stored, again)
    return spark.read.schema(stored.schema).parquet(target).select("user_id", "month", "category_name", "recommended")



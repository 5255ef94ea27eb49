"""Checks of the forecasters, their selection and the hold-out test."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import forecast as fc
from ..operators import spend
from ..schema import rnd
from . import fixtures as fx
from . import register
from .fixtures import AS_OF
from .ledger import GRID
from .sqltext import AS_OF as AS_OF_SQL
from .sqltext import C, L, month, r


def series(spark, sf):
    return spend.month_series(spend.monthly_spend(fx.ledger(spark, sf), fx.category_dim(spark)), AS_OF)


# Long form of all series before the current month; idx counts from 0.
SER = f"""{GRID}, SER AS (SELECT user_id, category_name, amount AS y, month,
  row_number() OVER (PARTITION BY user_id, category_name ORDER BY month) - 1 AS idx,
  count(*) OVER (PARTITION BY user_id, category_name) AS n FROM GRID WHERE month < date_trunc('month', {AS_OF_SQL}))"""


def candidates(src: str, p: str) -> str:
    """All five forecasts of every (user, category, origin) history in ``src`` (columns y, idx, n)."""
    k = "user_id, category_name, origin"
    return f"""{p}Z AS (SELECT {k}, idx, n, y, avg(y) OVER g AS m, y - avg(y) OVER g AS z,
    lag(y) OVER (PARTITION BY {k} ORDER BY idx) - avg(y) OVER g AS zl FROM {src} WINDOW g AS (PARTITION BY {k})),
  {p}ST AS (SELECT {k}, n, any_value(m) AS m, sum(z * z) AS q, sum(z * zl) AS x,
    max(CASE WHEN idx = 0 THEN z END) AS z1, max(CASE WHEN idx = n - 1 THEN z END) AS zn FROM {p}Z GROUP BY {k}, n),
  {p}PH AS (SELECT *, g / 100.0::DOUBLE AS phi FROM {p}ST, (SELECT unnest(generate_series(-99, 99)) AS g)),
  {p}MU AS (SELECT *, ((1 - phi * phi) * z1 + (1 - phi) * (-z1 + phi * zn)) / ((1 - phi * phi) + (n - 1) * (1 - phi) * (1 - phi)) AS mu FROM {p}PH),
  {p}SS AS (SELECT *, (1 - phi * phi) * (z1 - mu) * (z1 - mu) + (q - z1 * z1 + 2 * mu * z1 + (n - 1) * mu * mu)
    - 2 * phi * (x + mu * (z1 + zn) + (n - 1) * mu * mu)
    + phi * phi * (q - zn * zn + 2 * mu * zn + (n - 1) * mu * mu) AS s FROM {p}MU),
  {p}AR AS (SELECT {k}, CASE WHEN q < 1e-9 THEN m ELSE m + mu + phi * (zn - mu) END AS arima FROM {p}SS
    QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY
      round(-n / 2 * ln(greatest(s, 1e-300) / n) + 0.5 * ln(1 - phi * phi), 9) DESC, abs(phi), phi) = 1),
  {p}BASIC AS (SELECT {k}, n, coalesce(regr_intercept(y, idx) + regr_slope(y, idx) * n, avg(y)) AS linear,
    avg(y) FILTER (idx >= n - 3) AS mean, median(y) FILTER (idx >= n - 3) AS median FROM {src} GROUP BY {k}, n),
  {p}EV AS (SELECT {k}, y, idx - lag(idx, 1, -1) OVER w AS every, row_number() OVER w AS j,
    count(*) OVER (PARTITION BY {k}) AS events FROM {src} WHERE y > 0 WINDOW w AS (PARTITION BY {k} ORDER BY idx)),
  {p}CR AS (SELECT {k}, sum(wt * y) / sum(wt * every) AS cr FROM
    (SELECT *, CASE WHEN j = 1 THEN pow(0.6, events - 1) ELSE 0.4 * pow(0.6, events - j) END AS wt FROM {p}EV) GROUP BY {k}),
  {p}CAND AS (SELECT {k}, n, greatest(0, arima) AS arima, greatest(0, linear) AS linear, greatest(0, mean) AS mean,
    greatest(0, median) AS median, greatest(0, coalesce(cr, 0)) AS intermittent
    FROM {p}BASIC JOIN {p}AR USING ({k}) LEFT JOIN {p}CR USING ({k}))"""


def chain(src: str, p: str) -> str:
    """Forecast of every active series of ``src`` (user_id, category_name, y, idx, n)."""
    return f"""{p}ACT AS (SELECT user_id, category_name FROM {src} WHERE idx >= n - 3 GROUP BY ALL HAVING sum(y) <> 0),
  {p}ACTS AS (SELECT {src}.* FROM {src} JOIN {p}ACT USING (user_id, category_name)),
  {p}HO AS (SELECT *, CASE WHEN least(3, n - 4) >= 2 THEN least(3, n - 4) ELSE 0 END AS maxo FROM {p}ACTS),
  {p}HIST AS (SELECT user_id, category_name, origin, y, idx, n - origin AS n FROM {p}HO, (VALUES (0),(1),(2),(3)) o(origin)
    WHERE origin <= maxo AND idx < n - origin),
  {p}TRUTH AS (SELECT user_id, category_name, n - idx AS origin, y AS actual FROM {p}HO WHERE n - idx <= maxo),
  {candidates(p + 'HIST', p)},
  {p}ERR AS (SELECT user_id, category_name, method, round(avg(abs(v - actual)), 6) AS err
    FROM (UNPIVOT {p}CAND ON arima, linear, mean, median, intermittent INTO NAME method VALUE v)
    JOIN {p}TRUTH USING (user_id, category_name, origin) GROUP BY ALL),
  {p}RANK AS (SELECT *, min(err) OVER (PARTITION BY user_id, category_name) AS best, CASE method WHEN 'arima' THEN 0
    WHEN 'linear' THEN 1 WHEN 'mean' THEN 2 WHEN 'median' THEN 3 ELSE 4 END AS pos FROM {p}ERR),
  {p}PICK AS (SELECT user_id, category_name, method, err FROM {p}RANK QUALIFY row_number() OVER
    (PARTITION BY user_id, category_name ORDER BY CASE WHEN method = 'arima' AND err <= best * 1.02 THEN 0 WHEN err = best THEN 1 ELSE 2 END, pos) = 1),
  {p}STD AS (SELECT user_id, category_name, n, stddev_samp(y) AS sd, avg(y) FILTER (idx >= n - 3) AS m3,
    max(y) FILTER (idx = n - 1) AS last FROM {p}ACTS GROUP BY ALL),
  {p}FC AS (SELECT s.user_id, s.category_name, s.n, CASE WHEN s.n < 4 THEN 'mean' WHEN sd < 1e-9 THEN 'constant'
      ELSE coalesce(k.method, 'mean') END AS method, CASE WHEN s.n >= 4 AND sd >= 1e-9 THEN k.err END AS err,
    greatest(0, CASE WHEN s.n < 4 THEN m3 WHEN sd < 1e-9 THEN last ELSE CASE coalesce(k.method, 'mean') WHEN 'arima' THEN c.arima
      WHEN 'linear' THEN c.linear WHEN 'mean' THEN c.mean WHEN 'median' THEN c.median ELSE c.intermittent END END) AS amount
    FROM {p}STD s LEFT JOIN {p}PICK k USING (user_id, category_name)
    LEFT JOIN {p}CAND c ON c.user_id = s.user_id AND c.category_name = s.category_name AND c.origin = 0)"""


FC = f"{SER}, {chain('SER', 'F_')}"
_ALL = f"{SER}, HS AS (SELECT *, 0 AS origin FROM SER), {candidates('HS', 'H_')}"


def _single(name: str, column: str, maker):
    @register(name, f"WITH {L}, {C}, {_ALL} SELECT user_id, category_name, {r(column)} AS forecast FROM H_CAND")
    def _(spark, sf):
        return series(spark, sf).select(
            "user_id", "category_name", rnd(F.greatest(F.lit(0.0), maker("values"))).alias("forecast")
        )


_single("fc_mean3", "mean", fc.forecast_mean3)
_single("fc_median3", "median", fc.forecast_median3)
_single("fc_linear", "linear", fc.forecast_linear)
_single("fc_croston", "intermittent", fc.forecast_croston)
_single("fc_ar1", "arima", fc.forecast_ar1)


@register(
    "fc_select",
    f"""WITH {L}, {C}, {FC} SELECT user_id, category_name, method, {r('err')} AS cv_error FROM F_FC WHERE method <> 'constant' AND n >= 4""",
)
def _(spark, sf):
    varied = fc.active(series(spark, sf)).filter(
        (F.size("values") >= 4) & (fc.sample_std("values") >= 1e-9)
    )
    return fc.select_methods(varied).select("user_id", "category_name", "method", rnd("cv_error").alias("cv_error"))


@register(
    "fc_forecast",
    f"""WITH {L}, {C}, {FC} SELECT user_id, category_name, method, {r('amount')} AS amount, {r('err')} AS cv_error, n AS months_used
    FROM F_FC""",
)
def _(spark, sf):
    made = fc.forecast(spend.monthly_spend(fx.ledger(spark, sf), fx.category_dim(spark)), AS_OF)
    return made.select(
        "user_id", "category_name", "method", "amount", "cv_error", F.size("months").cast("bigint").alias("months_used")
    )


@register(
    "fc_refresh",
    f"""WITH {L}, {C}, {FC} SELECT user_id, category_name, method, {r('amount')} AS amount, {r('err')} AS cv_error, n AS months_used
    FROM F_FC""",
)
def _(spark, sf):
    """Forecasts stored for a ledger in which every fifth account lacks its last months, then brought up to the whole."""
    from ..plans import forecasts
    from ..session import scratch_path, stored

    path, category = scratch_path(spark, "forecasts"), fx.category_dim(spark)
    ledger = stored(fx.ledger(spark, sf), "ledger")
    early = ledger.filter((F.col("user_id") % 5 != 0) | (F.col("txn_date") < dt.date(2000, 6, 1)))
    forecasts.refresh_forecasts(early, category, path, AS_OF)
    forecasts.refresh_forecasts(ledger, category, path, AS_OF)
    made = forecasts.stored_forecasts(spark, path)
    return made.select(
        "user_id", "category_name", "method", "amount", "cv_error", F.size("months").cast("bigint").alias("months_used")
    )


BT = f"""{SER}, TR AS (SELECT user_id, category_name, y, idx, n - 1 AS n FROM SER WHERE n >= 3 AND idx < n - 1), {chain('TR', 'B_')},
BL AS (SELECT f.user_id, f.category_name, f.method, f.amount AS predicted, s.y AS actual, {month('s.month')} AS test_month, s.n
  FROM B_FC f JOIN SER s ON s.user_id = f.user_id AND s.category_name = f.category_name AND s.idx = s.n - 1)"""


@register(
    "fc_backtest",
    f"""WITH {L}, {C}, {BT}, A AS (SELECT user_id, test_month, n AS months_used, count(*) AS categories, sum(predicted) AS p,
      sum(actual) AS a, avg(abs(predicted - actual)) AS e, avg(actual) AS m FROM BL GROUP BY ALL)
    SELECT user_id, test_month, months_used, categories, {r('p')} AS predicted_total, {r('a')} AS actual_total,
    {r('abs(p - a)')} AS mae, CASE WHEN a > 0 THEN {r('abs(p - a) / a', 4)} END AS mae_ratio, {r('e')} AS per_category_mae,
    CASE WHEN m > 0 THEN {r('e / m', 4)} END AS per_category_mae_ratio,
    coalesce(a > 0 AND round(abs(p - a) / a, 8) <= 0.15, false) AS meets_target FROM A""",
)
def _(spark, sf):
    spent = spend.monthly_spend(fx.ledger(spark, sf), fx.category_dim(spark))
    out = fc.backtest(fc.backtest_lines(spent, AS_OF))
    return out.withColumn("months_used", F.col("months_used").cast("bigint"))


@register(
    "fc_backtest_lines",
    f"""WITH {L}, {C}, {BT} SELECT user_id, category_name, method, {r('predicted')} AS predicted, {r('actual')} AS actual,
    {r('abs(predicted - actual)')} AS absolute_error FROM BL""",
)
def _(spark, sf):
    lines = fc.backtest_lines(spend.monthly_spend(fx.ledger(spark, sf), fx.category_dim(spark)), AS_OF)
    return lines.select(
        "user_id", "category_name", "method", rnd("prediction").alias("predicted"), rnd("actual").alias("actual"),
        rnd("absolute_error").alias("absolute_error"),
    )

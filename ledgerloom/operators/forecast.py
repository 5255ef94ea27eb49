"""Month-ahead forecasts per (user, category), chosen by rolling-origin error.

A series is one array of monthly amounts (at most one value per month of the
accepted history). All candidate forecasters are array expressions, so every
(series, origin) pair is one row of one projection and nothing is collected.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Col, as_col
from ..params import DEFAULTS, Params
from ..schema import rnd
from .spend import month_series

# Candidate names in tie order.
METHODS = ("arima", "linear", "mean", "median", "intermittent")
SERIES = ["user_id", "category_name"]


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use a value several times, or per array element, but evaluate it once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _centred(values: Column) -> Column:
    """struct<n, mean, z>: the series and its deviations from the mean."""
    level = F.struct(values.alias("v"), F.size(values).cast("double").alias("n"), _sum(values).alias("total"))
    return _bind(
        level,
        lambda s: _bind(
            F.struct(s["v"].alias("v"), s["n"].alias("n"), F.try_divide(s["total"], s["n"]).alias("mean")),
            lambda t: F.struct(
                t["n"].alias("n"), t["mean"].alias("mean"), F.transform(t["v"], lambda y: y - t["mean"]).alias("z")
            ),
        ),
    )


def _squares(z: Column) -> Column:
    return F.aggregate(z, F.lit(0.0), lambda a, x: a + x * x)


def last3(values: Col) -> Column:
    v = as_col(values)
    return F.slice(v, F.greatest(F.size(v) - 2, F.lit(1)), F.lit(3))


def forecast_mean3(values: Col) -> Column:
    recent = last3(values)
    return F.try_divide(_sum(recent), F.size(recent))


def forecast_median3(values: Col) -> Column:
    ordered = F.sort_array(last3(values))
    n = F.size(ordered)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(ordered, low) + F.get(ordered, high)) / 2


def forecast_linear(values: Col) -> Column:
    """Least-squares line over 0..n-1, read at n."""

    def line(s: Column) -> Column:
        middle = (s["n"] - 1) / 2
        moment = _sum(F.transform(s["z"], lambda z, i: z * i))
        slope = F.coalesce(F.try_divide(moment, s["n"] * (s["n"] * s["n"] - 1) / 12), F.lit(0.0))
        return s["mean"] + slope * (s["n"] - middle)

    return _bind(_centred(as_col(values)), line)


def forecast_croston(values: Col, alpha: float = DEFAULTS.croston_alpha) -> Column:
    """Smoothed size of the non-zero months over their smoothed interval."""
    start = F.struct(
        F.lit(-1).alias("last"), F.lit(None).cast("double").alias("size"), F.lit(None).cast("double").alias("every")
    )
    cells = F.transform(as_col(values), lambda y, i: F.struct(y.alias("y"), i.cast("int").alias("i")))

    def smooth(state: Column, x: Column) -> Column:
        return F.coalesce(F.lit(alpha) * x + F.lit(1 - alpha) * state, x)

    def step(acc: Column, cell: Column) -> Column:
        event = F.struct(
            cell["i"].alias("last"),
            smooth(acc["size"], cell["y"]).alias("size"),
            smooth(acc["every"], (cell["i"] - acc["last"]).cast("double")).alias("every"),
        )
        return F.when(cell["y"] > 0, event).otherwise(acc)

    return F.aggregate(cells, start, step, lambda acc: F.coalesce(F.try_divide(acc["size"], acc["every"]), F.lit(0.0)))


def forecast_ar1(values: Col) -> Column:
    """AR(1) with mean by exact Gaussian likelihood on a grid of coefficients.

    The likelihood of a coefficient depends on the series only through a few
    sums, so the grid costs a constant amount per series. A constant series
    predicts its mean.
    """
    one = F.lit(1.0)

    def stats(s: Column) -> Column:
        z, rest = s["z"], F.greatest(F.size(s["z"]) - 1, F.lit(0))
        neighbours = F.zip_with(
            F.slice(z, F.lit(2), rest), F.slice(z, F.lit(1), rest), lambda a, b: a * b
        )
        return F.struct(
            s["n"].alias("n"),
            s["mean"].alias("mean"),
            F.get(z, F.lit(0)).alias("first"),
            F.get(z, F.size(z) - 1).alias("last"),
            _squares(z).alias("squares"),
            _sum(neighbours).alias("cross"),
        )

    def fitted(s: Column, phi: Column) -> Column:
        # The deviations sum to zero, so those without the first sum to -first.
        n1 = s["n"] - 1
        spread = one - phi * phi
        level = (spread * s["first"] + (one - phi) * (phi * s["last"] - s["first"])) / (
            spread + n1 * (one - phi) * (one - phi)
        )

        def scored(mu: Column) -> Column:
            head = s["first"] - mu
            later = s["squares"] - s["first"] * s["first"] + mu * 2 * s["first"] + n1 * mu * mu
            earlier = s["squares"] - s["last"] * s["last"] + mu * 2 * s["last"] + n1 * mu * mu
            products = s["cross"] + mu * (s["first"] + s["last"]) + n1 * mu * mu
            total = spread * head * head + later - phi * 2 * products + phi * phi * earlier
            likelihood = -s["n"] / 2 * F.log(F.greatest(total, F.lit(1e-300)) / s["n"]) + F.log(spread) / 2
            return F.struct(
                F.round(likelihood, 9).alias("likelihood"),
                (-F.abs(phi)).alias("small"),
                (-phi).alias("low"),
                (s["mean"] + mu + phi * (s["last"] - mu)).alias("forecast"),
            )

        return _bind(level, scored)

    grid = F.expr("transform(sequence(-99, 99), k -> k / 100D)")

    def best(s: Column) -> Column:
        return F.when(s["squares"] < 1e-9, s["mean"]).otherwise(
            F.array_max(F.transform(grid, lambda phi: fitted(s, phi)))["forecast"]
        )

    return _bind(_bind(_centred(as_col(values)), stats), best)


def sample_std(values: Col) -> Column:
    return _bind(_centred(as_col(values)), lambda s: F.sqrt(F.try_divide(_squares(s["z"]), s["n"] - 1)))


def candidate_forecasts(series: DataFrame, values: str = "values") -> DataFrame:
    """All five candidates per series, clipped at zero."""
    made = {
        "arima": forecast_ar1(values),
        "linear": forecast_linear(values),
        "mean": forecast_mean3(values),
        "median": forecast_median3(values),
        "intermittent": forecast_croston(values),
    }
    return series.withColumns({name: F.greatest(F.lit(0.0), made[name]) for name in METHODS})


def spread(series: DataFrame) -> DataFrame:
    """Series over all tasks: they are few bytes but much arithmetic, so the count is
    given and not left to size-based coalescing. The later grouping reuses it."""
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return series.repartition(tasks, *SERIES)


def _origins(series: DataFrame, params: Params) -> DataFrame:
    """One row per hold-out month; origin 0 is the whole series, the forecast itself."""
    n = F.size("values")
    held_out = F.greatest(F.lit(0), F.least(F.lit(params.max_origins), n - params.min_months))
    count = F.when(held_out >= 2, held_out).otherwise(F.lit(0))
    return (
        series.withColumn("origin", F.explode(F.sequence(F.lit(0), count)))
        .withColumn("truth", F.when(F.col("origin") > 0, F.get("values", n - F.col("origin"))))
        .withColumn("history", F.slice("values", F.lit(1), n - F.col("origin")))
    )


def select_methods(series: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds method, cv_error and the chosen method's prediction to every series.

    Origins are rows, so the errors are plain averages over them; all columns of
    the series are carried through the grouping, which needs no second scan.
    """
    carried = [c for c in series.columns if c not in SERIES]
    scored = candidate_forecasts(_origins(spread(series), params), "history")
    errors = {m: F.avg(F.abs(F.col(m) - F.col("truth"))) for m in METHODS}
    finals = {m: F.max(F.when(F.col("origin") == 0, F.col(m))) for m in METHODS}
    per_series = scored.groupBy(*SERIES).agg(
        F.max("origin").alias("origins"),
        *[F.any_value(c).alias(c) for c in carried],
        *[F.round(errors[m], 6).alias(f"error_{m}") for m in METHODS],
        *[finals[m].alias(f"final_{m}") for m in METHODS],
    )
    ranked = F.array_min(
        F.array(
            *[
                F.struct(F.col(f"error_{m}").alias("error"), F.lit(k).alias("rank"), F.lit(m).alias("method"))
                for k, m in enumerate(METHODS)
            ]
        )
    )
    near = F.col("error_arima") <= F.col("best.error") * params.ar1_margin
    chosen = F.when(F.col("origins") == 0, "mean").when(near, "arima").otherwise(F.col("best.method"))

    def pick(prefix: str) -> Column:
        out = F.lit(None).cast("double")
        for m in METHODS:
            out = F.when(F.col("method") == m, F.col(f"{prefix}_{m}")).otherwise(out)
        return out

    return (
        per_series.withColumn("best", ranked)
        .withColumn("method", chosen)
        .select(
            *SERIES,
            *carried,
            "method",
            F.when(F.col("origins") > 0, pick("error")).alias("cv_error"),
            pick("final").alias("prediction"),
        )
    )


def forecast_series(series: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Forecast every (non-empty) series given; dormant ones must be dropped before.

    Short series carry their mean, unchanging ones their last amount, and the
    others the method that forecast the held-out months best.
    """
    n = F.size("values")
    constant = (n >= params.min_months) & (F.col("deviation") < 1e-9)
    return (
        select_methods(series.withColumn("deviation", sample_std("values")), params)
        .withColumns(
            {
                "prediction": F.when(constant, F.greatest(F.lit(0.0), F.element_at("values", -1))).otherwise(
                    F.col("prediction")
                ),
                "cv_error": F.when(~constant, F.col("cv_error")),
                "method": F.when(constant, "constant").otherwise(F.col("method")),
            }
        )
        .drop("deviation")
    )


def active(series: DataFrame) -> DataFrame:
    """Series with spending in their last three months."""
    return series.filter((F.size("values") > 0) & (_sum(last3("values")) != 0))


def forecast(spent: DataFrame, as_of: dt.date, params: Params = DEFAULTS) -> DataFrame:
    """Month-ahead forecast of every active (user, category)."""
    basis = F.when(
        F.col("method") == "constant", F.lit("same amount every month")
    ).when(F.size("values") < params.min_months, F.format_string("average of the last %d month(s)", F.size(last3("values")))).otherwise(
        F.format_string("%s on %d completed months", F.col("method"), F.size("values"))
    )
    made = forecast_series(active(month_series(spent, as_of)), params)
    return made.select(
        *SERIES,
        rnd("prediction").alias("amount"),
        "method",
        rnd("cv_error").alias("cv_error"),
        basis.alias("basis"),
        F.transform("values", lambda v: rnd(v)).alias("history"),
        F.transform("months", lambda m: F.date_format(m, "yyyy-MM")).alias("months"),
    )


def backtest_lines(spent: DataFrame, as_of: dt.date, params: Params = DEFAULTS) -> DataFrame:
    """Hold-out forecast of the last completed month, per active category."""
    n = F.size("values")
    train = month_series(spent, as_of).filter(n >= 3).select(
        *SERIES,
        F.slice("values", F.lit(1), n - 1).alias("values"),
        F.element_at("values", -1).alias("actual"),
        F.date_format(F.element_at("months", -1), "yyyy-MM").alias("test_month"),
        n.alias("months_used"),
    )
    return (
        forecast_series(active(train), params)
        .drop("values")
        .withColumn("absolute_error", F.abs(F.col("prediction") - F.col("actual")))
    )


def backtest(lines: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Per account: error of the monthly total (headline) and per category."""
    sums = lines.groupBy("user_id", "test_month", "months_used").agg(
        F.sum("prediction").alias("predicted"),
        F.sum("actual").alias("actual"),
        F.avg("absolute_error").alias("category_mae"),
        F.avg("actual").alias("category_mean"),
        F.count("*").alias("categories"),
    )
    total_error = F.abs(F.col("predicted") - F.col("actual"))
    ratio = F.when(F.col("actual") > 0, total_error / F.col("actual"))
    per_category = F.when(F.col("category_mean") > 0, F.col("category_mae") / F.col("category_mean"))
    return sums.select(
        "user_id",
        "test_month",
        "months_used",
        "categories",
        rnd("predicted").alias("predicted_total"),
        rnd("actual").alias("actual_total"),
        rnd(total_error).alias("mae"),
        rnd(ratio, 4).alias("mae_ratio"),
        rnd("category_mae").alias("per_category_mae"),
        rnd(per_category, 4).alias("per_category_mae_ratio"),
        F.coalesce(F.round(ratio, 8) <= params.max_error_ratio, F.lit(False)).alias("meets_target"),
    )

"""Time-series preparation, forecasting and anomaly flags for many series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from insight_spark.functions import fixed_values as fv
from insight_spark.functions.logs import percent_change, trend_label
from insight_spark.operators.relational import (
    agg_mape,
    agg_parse_ratio,
    date_of,
    holdout_split,
    number_of,
    numeric_columns,
    string_columns,
)
from insight_spark.operators.scale import join_null_safe, previous_in_group

PERIOD_UNITS = {"D": "day", "W": "week", "MS": "month", "QS": "quarter", "YS": "year"}
# Places where a trend may bend, the most bends taken, and the steps of their search.
CANDIDATES, MOST_CHANGES, PENALTIES, SWEEPS = 100, 8, 14, 40
# Futures that are drawn for the band.
DRAWS = 300
FIT_SCHEMA = "ds timestamp, y double, yhat double, yhat_lower double, yhat_upper double"


def detect_date_column(df: DataFrame) -> str | None:
    """First date-named column that parses throughout, else the first text column
    of which at least 80% parses. One pass over the data for all columns."""
    names = [f.name for f in df.schema if f.dataType.typeName() in ("string", "date", "timestamp", "timestamp_ntz")]
    if not names:
        return None
    ratio = {r["column"]: r["date_ratio"] for r in agg_parse_ratio(df, names).collect()}
    hinted = [c for c in names if any(h in c.lower() for h in fv.SERIES_DATE_HINTS)]
    for column in hinted:
        if ratio.get(column) == 1.0:
            return column
    return next((c for c in string_columns(df) if (ratio.get(c) or 0) >= 0.8), None)


def detect_value_column(df: DataFrame, question: str = "") -> str | None:
    """Numeric column the question is about: named in it, sharing words with it,
    a business name, else the first."""
    columns = numeric_columns(df)
    if not columns and string_columns(df):
        ratio = {r["column"]: r["number_ratio"] for r in agg_parse_ratio(df, string_columns(df)).collect()}
        columns = [c for c in df.columns if (ratio.get(c) or 0) >= 0.5]
    if not columns:
        return None
    asked = question.lower()
    named = [c for c in columns if c.lower() in asked]
    if named:
        return named[0]
    words = set(asked.split())
    overlap = [len(words & set(c.lower().replace("_", " ").split())) for c in columns]
    if max(overlap) > 0:
        return columns[overlap.index(max(overlap))]
    business = [c for hint in fv.SERIES_VALUE_HINTS for c in columns if hint in c.lower()]
    return business[0] if business else columns[0]


def prepare(df: DataFrame, keys: list[str], ds: str, y: str, unit: str | None = None, agg: str = "sum") -> DataFrame:
    """(keys, ds, y) with unreadable rows dropped and series below three rows left out.

    ``unit`` (day, week, month, quarter, year) adds up all rows of a period, so a
    series never has more rows than the calendar has periods, however many facts
    it holds.
    """
    typed = df.select(*keys, date_of(df, ds).alias("ds"), number_of(df, y).alias("y")).dropna(subset=["ds", "y"])
    if unit:
        how = {"sum": F.sum, "avg": F.avg}[agg]
        typed = (
            typed.groupBy(*keys, F.date_trunc(unit, "ds").alias("ds")).agg(how("y").alias("y"))
        )
    if not keys:
        return typed.filter(typed.select(F.count("*")).scalar() >= fv.MIN_SERIES_ROWS)
    sizes = typed.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= fv.MIN_SERIES_ROWS)
    return join_null_safe(typed, sizes, keys, "left_semi")


def unreadable_rows(df: DataFrame, keys: list[str], ds: str, y: str) -> DataFrame:
    """Per series how many rows :func:`prepare` leaves out because the date or the number is none."""
    bad = date_of(df, ds).isNull() | number_of(df, y).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(bad).alias("dropped"))


def _days(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / 86_400_000_000)


def date_points(df: DataFrame, keys: list[str], ds: str, tie: str) -> DataFrame:
    """Distinct dates per series: how many rows they have, which comes first, and
    the whole days since the date before.

    Rows of the same date collapse in the partial aggregation, so a date that
    holds a third of all rows is one point.
    """
    points = df.groupBy(*keys, ds).agg(F.count("*").alias("rows"), F.min(tie).alias("first_row"))
    return previous_in_group(points, keys, ds, "previous_ds").withColumn(
        "gap_days", _days(F.col(ds), F.col("previous_ds"))
    )


def date_gaps(df: DataFrame, keys: list[str], ds: str, tie: str) -> DataFrame:
    """Every row with the whole days since the row before it in the same series."""
    points = date_points(df, keys, ds, tie)
    gap = F.when(F.col(tie) == F.col("first_row"), F.col("gap_days")).otherwise(F.lit(0))
    return join_null_safe(df, points, [*keys, ds]).withColumn("gap_days", gap).drop("rows", "first_row", "previous_ds")


def median_gap(points: DataFrame, keys: list[str]) -> DataFrame:
    """Median days between consecutive rows, from :func:`date_points`.

    The further rows of a date are gaps of zero days. The exact median only
    stores the few distinct day counts.
    """
    gaps = points.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("gap_days").alias("gap"), F.lit(1).cast("bigint").alias("times")),
                F.struct(F.lit(0).cast("bigint").alias("gap"), (F.col("rows") - 1).alias("times")),
            )
        ).alias("_g"),
    ).select(*keys, "_g.*")
    return (
        gaps.filter(F.col("gap").isNotNull() & (F.col("times") > 0))
        .groupBy(*keys)
        .agg(F.percentile("gap", 0.5, F.col("times")).alias("median_days"))
    )


def frequency(median_days: Column) -> Column:
    return (
        F.when(median_days.isNull(), F.lit("MS"))
        .when(median_days <= 1, F.lit("D"))
        .when(median_days <= 8, F.lit("W"))
        .when(median_days <= 32, F.lit("MS"))
        .when(median_days <= 95, F.lit("QS"))
        .otherwise(F.lit("YS"))
    )


def future_dates(last: DataFrame, last_ds: str, periods: int = fv.DEFAULT_PERIODS, freq: str = "MS") -> DataFrame:
    """The next ``periods`` period starts after ``last_ds``, one row each."""
    unit = PERIOD_UNITS[freq]
    # Weekly periods end on Sundays, the others start with their calendar unit.
    start = F.date_trunc(unit, last_ds) - F.expr("interval 1 day") if freq == "W" else F.date_trunc(unit, last_ds)
    dates = F.transform(
        F.sequence(F.lit(1), F.lit(periods)),
        lambda i: {
            "D": lambda: F.date_trunc("day", last_ds) + F.make_interval(days=i),
            "W": lambda: start + F.make_interval(weeks=i),
            "MS": lambda: start + F.make_interval(months=i),
            "QS": lambda: start + F.make_interval(months=i * 3),
            "YS": lambda: start + F.make_interval(years=i),
        }[freq](),
    )
    return last.withColumn("ds", F.explode(dates))


def _design(days: np.ndarray, start: float, span: float, weekly: int, yearly: int) -> np.ndarray:
    """Trend line plus Fourier terms of the week and the year, to the given orders."""
    columns = [np.ones_like(days), (days - start) / span]
    for period, order in ((7.0, weekly), (365.25, yearly)):
        for n in range(1, order + 1):
            angle = 2 * np.pi * n * days / period
            columns += [np.sin(angle), np.cos(angle)]
    return np.column_stack(columns)


def _hinges(days: np.ndarray, changes: np.ndarray, span: float) -> np.ndarray:
    """One column per trend change: 0 before it, the time since it after."""
    return np.maximum(0.0, (days[:, None] - changes) / span)


def _least_squares(design: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    return beta, float(((y - design @ beta) ** 2).sum())


def _criterion(rss: float, n: int, terms: int, changes: int, floor: float) -> float:
    """Bayesian information criterion; a change costs its size and its place."""
    return n * np.log(max(rss, floor) / n) + (terms + changes) * np.log(n)


def trend_changes(days: np.ndarray, y: np.ndarray, base: np.ndarray, span: float) -> np.ndarray:
    """Days on which the trend bends, beside the columns of ``base``.

    Candidates are the rows of the middle of the history, every one of them in a short
    series. An L1 penalty on the bends proposes sets of them, coordinate by coordinate for
    falling penalties; each set is fitted freely, cut back while the information criterion
    falls, and the best one is taken. It may be empty.
    """
    n = len(y)
    inner = np.arange(max(1, int(0.08 * n)), int(0.92 * n))
    if n < 12 or not len(inner):
        return np.empty(0)
    places = days[np.unique(np.linspace(inner[0], inner[-1], min(CANDIDATES, len(inner))).astype(int))]
    most = min(MOST_CHANGES, max(1, (n - base.shape[1]) // 8))
    columns = _hinges(days, places, span)
    basis, _ = np.linalg.qr(base)
    rest, target = columns - basis @ (basis.T @ columns), y - basis @ (basis.T @ y)
    gram, toward = rest.T @ rest, rest.T @ target
    size = np.diag(gram).copy()
    floor = 1e-10 * float(((y - y.mean()) ** 2).sum()) + 1e-300
    best, chosen = _criterion(float((target**2).sum()), n, base.shape[1], 0, floor), np.empty(0, int)
    weights, seen = np.zeros(len(places)), set()
    top = np.abs(toward).max(initial=0.0)
    for penalty in top * np.geomspace(0.7, 1e-3, PENALTIES) if top > 0 else ():
        for _ in range(SWEEPS):
            before = weights.copy()
            for j in np.flatnonzero(size > 1e-12):
                pull = toward[j] - gram[j] @ weights + size[j] * weights[j]
                weights[j] = np.sign(pull) * max(0.0, abs(pull) - penalty) / size[j]
            if np.abs(weights - before).max(initial=0.0) <= 1e-6 * (np.abs(weights).max(initial=0.0) + 1e-12):
                break
        active = np.flatnonzero(np.abs(weights) > 1e-9)
        # Of neighbours that share a bend the largest stands for it at first.
        active = np.sort(active[np.argsort(-np.abs(weights[active]), kind="stable")][: 2 * most])
        if tuple(active) in seen or not len(active):
            continue
        seen.add(tuple(active))
        score, kept = _cut_back(base, columns, active, y, floor, most)
        if score < best - 1e-9:
            best, chosen = score, kept
    return places[chosen]


def _cut_back(base, columns, active, y, floor, most) -> tuple[float, np.ndarray]:
    """The best criterion on the way from ``active`` to no change, one change less at a time; at most ``most`` changes."""
    kept, best = list(active), (np.inf, np.empty(0, int))
    while kept:
        _, rss = _least_squares(np.hstack([base, columns[:, kept]]), y)
        score = _criterion(rss, len(y), base.shape[1] + len(kept), len(kept), floor)
        if len(kept) <= most and score < best[0]:
            best = score, np.array(kept)
        if len(kept) == 1:
            break
        less = [
            (_least_squares(np.hstack([base, columns[:, kept[:i] + kept[i + 1 :]]]), y)[1], i) for i in range(len(kept))
        ]
        kept.pop(min(less)[1])
    return best


def _season_orders(gaps: np.ndarray, span: float, rows: int) -> list[tuple[int, int]]:
    """Waves a week and a year that the history can show: two cycles of it, and four rows per term."""
    finest = gaps[gaps > 0].min() if (gaps > 0).any() else 0
    spacing = np.median(gaps[gaps > 0]) if (gaps > 0).any() else 365
    week = 3 if span >= 14 and 0 < finest < 7 and rows > 2 * 8 else 0
    found = []
    for weekly in sorted({0, week}):
        year = int(min(10, 365.25 / (2 * spacing) - 0.5, (rows / 4 - 1 - 2 * weekly) / 2)) if span >= 690 else 0
        found += [(weekly, order) for order in sorted({0, min(2, max(0, year)), max(0, year)})]
    return found


def _ahead_band(ahead: np.ndarray, start: float, span: float, last: float, changes: np.ndarray, bends: np.ndarray, sigma: float) -> np.ndarray:
    """(lower, upper) distance from the prediction for future days: noise, and trend changes as often and as large as
    those of the history, drawn in a fixed sequence."""
    flat = np.column_stack([np.full(len(ahead), -1.96 * sigma), np.full(len(ahead), 1.96 * sigma)])
    if not len(changes) or not len(ahead):
        return flat
    draw = np.random.default_rng(7)
    paths = draw.normal(0, sigma, (DRAWS, len(ahead)))
    horizon = max(ahead[-1] - last, 1e-9)
    for path, count in zip(paths, draw.poisson(len(changes) * horizon / max(last - start, 1.0), DRAWS)):
        at = last + horizon * draw.random(count)
        path += _hinges(ahead, at, span) @ draw.laplace(0, np.abs(bends).mean(), count)
    drawn = np.quantile(paths, [0.025, 0.975], axis=0).T
    widest = np.maximum(np.abs(drawn).max(1), 1.96 * sigma)
    widest = np.maximum.accumulate(widest)
    return np.column_stack([-widest, widest])


def fit_series(pdf: pd.DataFrame, periods: int, freq: str | None, seasonal: bool = True) -> pd.DataFrame:
    """Fit of one series: a trend that bends where the data say so, and seasons that the data choose.

    History and future come with a 95% band, which widens ahead with the changes seen.
    Without ``seasonal`` it is the regression line over time.
    """
    pdf = pdf.sort_values("ds")
    ds = pd.to_datetime(pdf["ds"])
    days = ds.to_numpy().astype("datetime64[us]").astype(float) / 86_400_000_000
    y = pdf["y"].to_numpy(dtype=float)
    gaps = np.floor(np.diff(days))
    if freq is None:
        median = np.median(gaps) if len(gaps) else 30
        limits = [(1, "D"), (8, "W"), (32, "MS"), (95, "QS")]
        freq = next((name for limit, name in limits if median <= limit), "YS")
    # The pandas week ends on Sunday; the other aliases are period starts.
    future = pd.date_range(ds.max(), periods=periods + 1, freq=freq)
    future = future[future > ds.max()][:periods]
    ahead = future.to_numpy().astype("datetime64[us]").astype(float) / 86_400_000_000
    start, span = days[0], max(days[-1] - days[0], 1.0)
    floor = 1e-10 * float(((y - y.mean()) ** 2).sum()) + 1e-300
    choices = []
    for weekly, yearly in _season_orders(gaps, span, len(y)) if seasonal else [(0, 0)]:
        base = _design(days, start, span, weekly, yearly)
        changes = trend_changes(days, y, base, span) if seasonal else np.empty(0)
        history = np.hstack([base, _hinges(days, changes, span)])
        beta, rss = _least_squares(history, y)
        score = _criterion(rss, len(y), history.shape[1], len(changes), floor)
        choices.append((score, len(choices), weekly, yearly, changes, history, beta, rss))
    *_, weekly, yearly, changes, history, beta, rss = min(choices, key=lambda c: c[:2])
    sigma = np.sqrt(rss / max(1, len(y) - history.shape[1]))
    coming = np.hstack([_design(ahead, start, span, weekly, yearly), _hinges(ahead, changes, span)])
    predicted = np.concatenate([history @ beta, coming @ beta])
    bends = beta[len(beta) - len(changes) :]
    band = np.vstack([
        np.tile([-1.96 * sigma, 1.96 * sigma], (len(y), 1)), _ahead_band(ahead, start, span, days[-1], changes, bends, sigma),
    ])
    return pd.DataFrame(
        {
            "ds": np.concatenate([ds.to_numpy(), future.to_numpy()]),
            "y": np.concatenate([y, np.full(len(future), np.nan)]),
            "yhat": predicted,
            "yhat_lower": predicted + band[:, 0],
            "yhat_upper": predicted + band[:, 1],
        }
    )


def forecast(
    series: DataFrame, keys: list[str], periods: int = fv.DEFAULT_PERIODS, freq: str | None = None, seasonal: bool = True
) -> DataFrame:
    """Fit every series and predict its history plus ``periods`` more.

    ``series`` comes from :func:`prepare` with a ``unit``, so that one group is
    bounded by the calendar. ``y`` is null on future rows.
    """
    single = not keys
    if single:
        keys, series = ["_series"], series.withColumn("_series", F.lit(1))
    kept = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fit_series(pdf, periods, freq, seasonal)
        for name, value in zip(keys, key):
            out.insert(0, name, value)
        return out[[*keys, "ds", "y", "yhat", "yhat_lower", "yhat_upper"]]

    typed = series.withColumn("ds", F.col("ds").cast("timestamp"))
    out = typed.groupBy(*keys).applyInPandas(run, f"{kept}, {FIT_SCHEMA}")
    out = out.withColumn("y", F.nanvl("y", F.lit(None).cast("double")))
    return out.drop("_series") if single else out


def forecast_linear(series: DataFrame, keys: list[str]) -> DataFrame:
    """Straight-line fit per series with built-in aggregates: trend, band and size.

    x is the number of months since year 0, so the line extends to any month.
    """
    x = F.year("ds") * 12 + F.month("ds")
    return series.withColumn("x", x.cast("double")).groupBy(*keys).agg(
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.sqrt(F.regr_syy("y", "x") - F.regr_slope("y", "x") * F.regr_sxy("y", "x")).alias("_rss"),
        F.count("*").alias("n"),
        F.max("x").alias("last_x"),
        F.max("ds").alias("last_ds"),
    ).withColumn(
        "band", F.lit(1.96) * F.col("_rss") / F.sqrt(F.greatest(F.col("n") - 2, F.lit(1)).cast("double"))
    ).drop("_rss")


def filter_future(forecasts: DataFrame, actuals: DataFrame, keys: list[str]) -> DataFrame:
    """Forecast rows after the last actual date of their series."""
    if not keys:
        return forecasts.filter(F.col("ds") > actuals.select(F.max("ds")).scalar())
    last = actuals.groupBy(*keys).agg(F.max("ds").alias("_last"))
    return join_null_safe(forecasts, last, keys).filter(F.col("ds") > F.col("_last")).drop("_last")


def outside_band(y: Column, lower: Column, upper: Column) -> Column:
    return (y < lower) | (y > upper)


def join_actual_forecast(actuals: DataFrame, forecasts: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Actuals with the forecast of the same date."""
    return join_null_safe(actuals, forecasts.drop("y"), [*keys, "ds"], how)


def anomalies(joined: DataFrame, keys: list[str]) -> DataFrame:
    """History points outside their band, rounded."""
    return joined.filter(outside_band(F.col("y"), F.col("yhat_lower"), F.col("yhat_upper"))).select(
        *keys,
        F.date_format("ds", "yyyy-MM-dd").alias("ds"),
        F.round("y", 2).alias("y"),
        F.round("yhat", 2).alias("yhat"),
        F.round("yhat_lower", 2).alias("lower"),
        F.round("yhat_upper", 2).alias("upper"),
    )


def chart_rows(forecasts: DataFrame, actuals_per_day: DataFrame, keys: list[str]) -> DataFrame:
    """One row per forecast date: the actual on history days, the forecast only later.

    ``actuals_per_day`` is (keys, day, y), e.g. from ``first_per_day``.
    """
    dated = forecasts.drop("y").withColumn("day", F.to_date("ds"))
    known = actuals_per_day.withColumn("_known", F.lit(True))
    joined = join_null_safe(dated, known, [*keys, "day"], "left")

    def later(column: str) -> Column:
        return F.when(F.col("_known").isNull(), F.round(column, 2))

    return joined.select(
        *keys,
        F.date_format("day", "yyyy-MM-dd").alias("date"),
        F.round("y", 2).alias("actual"),
        later("yhat").alias("forecast"),
        later("yhat_lower").alias("lower"),
        later("yhat_upper").alias("upper"),
    )


def first_last(actuals: DataFrame, future: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: data points, last actual, first and last forecast."""
    past = actuals.groupBy(*keys).agg(
        F.count("*").alias("data_points"), F.max_by("y", "ds").alias("last_actual")
    )
    ahead = future.groupBy(*keys).agg(
        F.min_by("yhat", "ds").alias("next_forecast"), F.max_by("yhat", "ds").alias("last_forecast")
    )
    return join_null_safe(past, ahead, keys, "left")


def summary(actuals: DataFrame, future: DataFrame, flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: points, last actual, next forecast, change, trend, anomaly count."""
    counts = flagged.groupBy(*keys).agg(F.count("*").alias("anomalies"))
    percent = percent_change(F.col("last_actual"), F.col("last_forecast"))
    return (
        join_null_safe(first_last(actuals, future, keys), counts, keys, "left")
        .withColumn("anomalies", F.coalesce("anomalies", F.lit(0)))
        .withColumn("pct_change", F.round(percent, 1))
        .withColumn("trend", trend_label(percent))
        .withColumn("last_actual", F.round("last_actual", 2))
        .withColumn("next_forecast", F.round("next_forecast", 2))
        .drop("last_forecast")
    )


def backtest(series: DataFrame, keys: list[str], freq: str | None = None, seasonal: bool = True) -> tuple[DataFrame, DataFrame]:
    """(error per held-out period, mean error per series) for series of at least eight rows.

    The last rows of a series are held out, the rest is fitted; the n-th held-out
    row is compared with the n-th predicted period.
    """
    sizes = series.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= 8)
    long_enough = join_null_safe(series, sizes, keys, "left_semi")
    split = holdout_split(long_enough.withColumn("_tie", F.lit(0)), keys, "ds", "_tie")
    train = split.filter(F.col("part") == "train").select(*keys, "ds", "y")
    window = Window.partitionBy(*keys).orderBy("ds")
    test = split.filter(F.col("part") == "test").withColumn("period", F.row_number().over(window))
    predicted = (
        forecast(train, keys, 6, freq, seasonal)
        .filter(F.col("y").isNull())
        .withColumn("period", F.row_number().over(window))
    )
    paired = join_null_safe(
        test.select(*keys, "period", F.col("y").alias("actual")),
        predicted.select(*keys, "period", F.col("yhat").alias("predicted")), [*keys, "period"],
    )
    return agg_mape(paired, "actual", "predicted", [*keys, "period"]), agg_mape(paired, "actual", "predicted", keys)


def inject_anomaly(series: DataFrame, keys: list[str], factor: float = 10.0) -> DataFrame:
    """Multiply the row at position max(2, n // 3) of every series; it is marked ``injected``."""
    window = Window.partitionBy(*keys).orderBy("ds")
    sizes = series.groupBy(*keys).agg(F.greatest(F.lit(2), F.floor(F.count("*") / 3)).alias("_at"))
    return (
        join_null_safe(series, sizes, keys)
        .withColumn("injected", F.row_number().over(window) - 1 == F.col("_at"))
        .withColumn("y", F.when(F.col("injected"), F.col("y") * factor).otherwise(F.col("y")))
        .drop("_at")
    )

"""Time series from events (daily) and orders (monthly)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from insight_spark.operators import forecast as fc
from insight_spark.operators import relational as rel
from insight_spark.plans.registry import Tables, query


def daily(t: Tables) -> DataFrame:
    """Sum of event values per type and day: (event_type, ds, y)."""
    return fc.prepare(t.events, ["event_type"], "ts", "value", "day")


def monthly(t: Tables) -> DataFrame:
    """Order totals per status and month: (o_orderstatus, ds, y)."""
    return fc.prepare(t.orders, ["o_orderstatus"], "o_orderdate", "o_totalprice", "month")


DAILY_SQL = "daily AS (SELECT event_type, date_trunc('day', ts) AS ds, sum(value) AS y FROM events GROUP BY ALL)"
MONTHLY_SQL = "monthly AS (SELECT o_orderstatus, date_trunc('month', o_orderdate) AS ds, sum(o_totalprice) AS y FROM orders GROUP BY ALL)"
# Naive forecast for the relational parts: last week's value with a fixed band.
NAIVE_SQL = """naive AS (SELECT event_type, ds + INTERVAL 7 DAY AS ds, y AS yhat, y * 0.8::DOUBLE AS yhat_lower, y * 1.2::DOUBLE AS yhat_upper FROM daily)"""


def naive(series: DataFrame) -> DataFrame:
    return series.select(
        "event_type", (F.col("ds") + F.expr("interval 7 days")).alias("ds"), F.col("y").alias("yhat"),
        (F.col("y") * 0.8).alias("yhat_lower"), (F.col("y") * 1.2).alias("yhat_upper"),
    )


def day_text(name: str = "ds"):
    return F.date_format(name, "yyyy-MM-dd").alias("day")


@query("ts_prepare", f"WITH {DAILY_SQL} SELECT event_type, strftime(ds, '%Y-%m-%d') AS day, round(y, 2) AS y FROM daily")
def ts_prepare(t: Tables) -> DataFrame:
    return daily(t).select("event_type", day_text(), F.round("y", 2).alias("y"))


@query("ts_prepare_rows", """
SELECT user_id, count(*) AS n, min(strftime(ts, '%Y-%m-%d')) AS first_day FROM events GROUP BY user_id HAVING count(*) >= 3""")
def ts_prepare_rows(t: Tables) -> DataFrame:
    """Raw rows per user; users with fewer than three rows are left out."""
    rows = fc.prepare(t.events, ["user_id"], "ts", "value")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.date_format(F.min("ds"), "yyyy-MM-dd").alias("first_day"))


GAPS_SQL = """
e AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
gaps AS (SELECT user_id, event_id, CAST(floor((epoch_us(ts) - epoch_us(p)) / 86400000000::DOUBLE) AS BIGINT) AS gap_days FROM e)"""


def user_gaps(t: Tables) -> DataFrame:
    return fc.date_gaps(t.events.select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id")


@query("win_date_gap", f"WITH {GAPS_SQL} SELECT user_id, event_id, gap_days FROM gaps")
def win_date_gap(t: Tables) -> DataFrame:
    return user_gaps(t).select("user_id", "event_id", "gap_days")


@query("agg_median_gap", f"WITH {GAPS_SQL} SELECT user_id, median(gap_days) AS median_days FROM gaps WHERE gap_days IS NOT NULL GROUP BY user_id")
def agg_median_gap(t: Tables) -> DataFrame:
    points = fc.date_points(t.events.select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id")
    return fc.median_gap(points, ["user_id"])


@query("ts_infer_freq", f"""
WITH {MONTHLY_SQL}, g AS (SELECT o_orderstatus, date_diff('day', lag(ds) OVER (PARTITION BY o_orderstatus ORDER BY ds), ds) AS gap FROM monthly)
SELECT o_orderstatus, CASE WHEN median(gap) <= 1 THEN 'D' WHEN median(gap) <= 8 THEN 'W' WHEN median(gap) <= 32 THEN 'MS'
 WHEN median(gap) <= 95 THEN 'QS' ELSE 'YS' END AS freq FROM g WHERE gap IS NOT NULL GROUP BY o_orderstatus""")
def ts_infer_freq(t: Tables) -> DataFrame:
    points = fc.date_points(monthly(t).withColumn("tie", F.lit(0)), ["o_orderstatus"], "ds", "tie")
    return fc.median_gap(points, ["o_orderstatus"]).select("o_orderstatus", fc.frequency(F.col("median_days")).alias("freq"))


@query("ts_future_dates", f"""
WITH {MONTHLY_SQL}, l AS (SELECT o_orderstatus, max(ds) AS last FROM monthly GROUP BY o_orderstatus)
SELECT o_orderstatus, strftime(last + to_months(CAST(i AS INTEGER)), '%Y-%m-%d') AS day FROM l, range(1, 7) r(i)""")
def ts_future_dates(t: Tables) -> DataFrame:
    last = monthly(t).groupBy("o_orderstatus").agg(F.max("ds").alias("last"))
    return fc.future_dates(last, "last", 6, "MS").select("o_orderstatus", day_text())


@query("filter_future", f"""
WITH {DAILY_SQL}, {NAIVE_SQL} SELECT event_type, strftime(ds, '%Y-%m-%d') AS day, round(yhat, 2) AS yhat FROM naive n
WHERE ds > (SELECT max(ds) FROM daily d WHERE d.event_type = n.event_type)""")
def filter_future(t: Tables) -> DataFrame:
    series = daily(t)
    return fc.filter_future(naive(series), series, ["event_type"]).select("event_type", day_text(), F.round("yhat", 2).alias("yhat"))


@query("join_actual_forecast", f"""
WITH {DAILY_SQL}, {NAIVE_SQL} SELECT d.event_type, strftime(d.ds, '%Y-%m-%d') AS day, round(d.y, 2) AS y, round(n.yhat, 2) AS yhat
FROM daily d LEFT JOIN naive n ON d.event_type = n.event_type AND d.ds = n.ds""")
def join_actual_forecast(t: Tables) -> DataFrame:
    series = daily(t)
    joined = fc.join_actual_forecast(series, naive(series), ["event_type"])
    return joined.select("event_type", day_text(), F.round("y", 2).alias("y"), F.round("yhat", 2).alias("yhat"))


@query("filter_outside_band", f"""
WITH {DAILY_SQL}, b AS (SELECT event_type, avg(y) - 1.0::DOUBLE * stddev_samp(y) AS lo, avg(y) + 1.0::DOUBLE * stddev_samp(y) AS hi FROM daily GROUP BY event_type)
SELECT event_type, strftime(ds, '%Y-%m-%d') AS day, round(y, 2) AS y FROM daily JOIN b USING (event_type) WHERE y < lo OR y > hi""")
def filter_outside_band(t: Tables) -> DataFrame:
    series = daily(t)
    band = series.groupBy("event_type").agg(
        (F.avg("y") - F.stddev_samp("y")).alias("lo"), (F.avg("y") + F.stddev_samp("y")).alias("hi")
    )
    hits = series.join(band, "event_type").filter(fc.outside_band(F.col("y"), F.col("lo"), F.col("hi")))
    return hits.select("event_type", day_text(), F.round("y", 2).alias("y"))


@query("ts_anomalies", f"""
WITH {DAILY_SQL}, {NAIVE_SQL} SELECT d.event_type, strftime(d.ds, '%Y-%m-%d') AS ds, round(y, 2) AS y, round(yhat, 2) AS yhat,
 round(yhat_lower, 2) AS lower, round(yhat_upper, 2) AS upper FROM daily d JOIN naive n ON d.event_type = n.event_type AND d.ds = n.ds
WHERE y < yhat_lower OR y > yhat_upper""")
def ts_anomalies(t: Tables) -> DataFrame:
    series = daily(t)
    return fc.anomalies(fc.join_actual_forecast(series, naive(series), ["event_type"]), ["event_type"])


@query("ts_chart_rows", f"""
WITH {DAILY_SQL}, {NAIVE_SQL}, f AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, arg_min(value, (ts, event_id)) AS v FROM events GROUP BY ALL)
SELECT n.event_type, strftime(n.ds, '%Y-%m-%d') AS date, round(f.v, 2) AS actual, CASE WHEN f.day IS NULL THEN round(yhat, 2) END AS forecast,
 CASE WHEN f.day IS NULL THEN round(yhat_lower, 2) END AS lower, CASE WHEN f.day IS NULL THEN round(yhat_upper, 2) END AS upper
FROM naive n LEFT JOIN f ON f.event_type = n.event_type AND f.day = strftime(n.ds, '%Y-%m-%d')""")
def ts_chart_rows(t: Tables) -> DataFrame:
    first = rel.first_per_day(t.events.withColumnRenamed("value", "y"), ["event_type"], "ts", "event_id", "y")
    return fc.chart_rows(naive(daily(t)), first, ["event_type"])


FIRST_LAST_SQL = f"""
{DAILY_SQL}, {NAIVE_SQL}, lastday AS (SELECT event_type, max(ds) AS m FROM daily GROUP BY event_type),
fut AS (SELECT n.* FROM naive n JOIN lastday l ON n.event_type = l.event_type AND n.ds > l.m),
past AS (SELECT event_type, count(*) AS data_points, arg_max(y, ds) AS last_actual FROM daily GROUP BY event_type),
ahead AS (SELECT event_type, arg_min(yhat, ds) AS next_forecast, arg_max(yhat, ds) AS last_forecast FROM fut GROUP BY event_type)"""


@query("win_first_last", f"""
WITH {FIRST_LAST_SQL} SELECT event_type, data_points, round(last_actual, 2) AS last_actual, round(next_forecast, 2) AS next_forecast,
 round(last_forecast, 2) AS last_forecast FROM past JOIN ahead USING (event_type)""")
def win_first_last(t: Tables) -> DataFrame:
    series = daily(t)
    out = fc.first_last(series, fc.filter_future(naive(series), series, ["event_type"]), ["event_type"])
    return out.select("event_type", "data_points", *[F.round(c, 2).alias(c) for c in ("last_actual", "next_forecast", "last_forecast")])


@query("ts_summary", f"""
WITH {FIRST_LAST_SQL}, an AS (SELECT d.event_type, count(*) AS anomalies FROM daily d JOIN naive n ON d.event_type = n.event_type AND d.ds = n.ds
 WHERE y < yhat_lower OR y > yhat_upper GROUP BY d.event_type),
p AS (SELECT *, (last_forecast - last_actual) * 100 / last_actual AS pct FROM past JOIN ahead USING (event_type))
SELECT event_type, data_points, round(last_actual, 2) AS last_actual, round(next_forecast, 2) AS next_forecast, coalesce(anomalies, 0) AS anomalies,
 round(pct, 1) AS pct_change, CASE WHEN pct > 2 THEN 'upward' WHEN pct < -2 THEN 'downward' ELSE 'stable' END AS trend
FROM p LEFT JOIN an USING (event_type)""")
def ts_summary(t: Tables) -> DataFrame:
    series = daily(t)
    guess = naive(series)
    flagged = fc.anomalies(fc.join_actual_forecast(series, guess, ["event_type"]), ["event_type"])
    return fc.summary(series, fc.filter_future(guess, series, ["event_type"]), flagged, ["event_type"])


@query("agg_mape", f"""
WITH {DAILY_SQL}, {NAIVE_SQL} SELECT d.event_type, round(avg(abs((y - yhat) / nullif(y, 0))) * 100, 4) AS mape_pct, count(*) FILTER (y <> 0) AS periods
FROM daily d JOIN naive n ON d.event_type = n.event_type AND d.ds = n.ds GROUP BY d.event_type""")
def agg_mape(t: Tables) -> DataFrame:
    series = daily(t)
    return rel.agg_mape(fc.join_actual_forecast(series, naive(series), ["event_type"], "inner"), "y", "yhat", ["event_type"])


@query("ts_forecast_linear", f"""
WITH {MONTHLY_SQL}, x AS (SELECT *, (year(ds) * 12 + month(ds))::DOUBLE AS x FROM monthly)
SELECT o_orderstatus, round(regr_slope(y, x), 4) AS slope, round(regr_slope(y, x) * (max(x) + 1) + regr_intercept(y, x), 2) AS next_forecast, count(*) AS n,
 round(1.96::DOUBLE * sqrt(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / sqrt(count(*) - 2), 2) AS band FROM x GROUP BY o_orderstatus""")
def ts_forecast_linear(t: Tables) -> DataFrame:
    fit = fc.forecast_linear(monthly(t), ["o_orderstatus"])
    ahead = F.col("slope") * (F.col("last_x") + 1) + F.col("intercept")
    return fit.select(
        "o_orderstatus", F.round("slope", 4).alias("slope"), F.round(ahead, 2).alias("next_forecast"), "n", F.round("band", 2).alias("band")
    )


TREND_SQL = f"""
{MONTHLY_SQL}, d AS (SELECT *, epoch_us(ds) / 86400000000::DOUBLE AS x FROM monthly),
line AS (SELECT o_orderstatus, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, max(ds) AS last, count(*) AS n,
 1.96::DOUBLE * sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / greatest(count(*) - 2, 1)) AS band
 FROM d GROUP BY o_orderstatus HAVING count(*) >= 3)"""


@query("ts_forecast_trend", f"""
WITH {TREND_SQL}, f AS (SELECT *, last + to_months(CAST(i AS INTEGER)) AS ds FROM line, range(1, 7) r(i))
SELECT o_orderstatus, strftime(ds, '%Y-%m-%d') AS day, round(a * epoch_us(ds) / 86400000000::DOUBLE + b, 2) AS yhat,
 round(a * epoch_us(ds) / 86400000000::DOUBLE + b - band, 2) AS yhat_lower, round(a * epoch_us(ds) / 86400000000::DOUBLE + b + band, 2) AS yhat_upper FROM f""")
def ts_forecast_trend(t: Tables) -> DataFrame:
    """The grouped fit without seasons is the regression line."""
    ahead = fc.forecast(monthly(t), ["o_orderstatus"], 6, "MS", seasonal=False).filter("y IS NULL")
    return ahead.select("o_orderstatus", day_text(), *[F.round(c, 2).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")])


BENT_SQL = f"""
{MONTHLY_SQL}, i AS (SELECT o_orderstatus, ds, row_number() OVER (PARTITION BY o_orderstatus ORDER BY ds) - 1 AS i,
 count(*) OVER (PARTITION BY o_orderstatus) AS n, max(ds) OVER (PARTITION BY o_orderstatus) AS last, epoch_us(ds) / 86400000000::DOUBLE AS x FROM monthly),
bend AS (SELECT o_orderstatus, any_value(last) AS last, any_value(n) AS n, min(x) AS x0, max(x) FILTER (i = n // 2) AS xb FROM i GROUP BY o_orderstatus HAVING any_value(n) >= 12)"""


def bent(t: Tables) -> DataFrame:
    """The months of every status with a made value: 2 a day more, from the middle month on 5 a day less."""
    order = Window.partitionBy("o_orderstatus").orderBy("ds")
    days = F.unix_micros(F.col("ds").cast("timestamp")) / 86_400_000_000
    numbered = monthly(t).withColumns({"x": days, "i": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("o_orderstatus"))})
    middle = numbered.groupBy("o_orderstatus").agg(
        F.min("x").alias("x0"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("x"))).alias("xb"), F.max("n").alias("m")
    )
    value = 2 * (F.col("x") - F.col("x0")) - 5 * F.greatest(F.lit(0.0), F.col("x") - F.col("xb"))
    return numbered.join(middle.filter("m >= 12"), "o_orderstatus").select("o_orderstatus", "ds", value.alias("y"))


@query("ts_forecast_bend", f"""
WITH {BENT_SQL}, f AS (SELECT *, last + to_months(CAST(k AS INTEGER)) AS ds FROM bend, range(1, 7) r(k))
SELECT o_orderstatus, strftime(ds, '%Y-%m-%d') AS day,
 round(2 * (epoch_us(ds) / 86400000000::DOUBLE - x0) - 5 * (epoch_us(ds) / 86400000000::DOUBLE - xb), 1) AS yhat FROM f""")
def ts_forecast_bend(t: Tables) -> DataFrame:
    """A planted bend is found where it is, so the forecast follows the last slope."""
    ahead = fc.forecast(bent(t), ["o_orderstatus"], 6, "MS").filter("y IS NULL")
    return ahead.select("o_orderstatus", day_text(), F.round("yhat", 1).alias("yhat"))


@query("ts_backtest_trend", f"""
WITH {MONTHLY_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY o_orderstatus) AS n,
 row_number() OVER (PARTITION BY o_orderstatus ORDER BY ds DESC) AS back, epoch_us(ds) / 86400000000::DOUBLE AS x FROM monthly),
h AS (SELECT *, back <= greatest(2, least(6, floor(n * 0.2))) AS test FROM c WHERE n >= 8),
line AS (SELECT o_orderstatus, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, max(ds) AS last FROM h WHERE NOT test GROUP BY o_orderstatus),
p AS (SELECT h.o_orderstatus, h.y, row_number() OVER (PARTITION BY h.o_orderstatus ORDER BY h.ds) AS period FROM h WHERE test),
f AS (SELECT o_orderstatus, i AS period, a * epoch_us(last + to_months(CAST(i AS INTEGER))) / 86400000000::DOUBLE + b AS yhat FROM line, range(1, 7) r(i))
SELECT p.o_orderstatus, round(avg(abs((y - yhat) / nullif(y, 0))) * 100, 4) AS mape_pct, count(*) FILTER (y <> 0) AS periods
FROM p JOIN f ON p.o_orderstatus = f.o_orderstatus AND p.period = f.period GROUP BY p.o_orderstatus""")
def ts_backtest_trend(t: Tables) -> DataFrame:
    return fc.backtest(monthly(t), ["o_orderstatus"], "MS", seasonal=False)[1]


@query("ts_injected_rows", f"""
WITH {MONTHLY_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM monthly)
SELECT o_orderstatus, strftime(ds, '%Y-%m-%d') AS day, round(y * 10, 2) AS y FROM c WHERE n >= 3 AND i = greatest(2, floor(n / 3.0))""")
def ts_injected_rows(t: Tables) -> DataFrame:
    """The month of every status that the injection multiplies by ten."""
    bent = fc.inject_anomaly(monthly(t), ["o_orderstatus"])
    return bent.filter("injected").select("o_orderstatus", day_text(), F.round("y", 2).alias("y"))


@query("ts_forecast")
def ts_forecast(t: Tables) -> DataFrame:
    """Six more months per order status with a 95% band."""
    return fc.forecast(monthly(t), ["o_orderstatus"], 6)


@query("ts_forecast_daily")
def ts_forecast_daily(t: Tables) -> DataFrame:
    return fc.forecast(daily(t), ["event_type"], 6)


@query("ts_backtest")
def ts_backtest(t: Tables) -> DataFrame:
    return fc.backtest(monthly(t), ["o_orderstatus"])[1]


@query("ts_anomaly_injection")
def ts_anomaly_injection(t: Tables) -> DataFrame:
    """Multiply one month per status by ten, refit, and list what is flagged."""
    bent = fc.inject_anomaly(monthly(t), ["o_orderstatus"])
    fitted = fc.forecast(bent.drop("injected"), ["o_orderstatus"], 1)
    flagged = fc.anomalies(
        fc.join_actual_forecast(bent.withColumn("ds", F.col("ds").cast("timestamp")), fitted, ["o_orderstatus"], "inner"), ["o_orderstatus"]
    )
    injected = bent.filter("injected").select("o_orderstatus", F.date_format("ds", "yyyy-MM-dd").alias("injected_ds"))
    return flagged.join(injected, "o_orderstatus").withColumn("is_injected", F.col("ds") == F.col("injected_ds"))


@query("ts_detect_date", "SELECT count(*) AS row_count, 'o_orderdate' AS date_column FROM orders")
def ts_detect_date(t: Tables) -> DataFrame:
    """The date column of the orders when all columns are read as text."""
    texts = t.orders.select(*[F.col(c).cast("string").alias(c) for c in t.orders.columns])
    column = fc.detect_date_column(texts)
    return texts.agg(F.count("*").alias("row_count")).withColumn("date_column", F.lit(column))


@query("ts_detect_value", """
SELECT n AS row_count, unnest(['o_totalprice', 'o_totalprice', 'o_custkey']) AS value_column FROM (SELECT count(*) AS n FROM orders)""")
def ts_detect_value(t: Tables) -> DataFrame:
    """The value column of the orders for each of three wordings of a question."""
    asked = ["forecast o_totalprice", "forecast the next months", "what about o custkey"]
    row = t.orders.agg(F.count("*").alias("row_count"))
    found = F.array(*[F.lit(fc.detect_value_column(t.orders, q)) for q in asked])
    return row.withColumn("value_column", F.explode(found))

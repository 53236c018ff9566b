from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from insight_spark.operators import forecast as fc


def months(n, start=(2020, 1)):
    year, month = start
    return [datetime(year + (month - 1 + i) // 12, (month - 1 + i) % 12 + 1, 1) for i in range(n)]


@pytest.fixture(scope="module")
def line(spark):
    rows = [("a", d, 100.0 + 5 * i) for i, d in enumerate(months(24))] + [("b", d, 50.0) for d in months(24)]
    return spark.createDataFrame(rows, "s string, ds timestamp_ntz, y double")


def test_line_goes_on(line):
    out = fc.forecast(line, ["s"], 6)
    assert out.count() == 2 * 30
    ahead = out.filter("s = 'a' and y is null").orderBy("ds").collect()
    assert [r["ds"].strftime("%Y-%m") for r in ahead] == ["2022-01", "2022-02", "2022-03", "2022-04", "2022-05", "2022-06"]
    assert [r["yhat"] for r in ahead] == pytest.approx([220 + 5 * i for i in range(6)], rel=0.01)
    flat = out.filter("s = 'b'").collect()
    assert all(r["yhat"] == pytest.approx(50) and r["yhat_lower"] <= r["yhat"] + 1e-6 for r in flat)


def test_season_is_found(spark):
    start = datetime(2024, 1, 1)
    rows = [("w", start + timedelta(days=i), 10.0 + (20.0 if i % 7 == 5 else 0.0)) for i in range(70)]
    series = spark.createDataFrame(rows, "s string, ds timestamp_ntz, y double")
    ahead = fc.forecast(series, ["s"], 7).filter("y is null").orderBy("ds").collect()
    assert max(ahead, key=lambda r: r["yhat"])["ds"] == start + timedelta(days=75)


def test_prepare_drops_and_adds_up(spark):
    rows = [("a", "2024-01-01", "1"), ("a", "2024-01-01", "2"), ("a", "bad", "3"), ("a", "2024-01-02", "x"), ("a", "2024-01-03", "4"), ("a", "2024-01-04", "5"), ("b", "2024-01-01", "1"), ("b", "2024-01-02", "1")]
    df = spark.createDataFrame(rows, "s string, d string, v string")
    got = fc.prepare(df, ["s"], "d", "v", "day").orderBy("ds").collect()
    assert [(r["s"], r["ds"].day, r["y"]) for r in got] == [("a", 1, 3.0), ("a", 3, 4.0), ("a", 4, 5.0)]
    assert fc.prepare(df, ["s"], "d", "v").count() == 4
    assert fc.prepare(df, [], "d", "v", "day").count() == 4


@pytest.mark.parametrize("days,expected", [(1, "D"), (7, "W"), (30, "MS"), (91, "QS"), (365, "YS")])
def test_frequencies(spark, days, expected):
    rows = [("a", datetime(2020, 1, 1) + timedelta(days=days * i), i) for i in range(6)]
    df = spark.createDataFrame(rows, "s string, ds timestamp_ntz, i int")
    gap = fc.median_gap(fc.date_points(df, ["s"], "ds", "i"), ["s"])
    assert gap.select(fc.frequency(F.col("median_days"))).first()[0] == expected


@pytest.mark.parametrize("freq,expected", [
    ("D", ["2024-03-16", "2024-03-17"]), ("W", ["2024-03-17", "2024-03-24"]), ("MS", ["2024-04-01", "2024-05-01"]),
    ("QS", ["2024-04-01", "2024-07-01"]), ("YS", ["2025-01-01", "2026-01-01"]),
])
def test_future_dates(spark, freq, expected):
    df = spark.sql("select timestamp_ntz'2024-03-15 00:00:00' as last")
    got = fc.future_dates(df, "last", 2, freq).orderBy("ds").collect()
    assert [r["ds"].strftime("%Y-%m-%d") for r in got] == expected


def test_injected_outlier_is_flagged(line):
    bent = fc.inject_anomaly(line, ["s"])
    at = {r["s"]: r["ds"] for r in bent.filter("injected").collect()}
    assert at["a"] == months(24)[8]
    fitted = fc.forecast(bent.drop("injected"), ["s"], 1)
    flagged = fc.anomalies(fc.join_actual_forecast(bent.withColumn("ds", F.col("ds").cast("timestamp")), fitted, ["s"], "inner"), ["s"])
    assert {(r["s"], r["ds"]) for r in flagged.collect()} == {("a", "2020-09-01"), ("b", "2020-09-01")}


def test_backtest_of_a_line_is_exact(line):
    per_period, mean = fc.backtest(line, ["s"])
    assert per_period.filter("s = 'a'").count() == 4
    assert all(r["mape_pct"] < 1 for r in mean.collect())


def test_detect_columns(spark):
    df = spark.createDataFrame([("2024-01-05", "x", 1, 2.0, 3)], "order_day string, kind string, store_id int, unit_price double, quantity int")
    assert fc.detect_date_column(df) == "order_day"
    assert fc.detect_value_column(df, "forecast quantity") == "quantity"
    assert fc.detect_value_column(df, "how does the price go") == "unit_price"
    assert fc.detect_value_column(df, "what comes next") == "unit_price"
    texts = spark.createDataFrame([("a", "5"), ("b", "7")], "label string, n string")
    assert fc.detect_date_column(texts) is None
    assert fc.detect_value_column(texts) == "n"


def test_two_years_of_months_show_their_season(spark):
    import math

    rows = [("s", d, 100 + 20 * math.sin(2 * math.pi * i / 12)) for i, d in enumerate(months(24))]
    series = spark.createDataFrame(rows, "s string, ds timestamp, y double")
    ahead = fc.forecast(series, ["s"], 12, "MS").filter("y IS NULL").orderBy("ds").collect()
    assert len(ahead) == 12
    assert all(abs(r["yhat"] - (100 + 20 * math.sin(2 * math.pi * i / 12))) < 4 for i, r in enumerate(ahead))


def test_series_with_null_keys_and_dates(spark):
    day = "timestamp'2024-01-0{}'"
    frame = spark.sql(" UNION ALL ".join(
        f"SELECT {key} AS k, {day.format(i)} AS t, {i}.0D AS v" for key in ("NULL", "'a'") for i in range(1, 5)
    ) + " UNION ALL SELECT NULL, NULL, 1.0D")
    kept = fc.prepare(frame, ["k"], "t", "v")
    assert {(r["k"], r["count"]) for r in kept.groupBy("k").count().collect()} == {(None, 4), ("a", 4)}
    dropped = {r["k"]: (r["rows"], r["dropped"]) for r in fc.unreadable_rows(frame, ["k"], "t", "v").collect()}
    assert dropped == {None: (5, 1), "a": (4, 0)}
    gaps = fc.date_gaps(frame.withColumn("i", F.monotonically_increasing_id()), ["k"], "t", "i")
    assert gaps.count() == 9 and gaps.filter("gap_days = 1").count() == 6


def bent_series(noise, seed=3, n=72, bend=40):
    import numpy as np

    rng = np.random.default_rng(seed)
    return [(d, 100 + 4.0 * i - 9.0 * max(0, i - bend) + float(rng.normal(0, noise))) for i, d in enumerate(months(n))]


def fitted(rows, periods=6, seasonal=True):
    import pandas as pd

    return fc.fit_series(pd.DataFrame(rows, columns=["ds", "y"]), periods, "MS", seasonal)


def test_a_bend_is_found():
    out = fitted(bent_series(0.0))
    days = [(d - datetime(2020, 1, 1)).days for d in months(78)]
    slope = (out["yhat"].iloc[-1] - out["yhat"].iloc[-6]) / (days[-1] - days[-6])
    assert slope == pytest.approx(-5 / 30.4, rel=0.05)
    noisy = fitted(bent_series(4.0), 12)
    truth = [100 + 4.0 * i - 9.0 * max(0, i - 40) for i in range(72, 84)]
    ahead = noisy.iloc[72:]
    assert sum(lo <= t <= hi for t, lo, hi in zip(truth, ahead["yhat_lower"], ahead["yhat_upper"])) >= 11


def test_the_band_widens_ahead_only_with_changes():
    wide = lambda out: (out["yhat_upper"] - out["yhat_lower"]).to_numpy()
    bent = wide(fitted(bent_series(4.0), 24))
    assert bent[-1] > 1.5 * bent[0] and (bent[73:] >= bent[72:-1] - 1e-9).all()
    import numpy as np

    straight = wide(fitted([(d, 5.0 * i + float(np.random.default_rng(i).normal(0, 2))) for i, d in enumerate(months(72))], 24))
    assert straight[-1] == pytest.approx(straight[0])


def test_bends_lower_the_error_of_the_backtest(spark):
    rows = [("s", d, y) for d, y in bent_series(3.0, n=72, bend=30)]
    series = spark.createDataFrame(rows, "s string, ds timestamp, y double")
    bent = fc.backtest(series, ["s"], "MS")[1].first()["mape_pct"]
    line = fc.backtest(series, ["s"], "MS", seasonal=False)[1].first()["mape_pct"]
    assert bent < 0.3 * line


def test_noise_alone_neither_bends_nor_has_seasons():
    import numpy as np

    bends = 0
    for seed in range(12):
        rng = np.random.default_rng(seed)
        days = np.arange(60) * 30.0
        bends += len(fc.trend_changes(days, 3 + days / 50 + rng.normal(0, 5, 60), fc._design(days, 0.0, days[-1], 0, 0), days[-1]))
    assert bends <= 3


def test_season_and_bend_together():
    import math

    rows = [(d, y + 15 * math.sin(2 * math.pi * i / 12)) for i, (d, y) in enumerate(bent_series(1.0))]
    out = fitted(rows, 12)
    truth = [100 + 4.0 * i - 9.0 * max(0, i - 40) + 15 * math.sin(2 * math.pi * i / 12) for i in range(72, 84)]
    assert max(abs(a - b) for a, b in zip(out["yhat"].iloc[72:], truth)) < 12

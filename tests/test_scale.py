"""Skew-safe building blocks against plain Python, with one hot group."""

import random
import statistics

import pytest

from pyspark.sql import Window, functions as F

from insight_spark.operators import forecast as fc, scale


def sample(spark, n=2000):
    rng = random.Random(7)
    # Key 0 holds about a third of the rows, and one value is repeated a lot.
    rows = [
        (0 if rng.random() < 0.33 else rng.randrange(1, 9), i, 5.0 if rng.random() < 0.3 else round(rng.uniform(-50, 400), 2))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "k int, i long, v double")


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 50])
def test_value_at_index_per_group_and_overall(spark, rows_per_bucket):
    rows, df = sample(spark)
    got = {r["k"]: r["p"] for r in scale.value_at_index(df, ["k"], "v", 0.95, "p", rows_per_bucket).collect()}
    for key in {r[0] for r in rows}:
        values = sorted(r[2] for r in rows if r[0] == key)
        assert got[key] == values[int(0.95 * len(values))]
    values = sorted(r[2] for r in rows)
    assert scale.value_at_index(df, [], "v", 0.95, "p", rows_per_bucket).first()["p"] == values[int(0.95 * len(values))]


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 50])
def test_number_rows_overall_and_per_key(spark, rows_per_bucket):
    rows, df = sample(spark)
    got = {r["i"]: r["no"] for r in scale.number_rows(df, ["v", "i"], "no", None, rows_per_bucket).collect()}
    for number, row in enumerate(sorted(rows, key=lambda r: (r[2], r[1]))):
        assert got[row[1]] == number
    per_key = {r["i"]: r["no"] for r in scale.number_rows(df, ["i"], "no", ["k"], rows_per_bucket).collect()}
    hot = sorted(r[1] for r in rows if r[0] == 0)
    assert [per_key[i] for i in hot] == list(range(len(hot)))


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 50])
def test_previous_in_group_equals_lag(spark, rows_per_bucket):
    _, df = sample(spark)
    dated = df.select("k", F.timestamp_seconds((F.col("v") * 86400).cast("long") + 1_700_000_000).alias("ts")).distinct()
    spread = scale.previous_in_group(dated, ["k"], "ts", "p", rows_per_bucket)
    plain = dated.withColumn("p", F.lag("ts").over(Window.partitionBy("k").orderBy("ts")))
    assert sorted(map(tuple, spread.select("k", "ts", "p").collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_gaps_with_a_hot_date(spark):
    rows, df = sample(spark)
    dated = df.select("k", "i", F.timestamp_seconds((F.col("v") * 86400).cast("long") + 1_700_000_000).alias("ts"))
    got = {r["i"]: r["gap_days"] for r in fc.date_gaps(dated, ["k"], "ts", "i").collect()}
    medians = {r["k"]: r["median_days"] for r in fc.median_gap(fc.date_points(dated, ["k"], "ts", "i"), ["k"]).collect()}
    for key in {r[0] for r in rows}:
        times = sorted((int(r[2] * 86400), r[1]) for r in rows if r[0] == key)
        gaps = [(b[0] - a[0]) // 86400 for a, b in zip(times, times[1:])]
        assert [got[i] for _, i in times] == [None, *gaps]
        assert medians[key] == statistics.median(gaps)


def test_top_n_with_and_without_salt(spark):
    rows, df = sample(spark, 5000)
    salted = scale.top_n_per_group(df, ["k"], [F.col("v"), F.col("i")], 1200, salt_on=["i"], salts=4)
    expected = sorted((r for r in rows if r[0] == 0), key=lambda r: (r[2], r[1]))[:1200]
    got = [r["i"] for r in salted.filter("k = 0").orderBy("rank").collect()]
    assert got == [r[1] for r in expected]


def test_group_limit_runs_before_the_shuffle(spark):
    _, df = sample(spark)
    plan = scale.top_n_per_group(df, ["k"], [F.col("v")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_null_keys_and_values_survive_several_ranges(spark):
    from pyspark.sql import Window, functions as F

    from insight_spark.operators.scale import number_rows, previous_in_group, value_at_index

    rows = [(k, v, i) for i, (k, v) in enumerate((k, v) for k in (None, 1, 2) for v in (None, float("nan"), *map(float, range(40))))]
    frame = spark.createDataFrame(rows, "k int, v double, i int")
    plain = Window.partitionBy("k").orderBy("v", "i")
    want = {r["i"]: r["n"] for r in frame.withColumn("n", F.row_number().over(plain) - 1).collect()}
    got = {r["i"]: r["n"] for r in number_rows(frame, ["v", "i"], "n", ["k"], rows_per_bucket=10).collect()}
    assert got == want
    dated = frame.filter("NOT isnan(v) OR v IS NULL").withColumn("t", F.timestamp_seconds("v")).select("k", "t").distinct()
    lagged = {(r["k"], r["t"]): r["p"] for r in dated.withColumn("p", F.lag("t").over(Window.partitionBy("k").orderBy("t"))).collect()}
    assert {(r["k"], r["t"]): r["previous"] for r in previous_in_group(dated, ["k"], "t", rows_per_bucket=10).collect()} == lagged
    at = value_at_index(frame.filter("NOT isnan(v)"), ["k"], "v", 0.5, "m", rows_per_bucket=10)
    assert {(r["k"], r["m"]) for r in at.collect()} == {(None, 20.0), (1, 20.0), (2, 20.0)}


def test_lookup_keeps_hot_keys_out_of_the_shuffle(spark):
    """A third of the rows share a key; they meet the table by broadcast, the rest by shuffle."""
    from pyspark.sql import functions as F

    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100_000).alias("k"), F.lit("a").alias("s"))
    rows = scale.kept(rows.unionByName(spark.sql("SELECT -1L AS id, CAST(NULL AS BIGINT) AS k, 'a' AS s")), "rows")
    table = spark.range(200_000).select(F.col("id").alias("k"), F.lit("a").alias("s"), (F.col("id") * 2).alias("v")).filter("k % 5 <> 3")
    found = scale.lookup(rows, table, ["k", "s"])
    want = rows.join(table, ["k", "s"], "left")
    assert found.count() == 30_001 and found.exceptAll(want.select(found.columns)).count() == 0
    hot = rows.groupBy("k").count().filter(F.col("count") * scale.HOT_SHARE > 30_001)
    assert hot.count() == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan
    assert scale.lookup(rows, table, ["k", "s"], least=10**6).exceptAll(want.select(found.columns)).count() == 0

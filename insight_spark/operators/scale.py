"""Building blocks that keep large or skewed inputs spread over the cluster."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from insight_spark.session import fresh_path

# Spark turns "row_number() <= n" into a per-task limit ahead of the shuffle
# only up to this n (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT_PUSHDOWN = 1000
# A key that more than one row in so many has is hot; there are fewer hot keys than this.
HOT_SHARE = 10_000
# Rows up to which a hot key is no burden for one task.
HOT_LEAST = 100_000
# An input below this size may be dealt anew to use all cores.
SPREAD_BYTES = 256 << 20
# Rows of one Arrow batch of texts or files for Python, so that it is bounded however large the input is.
BATCH_ROWS = 256
# Score cells computed at once inside a task.
BLOCK_CELLS = 4_000_000


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys appear once, from the left."""
    if not keys:  # one group: the constant is the key
        one = F.lit(1)
        return join_null_safe(left.withColumn("_one", one), right.withColumn("_one", one), ["_one"], how).drop("_one")
    renamed = right.select(
        *[F.col(f"`{k}`").alias(f"_key_{i}") for i, k in enumerate(keys)],
        *[F.col(f"`{c}`") for c in right.columns if c not in keys],
    )
    same = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(renamed[f"_key_{i}"]) for i, k in enumerate(keys)])
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_key_{i}" for i in range(len(keys))])


def lookup(rows: DataFrame, table: DataFrame, keys: str | list[str], least: int = 0) -> DataFrame:
    """``rows`` left join ``table``, which has one row per key, without a task that holds a hot key.

    A key that more than one row in HOT_SHARE has is hot, so there are fewer hot keys than
    that: their rows meet their table rows by broadcast, all others by shuffle. ``rows`` is
    read three times, so it should be a written table; up to ``least`` rows no key is hot.
    A key with a null finds nothing.
    """
    keys = [keys] if isinstance(keys, str) else keys
    total = rows.count()
    if total <= least:
        return rows.join(table, keys, "left")
    marks = [f"_hot_{i}" for i in range(len(keys))]
    sizes = rows.groupBy(*[F.col(k).alias(m) for k, m in zip(keys, marks)]).count()
    hot = kept(sizes.filter(F.col("count") * HOT_SHARE > total).select(*marks), "hot-keys")
    is_hot = reduce(lambda a, b: a & b, [F.col(k) == F.col(m) for k, m in zip(keys, marks)])
    found = kept(table.join(F.broadcast(hot), is_hot).drop(*marks), "hot")
    few = rows.join(F.broadcast(hot), is_hot, "left_semi").join(F.broadcast(found), keys, "left")
    many = rows.join(F.broadcast(hot), is_hot, "left_anti").join(table, keys, "left")
    return few.unionByName(many)


def spread_small(df: DataFrame) -> DataFrame:
    """Use all cores for heavy per-row work on a scan of few row groups.

    Only an input below 256 MB is dealt anew, so a large one is never shuffled
    for this, however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size > SPREAD_BYTES or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def top_n_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    rank: str = "rank",
    salt_on: list[str] | None = None,
    salts: int = 64,
) -> DataFrame:
    """First ``n`` rows of each group with their position, skew-safe.

    Up to 1000 rows Spark trims each task's groups before the shuffle. Above that
    ``salt_on`` spreads a group over ``salts`` parts that are each trimmed to ``n``
    first; the final window then sees at most ``salts * n`` rows.
    """
    if n > GROUP_LIMIT_PUSHDOWN and salt_on:
        part = F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int")
        inner = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", part)
            .withColumn("_pos", F.row_number().over(inner))
            .filter(F.col("_pos") <= n)
            .drop("_part", "_pos")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def previous_in_group(
    df: DataFrame, keys: list[str], order: str, out: str = "previous", rows_per_bucket: int = 1_000_000
) -> DataFrame:
    """``lag(order)`` per group for a timestamp that is distinct within its group,
    without sorting a whole group in one task.

    Rows are sorted inside (group, time range); the first row of a range takes the
    latest time of the range before it, found on the short per-range summary.
    """
    timed = df.withColumn("_time", F.unix_micros(F.col(order).cast("timestamp")))
    spread = range_bucket(timed, "_time", "_range", rows_per_bucket).drop("_time")
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    heads = (
        spread.groupBy(*keys, "_range")
        .agg(F.max(order).alias("_top"))
        .withColumn("_before", F.lag("_top").over(Window.partitionBy(*keys).orderBy("_range")))
        .drop("_top")
    )
    ranked = spread.withColumn("_inside", F.lag(order).over(inside))
    return (
        join_null_safe(ranked, heads, [*keys, "_range"])
        .withColumn(out, F.coalesce("_inside", "_before"))
        .drop("_range", "_inside", "_before")
    )


def range_bucket(df: DataFrame, column: str, out: str, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Number of the ordered value range each row falls into; null is before all, NaN after.

    The cut points are approximate quantiles, read once (at most 10,000 numbers)
    and then fixed, so a task that runs again puts every row in the same range.
    """
    from pyspark.ml.feature import Bucketizer

    buckets = int(min(10_000, df.count() // rows_per_bucket))
    if buckets < 2:
        return df.withColumn(out, F.lit(0))
    typed = df.withColumn("_cut", F.col(column).cast("double"))
    cuts = typed.approxQuantile("_cut", [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    filled = typed.withColumn("_filled", F.coalesce("_cut", F.lit(float("nan"))))
    placed = Bucketizer(splits=splits, inputCol="_filled", outputCol=out, handleInvalid="keep").transform(filled)
    number = F.when(F.col("_cut").isNull(), F.lit(-1)).otherwise(F.col(out).cast("int"))
    return placed.withColumn(out, number).drop("_cut", "_filled")


def number_rows(
    df: DataFrame, order: list[str], out: str, keys: list[str] | None = None, rows_per_bucket: int = 1_000_000
) -> DataFrame:
    """Row numbers from 0 by ``order`` (a number first), overall or per key.

    Rows are ranked inside value ranges; the rows before a range come from its
    size. Neither the table nor a hot key is ever sorted in one task.
    """
    keys = keys or []
    ranged = range_bucket(df, order[0], "_range", rows_per_bucket)
    before = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_rows_before", F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_rows"))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    ranked = ranged.withColumn("_inside", F.row_number().over(inside) - 1)
    return (
        join_null_safe(ranked, before, [*keys, "_range"])
        .withColumn(out, F.col("_rows_before") + F.col("_inside"))
        .drop("_range", "_inside", "_rows_before")
    )


def value_at_index(
    df: DataFrame, keys: list[str], value: str, fraction: float, out: str, rows_per_bucket: int = 1_000_000
) -> DataFrame:
    """``sorted(values)[int(fraction * n)]`` per group, exactly.

    Equal values are counted first, so a hot value is one row. Of the ordered
    value ranges only the one that holds the wanted position is ranked.
    """
    base = df.filter(F.col(value).isNotNull()).select(*keys, value)
    counts = kept(base.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "value-counts")
    ranged = range_bucket(counts, "_v", "_range", rows_per_bucket)
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("_size"))
    ordered = Window.partitionBy(*keys).orderBy("_range")
    whole = Window.partitionBy(*keys)
    holder = (
        sizes.withColumn("_end", F.sum("_size").over(ordered))
        .withColumn("_want", F.floor(F.sum("_size").over(whole) * F.lit(fraction)))
        .filter((F.col("_want") < F.col("_end")) & (F.col("_want") >= F.col("_end") - F.col("_size")))
        .select(*keys, "_range", "_want", (F.col("_end") - F.col("_size")).alias("_start"))
    )
    inside = Window.partitionBy(*keys).orderBy("_v")
    return (
        join_null_safe(ranged, holder, [*keys, "_range"])
        .withColumn("_upto", F.col("_start") + F.sum("_c").over(inside))
        .filter(F.col("_want") < F.col("_upto"))
        .groupBy(*keys)
        .agg(F.min("_v").alias(out))
    )


def small_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of the session hold more than BATCH_ROWS rows. It cannot be set back: it is read when a plan runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """What runs inside, and not only is planned there, hands Python Arrow batches of at most ``rows`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: nothing to release, nothing to lose."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_best(
    probe: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score descending, id ascending) entries of every probe."""
    order = np.lexsort((ids, -scores, probe))
    probe, ids, scores = probe[order], ids[order], scores[order]
    if not len(probe):
        return probe, ids, scores
    starts = np.concatenate(([0], np.flatnonzero(np.diff(probe)) + 1))
    lengths = np.diff(np.concatenate((starts, [len(probe)])))
    keep = np.arange(len(probe)) - np.repeat(starts, lengths) < k
    return probe[keep], ids[keep], scores[keep]


def best_of_block(
    block: np.ndarray, probes: np.ndarray, ids: np.ndarray, k: int, floor: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a probes x rows score block that can still be among the k best."""
    if block.shape[1] > k:
        kth = -np.partition(-block, k - 1, axis=1)[:, k - 1 : k]
        mask = (block >= kth) & (block > floor)
    else:
        mask = block > floor
    row, column = np.nonzero(mask)
    return keep_best(probes[row], ids[column], block[row, column], k)


def merge_best(parts: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return keep_best(*(np.concatenate([part[i] for part in parts]) for i in range(3)), k)

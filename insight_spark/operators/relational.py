"""Projection, filter, join, sort and set shapes asked of business tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from insight_spark.functions import fixed_values as fv
from insight_spark.functions.logs import is_not_available
from insight_spark.functions.text import month_number
from insight_spark.operators.scale import join_null_safe

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


# --- Projection and filters -------------------------------------------------

def project_named(df: DataFrame, columns: dict[str, Column], digits: int = 2) -> DataFrame:
    """Select named expressions; floating results are rounded."""
    shaped = df.select(*[expr.alias(name) for name, expr in columns.items()])
    return shaped.select(
        *[
            F.round(f.name, digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in shaped.schema
        ]
    )


def filter_max_row(df: DataFrame, value: str, lowest: bool = False) -> DataFrame:
    """All rows that hold the global maximum (or minimum) of ``value``."""
    extreme = df.select((F.min if lowest else F.max)(value)).scalar()
    return df.filter(F.col(value) == extreme)


def bucket(value: Column, bands: list[tuple[float, str]], rest: str) -> Column:
    """Band label: the first lower limit that the value reaches."""
    (limit, label), *others = bands
    chain = F.when(value >= limit, F.lit(label))
    for limit, label in others:
        chain = chain.when(value >= limit, F.lit(label))
    return chain.otherwise(F.lit(rest))


def filter_contains_ci(df: DataFrame, column: str, needle: str) -> DataFrame:
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.filter(F.col(column).ilike(f"%{escaped}%"))


def coerce_numeric(value: Column) -> Column:
    """Number, or null when the text is none. Only plain decimal notation counts: a type
    suffix as in "12d" or a name as in "NaN" is no number."""
    return F.when(value.cast("string").rlike(fv.NUMBER), value.try_cast("double"))


def number_of(df: DataFrame, column: str) -> Column:
    """The column as a double; only text is looked at cell by cell, other kinds are no numbers."""
    kind = df.schema[column].dataType
    if isinstance(kind, NUMERIC_TYPES):
        return F.col(column).cast("double")
    return coerce_numeric(F.col(column)) if isinstance(kind, T.StringType) else F.lit(None).cast("double")


def date_of(df: DataFrame, column: str) -> Column:
    """The column as a timestamp; dates and timestamps are taken as they are."""
    kind = df.schema[column].dataType.typeName()
    return F.col(column).cast("timestamp_ntz") if kind in ("date", "timestamp", "timestamp_ntz") else coerce_date(F.col(column))


# How a date may be written, and the format that reads it.
DATE_FORMATS = [
    (r"^[0-9]{4}$", "yyyy"),
    (r"^[0-9]{4}-[0-9]{1,2}$", "yyyy-M"),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    (r"^[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}$", "yyyy.M.d"),
    (r"^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])$", "yyyyMMdd"),
    (r"^(?:1[3-9]|2[0-9]|3[01])/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}$", "M/d/yyyy H:mm"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "M/d/yyyy H:mm:ss"),
    (r"^[0-9]{4}[Qq][1-4]$", "yyyy'Q'q"),
    (r"^[A-Za-z]{3}-[0-9]{4}$", "MMM-yyyy"),
    (r"^[A-Za-z]{3} [0-9]{1,2} [0-9]{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]{4,} [0-9]{1,2} [0-9]{4}$", "MMMM d yyyy"),
    (r"^[A-Za-z]{4,} [0-9]{1,2}, [0-9]{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} [0-9]{4}$", "MMM yyyy"),
    (r"^[A-Za-z]{4,} [0-9]{4}$", "MMMM yyyy"),
    (r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"),
    (r"^[0-9]{1,2}[- ][A-Za-z]{3}[- ][0-9]{4}$", "d-MMM-yyyy"),
]


def coerce_date(value: Column) -> Column:
    """Timestamp, or null when the value is none. A bare number only counts as a
    four-digit year from 1678 to 2261."""
    text = F.trim(value.cast("string"))
    chain = F.when(text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), text.try_cast("timestamp_ntz"))
    for pattern, fmt in DATE_FORMATS:
        shown = F.replace(text, F.lit(" "), F.lit("-")) if fmt == "d-MMM-yyyy" else text
        if "Q" in fmt:  # a quarter is its first month
            month = F.lpad(((F.right(text, F.lit(1)).try_cast("int") - 1) * 3 + 1).cast("string"), 2, "0")
            shown, fmt = F.concat(F.left(text, F.lit(4)), month), "yyyyMM"
        read = F.try_to_timestamp(shown, F.lit(fmt)).cast("timestamp_ntz")
        if fmt == "yyyy":
            read = F.when(text.between("1678", "2261"), read)
        chain = chain.when(text.rlike(pattern), read)
    return chain


def guard_empty_or_sentinel(df: DataFrame, order: list[str]) -> DataFrame:
    """One row: ``row_count``, ``not_available`` and the fixed ``answer`` if so.

    Not available means no row at all, or a first row (by ``order``) with one of
    the "not available" phrases in a cell.
    """
    cells = F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])
    found = df.select(F.struct(*order).alias("_key"), is_not_available(cells).alias("_flag")).agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.min_by("_flag", "_key"), F.lit(True)).alias("not_available"),
    )
    return found.withColumn(
        "answer", F.when(F.col("not_available"), F.lit(fv.NOT_AVAILABLE_TABLE_ANSWER))
    )


def filter_allowed_tables(tables: DataFrame, allowed: DataFrame, name: str = "table_name") -> DataFrame:
    """Only the tables a session may query."""
    return tables.join(allowed.select(name), name, "left_semi")


# --- Joins ------------------------------------------------------------------

def join_left_count(
    parents: DataFrame, children: DataFrame, parent_key: str, child_key: str,
    order: list[Column], limit: int = fv.LISTED_CONVERSATIONS, count: str = "message_count",
) -> DataFrame:
    """Parents with their number of children, in ``order``, at most ``limit``.

    The limit looks at parent columns only, so it runs before the join: the
    children are filtered to the few listed parents before they are counted.
    """
    listed = parents.orderBy(*order).limit(limit)
    counts = (
        children.join(listed.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")
        .groupBy(child_key)
        .agg(F.count("*").alias(count))
        .withColumnRenamed(child_key, parent_key)
    )
    return (
        listed.join(counts, parent_key, "left")
        .fillna(0, [count])
        .orderBy(*order)
    )


def join_semi_distinct(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents with at least one of the given children."""
    return parents.join(children, parents[parent_key] == children[child_key], "left_semi")


def join_inner_group(
    parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, by: str, count: str
) -> DataFrame:
    """Children of the given parents, counted per ``by`` (nulls left out)."""
    hits = children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")
    return hits.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias(count))


def join_star(fact: DataFrame, dimensions: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Fact joined with its dimensions on foreign key = primary key.

    No hint: Catalyst broadcasts a dimension only while its size stays below
    ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges it otherwise.
    """
    return reduce(
        lambda df, dim: df.join(dim[0], df[dim[1]] == dim[0][dim[2]]), dimensions, fact
    )


# --- Sorts and limits -------------------------------------------------------

def sort_topn(df: DataFrame, group: list[str], value: Column, name: str, n: int = 50) -> DataFrame:
    """Groups ordered by an aggregate, largest first; ties by group."""
    return (
        df.groupBy(*group).agg(value.alias(name)).orderBy(F.desc_nulls_last(name), *group).limit(n)
    )


def sort_month_names(df: DataFrame, order: list[str]) -> DataFrame:
    """Calendar order when a column named like "month" starts with a month form.

    Only the first row (by ``order``) is looked at; the sort itself is distributed.
    """
    named = [c for c in df.columns if "month" in c.lower()]
    if named:
        first = df.orderBy(*order).select(
            *[month_number(F.col(c).cast("string")).alias(c) for c in named]
        ).first()
        for column in named:
            if first is not None and first[column] is not None:
                rank = month_number(F.col(column).cast("string"))
                return df.orderBy(F.asc_nulls_last(rank), *order)
    return df


def limit_preview(df: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first 100 rows with a 10-row preview flag, one-row summary)."""
    numbered = (
        df.orderBy(*order)
        .limit(fv.DATA_ROWS)
        .withColumn("row_no", F.row_number().over(Window.orderBy(*order)))
        .withColumn("in_preview", F.col("row_no") <= fv.PREVIEW_ROWS)
    )
    summary = df.agg(F.count("*").alias("row_count")).select(
        "row_count",
        F.lit(", ".join(df.columns)).alias("columns"),
        F.least("row_count", F.lit(fv.DATA_ROWS)).alias("data_rows"),
        F.least("row_count", F.lit(fv.PREVIEW_ROWS)).alias("preview_rows"),
        (F.col("row_count") > fv.DATA_ROWS).alias("truncated"),
    )
    return numbered, summary


def result_text(df: DataFrame, order: list[str]) -> DataFrame:
    """A query result as one text: nothing, a single value, or a bullet list.

    The list shows the preview rows; the row count covers the whole result.
    """
    shown = df.orderBy(*order).limit(fv.PREVIEW_ROWS)
    cells = F.concat_ws(
        ", ",
        *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in df.columns],
    )
    lines = shown.select(F.struct(*order).alias("_key"), F.concat(F.lit("• "), cells, F.lit("\n")).alias("_line"))
    body = lines.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_key", "_line"))), lambda r: r["_line"]), "").alias("_body"),
    )
    total = df.agg(F.count("*").alias("n"), F.min(F.col(df.columns[0]).cast("string")).alias("one"))
    both = body.withColumn("_t", total.select(F.struct("n", "one")).scalar()).select(
        "_body", F.col("_t.n").alias("_n"), F.col("_t.one").alias("_one")
    )
    many = F.concat(
        F.lit("Found "), F.col("_n").cast("string"), F.lit(" result(s):\n\n"), F.col("_body"),
        F.when(
            F.col("_n") > fv.DATA_ROWS,
            F.concat(F.lit("\n(showing first 10 of "), F.col("_n").cast("string"), F.lit(" rows)")),
        ).otherwise(F.lit("")),
    )
    text = F.when(F.col("_n") == 0, F.lit("No results found."))
    if len(df.columns) == 1:
        text = text.when(F.col("_n") == 1, F.concat(F.lit("Result: "), F.coalesce("_one", F.lit("None"))))
    return both.select(text.otherwise(many).alias("text"))


# --- Aggregates -------------------------------------------------------------

def agg_basic(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """COUNT, SUM, AVG, MIN and MAX of one column, globally or per group."""
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("row_count"),
        F.round(F.sum(value), 2).alias("total"),
        F.round(F.avg(value), 2).alias("average"),
        F.min(value).alias("smallest"),
        F.max(value).alias("largest"),
    )


def agg_top_group(
    df: DataFrame, group: str, value: str, how: str = "sum", lowest: bool = False, n: int = 1
) -> DataFrame:
    """Group with the highest or lowest total (or average); ties by group."""
    agg = {"sum": F.sum, "avg": F.avg}[how]
    name = {"sum": "total", "avg": "average"}[how]
    order = F.asc_nulls_last(name) if lowest else F.desc_nulls_last(name)
    return (
        df.groupBy(group).agg(F.round(agg(value), 2).alias(name)).orderBy(order, group).limit(n)
    )


def agg_rate(df: DataFrame, band: Column, condition: Column, value: str) -> DataFrame:
    """Percentage of rows that meet a condition per band, highest band first."""
    return (
        df.groupBy(band.alias("band"))
        .agg(
            F.round(F.count_if(condition) * 100.0 / F.count("*"), 1).alias("rate_pct"),
            F.count("*").alias("row_count"),
            F.min(value).alias("_from"),
        )
        .orderBy(F.desc("_from"))
        .drop("_from")
    )


def agg_bucket_mean(df: DataFrame, band: Column, value: str) -> DataFrame:
    return df.groupBy(band.alias("band")).agg(
        F.round(F.avg(value), 2).alias("average"), F.count("*").alias("row_count")
    )


def agg_by_month(df: DataFrame, ts: str, value: str) -> DataFrame:
    return df.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.count("*").alias("row_count"), F.round(F.sum(value), 2).alias("total")
    )


def unpivot_strings(df: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    """(ids, column, value) with every listed column read as text."""
    cast = df.select(*(ids or []), *[F.col(c).cast("string").alias(c) for c in columns])
    return cast.unpivot(ids or [], columns, "column", "value")


def unpivot_numbers(df: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    cast = df.select(*(ids or []), *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(ids or [], columns, "column", "value")


def agg_distinct_values(df: DataFrame, columns: list[str] | None = None, n: int = fv.SHOWN_VALUES) -> DataFrame:
    """Up to ``n`` distinct non-null values per text column, in value order."""
    values = (
        unpivot_strings(df, columns or string_columns(df)).filter(F.col("value").isNotNull()).distinct()
    )
    window = Window.partitionBy("column").orderBy("value")
    return values.withColumn("value_no", F.row_number().over(window)).filter(F.col("value_no") <= n)


def agg_nunique(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct values per column and their ratio to the rows, in one pass.

    Exact counting shuffles every distinct value once per column; for very wide
    or near-unique columns ``approximate`` keeps one small sketch per column.
    """
    columns = columns or df.columns
    count = F.approx_count_distinct if approximate else F.count_distinct
    row = df.agg(F.count("*").alias("_n"), *[count(F.col(c)).alias(c) for c in columns])
    return row.unpivot(["_n"], columns, "column", "n_unique").select(
        "column", "n_unique", F.round(F.try_divide("n_unique", "_n"), 6).alias("ratio")
    )


def agg_value_counts(df: DataFrame, columns: list[str], n: int = fv.OVERVIEW_VALUES) -> DataFrame:
    """The ``n`` most frequent values of each column with counts; ties by value."""
    counts = (
        unpivot_strings(df, columns)
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    window = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= n)


def agg_min_max_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Range and mean of numeric columns; columns without values are left out."""
    row = df.agg(
        *[
            F.struct(
                F.min(c).cast("double").alias("smallest"),
                F.max(c).cast("double").alias("largest"),
                F.avg(c).alias("average"),
            ).alias(c)
            for c in columns
        ]
    )
    long = row.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("r")
    )
    return long.select("r.column", "r.s.*").filter(F.col("smallest").isNotNull())


def agg_group_mean(df: DataFrame, group: str, columns: list[str], most: int | None = fv.GROUP_MEANS) -> DataFrame:
    """Mean of numeric columns, ``most`` of them, per group of at least two rows.

    A grouping column with more than 20 values gives no groups at all.
    """
    columns = columns[:most]
    means = (
        df.filter(F.col(group).isNotNull())
        .groupBy(F.col(group).cast("string").alias("group_value"))
        .agg(F.count("*").alias("row_count"), *[F.round(F.avg(c), 4).alias(f"avg_{c}") for c in columns])
    )
    groups = means.select(F.count("*")).scalar()
    return means.filter((F.col("row_count") >= fv.MIN_GROUP_ROWS) & (groups <= fv.MAX_GROUPS))


def agg_parse_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of non-null cells per column that read as a date and as a number."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, date_ratio double, number_ratio double")
    counts = df.agg(*[
        measure.alias(f"{name}_{i}")
        for i, c in enumerate(columns)
        for name, measure in (
            ("n", F.count(F.col(f"`{c}`"))),
            ("d", F.count_if(date_of(df, c).isNotNull())),
            ("x", F.count_if(number_of(df, c).isNotNull())),
        )
    ])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("n"), F.col(f"d_{i}").alias("d"), F.col(f"x_{i}").alias("x"))
        for i, c in enumerate(columns)
    ])
    return counts.select(F.explode(rows).alias("r")).filter("r.n > 0").select(
        "r.column", F.round(F.col("r.d") / F.col("r.n"), 6).alias("date_ratio"),
        F.round(F.col("r.x") / F.col("r.n"), 6).alias("number_ratio"),
    )


def agg_total_cells(df: DataFrame, order: list[str]) -> DataFrame:
    """Integer sum of every numeric cell of the preview rows of a result."""
    numbers = numeric_columns(df)
    per_row = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers), F.lit(0.0))
    preview = df.orderBy(*order).limit(fv.PREVIEW_ROWS)
    return preview.agg(F.sum(per_row).cast("bigint").alias("total"))


def agg_dominant(df: DataFrame, key: str, source: str, rank: str, top: int = 3) -> DataFrame:
    """Most common source among the ``top`` ranked rows per key, "mixed" below two."""
    counts = df.filter(F.col(rank) <= top).groupBy(key, source).agg(F.count("*").alias("_n"), F.min(rank).alias("_r"))
    best = counts.groupBy(key).agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col("_r"), F.col(source).alias("s"))).alias("_b")
    )
    return best.select(
        key, F.when(F.col("_b.n") <= -2, F.col("_b.s")).otherwise(F.lit("mixed")).alias("dominant")
    )


def agg_text_block(df: DataFrame, keys: list[str], line: str, order: str, separator: str = "\n") -> DataFrame:
    """Lines of a group as one text. Use it on groups whose line count is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l"))))
    return df.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda r: r["l"]), separator).alias("text_block")
    )


def agg_accuracy(df: DataFrame, expected: str, predicted: str, by: str | None = None) -> DataFrame:
    """Correct, total and accuracy in percent, overall or per category."""
    groups = [F.col(by)] if by else []
    return df.groupBy(*groups).agg(
        F.count_if(F.col(expected) == F.col(predicted)).alias("correct"),
        F.count("*").alias("total"),
        F.round(F.count_if(F.col(expected) == F.col(predicted)) * 100.0 / F.count("*"), 1).alias("accuracy_pct"),
    )


def agg_confusion(df: DataFrame, expected: str, predicted: str, labels: list) -> DataFrame:
    """Expected rows by predicted columns; absent pairs are 0."""
    return (
        df.groupBy(F.col(expected).alias("expected"))
        .pivot(predicted, labels)
        .count()
        .fillna(0)
    )


def agg_mape(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Mean absolute percentage error over rows with a non-zero actual."""
    error = F.abs(F.try_divide(F.col(actual) - F.col(predicted), F.nullif(F.col(actual), F.lit(0.0)))) * 100
    return df.groupBy(*(by or [])).agg(F.round(F.avg(error), 4).alias("mape_pct"), F.count(error).alias("periods"))


# --- Windows ----------------------------------------------------------------

def head_per_group(
    df: DataFrame, group: str, order: list[str], n: int = fv.GROUP_LINES
) -> DataFrame:
    """First ``n`` rows per group and how many more there are."""
    window = Window.partitionBy(group).orderBy(*order)
    first = df.withColumn("line_no", F.row_number().over(window)).filter(F.col("line_no") <= n)
    sizes = df.groupBy(group).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return join_null_safe(first, sizes, [group])


def latest_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("from_end", F.row_number().over(window)).filter(F.col("from_end") <= n)


def first_per_day(df: DataFrame, keys: list[str], ts: str, tie: str, value: str) -> DataFrame:
    """Earliest value per calendar day, by partial aggregation only."""
    return (
        df.groupBy(*keys, F.to_date(ts).alias("day"))
        .agg(F.min(F.struct(F.col(ts).alias("_t"), F.col(tie).alias("_i"), F.col(value).alias("_v"))).alias("_f"))
        .select(*keys, "day", F.col("_f._v").alias(value))
    )


def holdout_split(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """Label the last ``max(2, min(6, 20%))`` rows of every series as test.

    At most six rows per series are ranked; the others are compared with the
    earliest test row.
    """
    sizes = df.groupBy(*keys).agg(
        F.greatest(F.lit(2), F.least(F.lit(6), F.floor(F.count("*") * F.lit(0.2)))).alias("_n")
    )
    window = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie))
    edge = (
        df.select(*keys, order, tie)
        .withColumn("_back", F.row_number().over(window))
        .filter(F.col("_back") <= 6)
        .transform(lambda last: join_null_safe(last, sizes, keys))
        .filter(F.col("_back") <= F.col("_n"))
        .groupBy(*keys)
        .agg(F.min(F.struct(order, tie)).alias("_edge"))
    )
    part = F.when(F.struct(order, tie) >= F.col("_edge"), F.lit("test")).otherwise(F.lit("train"))
    return join_null_safe(df, edge, keys).withColumn("part", part).drop("_edge")


def keep_latest(df: DataFrame, keys: list[str], updated: list[str], others: list[str]) -> DataFrame:
    """Newest row per key, e.g. an upserted state."""
    newest = F.max(F.struct(*updated, *others)).alias("_new")
    return df.groupBy(*keys).agg(newest).select(*keys, "_new.*")


def state_upsert(current: DataFrame, changes: DataFrame, key: str, updated: str) -> DataFrame:
    """Insert or replace: the row with the newest ``updated`` wins, a change wins a tie."""
    others = [c for c in current.columns if c not in (key, updated)]
    both = current.withColumn("_new", F.lit(0)).unionByName(
        changes.select(*current.columns).withColumn("_new", F.lit(1))
    )
    return keep_latest(both, [key], [updated, "_new"], others).select(*current.columns)


def distinct_columns(df: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """Distinct names per key in first-seen order."""
    first = df.groupBy(*keys, column).agg(F.min(order).alias("_at"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", column)))
    return first.groupBy(*keys).agg(F.transform(ordered, lambda r: r[column]).alias("columns"))

"""Column roles, and rows, groups and tables turned into readable text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from insight_spark.functions import fixed_values as fv
from insight_spark.functions.text import format_value, humanize_column, parse_month, record_type
from insight_spark.operators.relational import (
    NUMERIC_TYPES,
    agg_min_max_mean,
    agg_value_counts,
    coerce_date,
    coerce_numeric,
    numeric_columns,
    string_columns,
)
from insight_spark.operators.scale import number_rows

DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def _category_like(df: DataFrame, columns: list[str], rows: int) -> dict[str, bool]:
    """Which text columns have at most twenty values, or at most 10% of the rows.

    A sketch decides all but the close calls; only those are counted exactly, so
    no column of long, mostly different texts is ever shuffled to be counted.
    """
    if not columns or not rows:
        return {c: True for c in columns}
    sketch = df.agg(*[F.approx_count_distinct(F.col(c), 0.02).alias(f"u_{i}") for i, c in enumerate(columns)]).first()
    share = {c: sketch[f"u_{i}"] / rows for i, c in enumerate(columns)}
    out = {c: share[c] <= 0.1 for c in columns}
    few = [c for i, c in enumerate(columns) if sketch[f"u_{i}"] <= 2 * fv.MAX_GROUPS]
    close = [c for c in columns if c not in few and 0.08 <= share[c] <= 0.12]
    if few or close:
        exact = df.agg(*[F.count_distinct(F.col(c)).alias(f"e_{i}") for i, c in enumerate(few + close)]).first()
        for i, c in enumerate(few + close):
            out[c] = exact[f"e_{i}"] <= fv.MAX_GROUPS or exact[f"e_{i}"] / rows <= 0.1
    return out


def role_map(df: DataFrame, strict: bool = False) -> dict[str, str]:
    """Role of every column: id, numeric, categorical, date or text.

    Only the profile (one row of counts) reaches the driver. By default the data
    type and identifier endings are looked at before date-like names, so that
    "LengthOfStay_Days" keeps its averages; a date-like name decides for text
    that parses as dates and for whole numbers that read as years. ``strict``
    lets a date-like name decide first and ids come after numbers.
    """
    fields = {f.name: f.dataType for f in df.schema}
    strings = string_columns(df)

    def hinted(name: str) -> bool:
        return any(part in name.lower() for part in fv.DATE_NAME_PARTS)

    def is_id(name: str) -> bool:
        return any(name.lower().endswith(end) for end in fv.ID_NAME_ENDINGS)

    year_like = [] if strict else [c for c in numeric_columns(df) if "year" in re.split(r"[_\W]+", c.lower())]
    maybe_dates = [] if strict else [c for c in strings if hinted(c)]
    counted = [F.count("*").alias("_n")]
    for i, c in enumerate(maybe_dates):
        reads = coerce_date(F.col(c)).isNotNull() | parse_month(F.col(c)).isNotNull()
        counted.append(F.try_divide(F.count_if(reads), F.count(F.col(c))).alias(f"d_{i}"))
    for i, c in enumerate(year_like):
        counted.append((F.min(c).between(1900, 2100) & F.max(c).between(1900, 2100)).alias(f"y_{i}"))
    stats = df.agg(*counted).first()
    dates = {c for i, c in enumerate(maybe_dates) if (stats[f"d_{i}"] or 0) >= 0.8}
    years = {c for i, c in enumerate(year_like) if stats[f"y_{i}"]}
    open_ones = [c for c in strings if not is_id(c) and c not in dates and not (strict and hinted(c))]
    category = _category_like(df, open_ones, stats["_n"])
    roles = {}
    for name, kind in fields.items():
        numeric = isinstance(kind, NUMERIC_TYPES) or isinstance(kind, T.BooleanType)
        if isinstance(kind, DATE_TYPES) or (strict and hinted(name)):
            role = "date"
        elif numeric and strict:
            role = "numeric"
        elif numeric:
            role = "id" if is_id(name) else "date" if name in years else "numeric"
        elif name in dates:
            role = "date"
        elif is_id(name) and name in strings:
            role = "id"
        else:
            role = "categorical" if category.get(name) else "text"
        roles[name] = role
    return roles


def column_roles(df: DataFrame, strict: bool = False) -> DataFrame:
    roles = role_map(df, strict)
    return _rows(df, [(i, c, r) for i, (c, r) in enumerate(roles.items())], "pos int, column string, role string")


def schema_roles(df: DataFrame, order: list[str]) -> DataFrame:
    """Second rule set, on whole words of the name: id, date, numeric, categorical.

    Text columns are sniffed on five sample rows (by ``order``).
    """
    strings = string_columns(df)
    sample = df.orderBy(*order).limit(5)
    sniffed = {}
    if strings:
        row = sample.agg(
            *[F.count(F.col(c)).alias(f"n_{i}") for i, c in enumerate(strings)],
            *[F.count(coerce_numeric(F.col(c))).alias(f"x_{i}") for i, c in enumerate(strings)],
            *[F.count(coerce_date(F.col(c))).alias(f"d_{i}") for i, c in enumerate(strings)],
        ).first()
        for i, c in enumerate(strings):
            n = row[f"n_{i}"]
            sniffed[c] = "numeric" if n and row[f"x_{i}"] == n else "date" if n and row[f"d_{i}"] == n else None
    rows = []
    for pos, field in enumerate(df.schema):
        words = set(re.split(r"[\s_-]+", field.name.lower()))
        date = bool(words & set(fv.SCHEMA_DATE_WORDS)) or isinstance(field.dataType, DATE_TYPES)
        number = isinstance(field.dataType, NUMERIC_TYPES)
        if not date and not number:
            date, number = sniffed.get(field.name) == "date", sniffed.get(field.name) == "numeric"
        if words & set(fv.SCHEMA_ID_WORDS):
            role = "id"
        else:
            role = "date" if date else "numeric" if number else "categorical"
        rows.append((pos, field.name, field.dataType.simpleString(), role))
    return _rows(df, rows, "pos int, column string, type string, role string")


def subject_column(df: DataFrame, roles: dict[str, str]) -> str:
    """The column that names a row: the first id, else the first column."""
    return next((c for c in df.columns if roles[c] == "id"), df.columns[0])


def _label(name: str) -> Column:
    return humanize_column(F.lit(name))


def row_narratives(df: DataFrame, roles: dict[str, str], source: str) -> DataFrame:
    """One sentence per row: "{Type} {id} — Label: value. Label: value." Nulls are skipped."""
    subject = subject_column(df, roles)
    parts = [
        F.when(
            F.col(c).isNotNull(),
            F.concat(_label(c), F.lit(": "), format_value(c, F.col(c), roles[c])),
        )
        for c in df.columns
        if c != subject
    ]
    who = F.concat(record_type(F.lit(subject)), F.lit(" "), F.coalesce(F.col(subject).cast("string"), F.lit("nan")))
    return df.select(
        F.lit("row_narrative").alias("chunk_type"),
        F.lit(source).alias("source"),
        F.lit("csv").alias("source_type"),
        F.col(subject).cast("string").alias("record_id"),
        F.concat(who, F.lit(" — "), F.concat_ws(". ", *parts), F.lit(".")).alias("text"),
    )


def _few_values(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns of at most twenty values; a sketch rules the others out first."""
    if not columns:
        return []
    sketch = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"u_{i}") for i, c in enumerate(columns)]).first()
    near = [c for i, c in enumerate(columns) if sketch[f"u_{i}"] <= 2 * fv.MAX_GROUPS]
    if not near:
        return []
    exact = df.agg(*[F.count_distinct(F.col(c)).alias(f"e_{i}") for i, c in enumerate(near)]).first()
    return [c for i, c in enumerate(near) if exact[f"e_{i}"] <= fv.MAX_GROUPS]


def group_summaries(df: DataFrame, roles: dict[str, str], source: str, order: list[str]) -> DataFrame:
    """One text per value of every categorical column: header, up to fifteen member
    lines (by ``order``), how many more there are, and the means of numeric columns.

    Values of fewer than two rows and columns of more than twenty values give no
    text. All columns share two passes over the table: counts and means are
    partial aggregates, and of a group only the fifteen listed rows leave a task,
    so a group that holds a third of the table stays cheap.
    """
    subject = subject_column(df, roles)
    categories = _few_values(df, [c for c in df.columns if roles[c] == "categorical"])
    numbers = [c for c in df.columns if roles[c] == "numeric"][: fv.GROUP_MEANS]
    if not categories:
        return _rows(df, [], "chunk_type string, source string, source_type string, group_col string, group_val string, text string")
    kind = F.lower(record_type(F.lit(subject)))
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categories])
    long = (
        df.withColumn("_pair", F.explode(pairs))
        .filter(F.col("_pair.v").isNotNull())
        .withColumns({"_column": F.col("_pair.c"), "_value": F.col("_pair.v")})
        .drop("_pair")
    )
    stats = long.groupBy("_column", "_value").agg(
        F.count("*").alias("_n"), *[F.avg(F.col(c).cast("double")).alias(f"_m{i}") for i, c in enumerate(numbers)]
    ).filter(F.col("_n") >= fv.MIN_GROUP_ROWS)

    line, label = F.lit(None).cast("string"), F.lit("")
    for column in categories:
        details = F.array_compact(
            F.array(
                *[
                    F.when(F.col(c).isNotNull(), format_value(c, F.col(c), roles[c]))
                    for c in df.columns
                    if c not in (subject, column)
                ]
            )
        )
        own = F.concat(
            F.lit("  - "), F.coalesce(F.col(subject).cast("string"), F.lit("nan")), F.lit(": "),
            F.array_join(F.slice(details, 1, fv.GROUP_DETAILS), ", "),
        )
        line = F.when(F.col("_column") == column, own).otherwise(line)
        label = F.when(F.col("_column") == column, _label(column)).otherwise(label)
    window = Window.partitionBy("_column", "_value").orderBy(*order)
    lines = F.array_sort(F.collect_list(F.struct("_no", "_line")))
    listed = (
        long.withColumn("_no", F.row_number().over(window))
        .filter(F.col("_no") <= fv.GROUP_LINES)
        .select("_column", "_value", "_no", line.alias("_line"))
        .groupBy("_column", "_value")
        .agg(F.array_join(F.transform(lines, lambda r: r["_line"]), "\n").alias("_lines"))
    )
    means = F.concat_ws(
        ". ",
        *[
            F.when(
                F.col(f"_m{i}").isNotNull() & ~F.isnan(f"_m{i}"),
                F.concat(F.lit("Average "), _label(c), F.lit(": "), format_value(c, F.col(f"_m{i}"), "numeric")),
            )
            for i, c in enumerate(numbers)
        ],
    )
    text = F.concat_ws(
        "\n",
        F.concat(
            F.col("_value"), F.lit(" "), label, F.lit(" — "), F.col("_n").cast("string"), F.lit(" "), kind, F.lit("s:")
        ),
        F.col("_lines"),
        F.when(
            F.col("_n") > fv.GROUP_LINES,
            F.concat(F.lit("  ... and "), (F.col("_n") - fv.GROUP_LINES).cast("string"), F.lit(" more.")),
        ),
        F.when(F.col("_means") != "", F.concat(F.lit("Averages — "), F.col("_means"), F.lit("."))),
    )
    return (
        stats.withColumn("_means", means)
        .join(listed, ["_column", "_value"])
        .select(
            F.lit("group_summary").alias("chunk_type"), F.lit(source).alias("source"), F.lit("csv").alias("source_type"),
            F.col("_column").alias("group_col"), F.col("_value").alias("group_val"), text.alias("text"),
        )
    )


def dataset_overview(df: DataFrame, roles: dict[str, str], source: str) -> DataFrame:
    """One text about the whole table: size, value breakdowns, numeric ranges."""
    subject = subject_column(df, roles)
    categories = [c for c in df.columns if roles[c] == "categorical"][: fv.OVERVIEW_CATEGORIES]
    numbers = [c for c in df.columns if roles[c] == "numeric"][: fv.OVERVIEW_NUMBERS]
    kind = F.lower(record_type(F.lit(subject)))
    size = df.agg(F.count("*").alias("_n")).select(
        F.lit(0).alias("_section"), F.lit(0).alias("_no"),
        F.concat(
            F.lit(f"Dataset overview — {source}\nContains "), F.col("_n").cast("string"), F.lit(" "), kind,
            F.lit(f"s with {len(df.columns)} attributes."),
        ).alias("_line"),
    )
    lines = size
    if categories:
        position = F.lit(0)
        label = F.lit("")
        for i, c in enumerate(categories):
            position = F.when(F.col("column") == c, F.lit(i)).otherwise(position)
            label = F.when(F.col("column") == c, _label(c)).otherwise(label)
        shown = F.transform(
            F.array_sort(F.collect_list(F.struct("position", "value", "n"))),
            lambda r: F.concat(r["value"], F.lit(" ("), r["n"].cast("string"), F.lit(")")),
        )
        counts = (
            agg_value_counts(df, categories)
            .groupBy("column")
            .agg(F.array_join(shown, ", ").alias("_b"))
            .select(
                F.lit(1).alias("_section"), position.alias("_no"),
                F.concat(label, F.lit(" breakdown: "), F.col("_b"), F.lit(".")).alias("_line"),
            )
        )
        lines = lines.unionByName(counts)
    if numbers:
        chain_no, chain_text = F.lit(0), F.lit("")
        for i, c in enumerate(numbers):
            here = F.col("column") == c
            text = F.concat(
                _label(c), F.lit(": ranges "), format_value(c, F.col("smallest"), "numeric"), F.lit("–"),
                format_value(c, F.col("largest"), "numeric"), F.lit(", average "),
                format_value(c, F.col("average"), "numeric"), F.lit("."),
            )
            chain_no = F.when(here, F.lit(i)).otherwise(chain_no)
            chain_text = F.when(here, text).otherwise(chain_text)
        ranges = agg_min_max_mean(df, numbers).select(
            F.lit(2).alias("_section"), chain_no.alias("_no"), chain_text.alias("_line")
        )
        lines = lines.unionByName(ranges)
    ordered = F.array_sort(F.collect_list(F.struct("_section", "_no", "_line")))
    return lines.agg(F.array_join(F.transform(ordered, lambda r: r["_line"]), "\n").alias("text")).select(
        F.lit("dataset_overview").alias("chunk_type"), F.lit(source).alias("source"),
        F.lit("csv").alias("source_type"), "text",
    )


def table_chunks(df: DataFrame, source: str, order: list[str], strict: bool = False) -> DataFrame:
    """Row, group and overview texts of one table in one list."""
    roles = role_map(df, strict)
    rows = row_narratives(df, roles, source)
    groups = group_summaries(df, roles, source, order)
    overview = dataset_overview(df, roles, source)
    return rows.unionByName(groups, allowMissingColumns=True).unionByName(overview, allowMissingColumns=True)


def plain_row_chunks(df: DataFrame, source: str, order: list[str], sheet: str | None = None) -> DataFrame:
    """"From {file}, Row i: c: v, …" per row, plus a summary with sample rows.

    Row numbers follow ``order``, whose first column is a number.
    """
    sample_rows = 3 if sheet else 5
    cells = F.concat_ws(
        ", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in df.columns]
    )
    place = f"From {source}, Sheet '{sheet}', Row " if sheet else f"From {source}, Row "
    numbered = number_rows(df.select(*df.columns, cells.alias("_cells")), order, "row")
    rows = numbered.select(
        F.lit(source).alias("source"), F.lit("excel_row" if sheet else "csv_row").alias("type"), "row",
        F.concat(F.lit(place), F.col("row").cast("string"), F.lit(":\n"), F.col("_cells")).alias("text"),
    )
    head = F.lit(f"Excel File: {source}, Sheet: {sheet}" if sheet else f"CSV File: {source}")
    lines = df.orderBy(*order).limit(sample_rows).select(F.struct(*order).alias("_key"), cells.alias("_line"))
    ordered = F.array_sort(F.collect_list(F.struct("_key", "_line")))
    sample = lines.select(F.array_join(F.transform(ordered, lambda r: r["_line"]), "\n")).scalar()
    summary = df.agg(F.count("*").alias("_n")).select(
        F.lit(source).alias("source"), F.lit("excel" if sheet else "csv_summary").alias("type"),
        F.lit(None).cast("bigint").alias("row"),
        F.concat(
            head, F.lit(f"\nColumns: {', '.join(df.columns)}\nTotal Rows: "), F.col("_n").cast("string"),
            F.lit("\n\nSample:\n" if sheet else "\n\nSample Data:\n"), sample,
        ).alias("text"),
    )
    return summary.unionByName(rows)


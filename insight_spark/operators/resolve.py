"""Match literals and column names as typed to the ones that are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from insight_spark.functions import fixed_values as fv
from insight_spark.functions.text import expand_abbreviations, normalize_token, parse_month
from insight_spark.operators import fuzzy
from insight_spark.operators.relational import string_columns
from insight_spark.operators.scale import HOT_LEAST, kept, lookup

LITERAL = r"'((?:[^'\"\\]|\\.)*)'"


def column_forms(names: DataFrame) -> DataFrame:
    """Searchable forms of column names.

    ``names`` is (table, column, pos). A whole-name form belongs to the last
    column that has it; a single word only counts where no whole name has it,
    and then belongs to the first column.
    """
    plain = normalize_token(F.col("column"))
    expanded = expand_abbreviations(plain)
    words = F.filter(F.split(expanded, " "), lambda w: F.length(w) > 2)
    forms = F.flatten(
        F.array(
            F.array(F.struct(plain.alias("form"), F.lit("whole").alias("kind"))),
            F.array(F.struct(expanded.alias("form"), F.lit("whole").alias("kind"))),
            F.transform(words, lambda w: F.struct(w.alias("form"), F.lit("word").alias("kind"))),
        )
    )
    long = names.select("table", "column", "pos", F.explode(forms).alias("_f")).select(
        "table", "column", "pos", "_f.*"
    )
    whole = F.max(F.when(F.col("kind") == "whole", F.struct("pos", "column")))
    word = F.min(F.when(F.col("kind") == "word", F.struct("pos", "column")))
    return long.groupBy("table", "form").agg(F.coalesce(whole, word).alias("_c")).select(
        "table", "form", "_c.column", "_c.pos"
    )


def value_forms(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """Searchable forms of every distinct text value: (table, column, pos, form, actual).

    A form shared by several values of one column belongs to the greatest value.
    """
    columns = columns or string_columns(df)
    position = {name: i for i, name in enumerate(df.columns)}
    values = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], columns, "column", "actual")
        .filter(F.col("actual").isNotNull())
        .distinct()
    )
    plain = normalize_token(F.col("actual"))
    month = F.lower(parse_month(F.col("actual")))
    prefixes = F.transform(
        F.sequence(F.lit(3), F.length(month)), lambda n: F.substring(month, F.lit(1), n)
    )
    forms = F.array_distinct(
        F.concat(F.array(plain, expand_abbreviations(plain)), F.coalesce(prefixes, F.array().cast("array<string>")))
    )
    pos = F.lit(0)
    for name in columns:
        pos = F.when(F.col("column") == name, F.lit(position[name])).otherwise(pos)
    return (
        values.select("column", "actual", F.explode(forms).alias("form"))
        .groupBy("column", "form")
        .agg(F.max("actual").alias("actual"))
        .select(F.lit(table).alias("table"), "column", pos.alias("pos"), "form", "actual")
    )


def fuzzy_match(
    probes: DataFrame, values: DataFrame, cutoff: float, probe: str = "probe", value: str = "value",
    scope: str = "table",
) -> DataFrame:
    """Closest value per probe by difflib ratio: (scope, probe, value, ratio).

    Candidates come from an index that every pair of the cutoff must meet in (see
    :mod:`fuzzy`); their ratios are verified. A tie goes to the greater value.
    """
    asked = probes.select(F.col(scope).alias("scope"), F.col(probe).alias("probe"))
    known = values.select(F.col(scope).alias("scope"), F.col(value).alias("value"))
    return fuzzy.closest(asked, known, cutoff).select(
        F.col("scope").alias(scope), F.col("probe").alias(probe), F.col("value").alias(value), F.round("ratio", 6).alias("ratio")
    )


def resolve_values(literals: DataFrame, index: DataFrame, cutoff: float = fv.VALUE_CUTOFF) -> DataFrame:
    """Stored value for every literal: (table, literal, hint, resolved, method).

    ``literals`` is (table, literal, hint); ``index`` comes from
    :func:`value_forms`. Columns are tried hinted first, then in table order;
    within a column exact, canonical, abbreviation, month. What no column knows
    goes to the fuzzy match; the rest stays as typed.
    """
    asked = literals.select(
        "table", "literal", F.coalesce("hint", F.lit("")).alias("hint")
    ).distinct()
    plain = normalize_token(F.col("literal"))
    probes = asked.select(
        "table", "literal", "hint",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("step"), F.lit("actual").alias("kind"), F.col("literal").alias("key")),
                F.struct(F.lit(2).alias("step"), F.lit("form").alias("kind"), plain.alias("key")),
                F.struct(F.lit(3).alias("step"), F.lit("form").alias("kind"), expand_abbreviations(plain).alias("key")),
                F.struct(F.lit(4).alias("step"), F.lit("form").alias("kind"), F.lower(parse_month(F.col("literal"))).alias("key")),
            )
        ).alias("_p"),
    ).select("table", "literal", "hint", "_p.*").filter(F.col("key").isNotNull())
    keys = index.select("table", "column", "pos", F.lit("form").alias("kind"), F.col("form").alias("key"), "actual").unionByName(
        index.select("table", "column", "pos", F.lit("actual").alias("kind"), F.col("actual").alias("key"), "actual").distinct()
    )
    off_hint = F.col("column") != F.col("hint")
    hits = (
        probes.join(keys, ["table", "kind", "key"])
        .groupBy("table", "literal", "hint")
        .agg(F.min(F.struct(off_hint.alias("off"), "pos", "step", "actual")).alias("_h"))
    )
    joined = asked.join(hits, ["table", "literal", "hint"], "left")
    open_ones = joined.filter(F.col("_h").isNull()).select("table", plain.alias("probe")).distinct()
    norms = index.select("table", "actual", "column", "pos", normalize_token(F.col("actual")).alias("value"))
    close = fuzzy_match(open_ones, norms.select("table", "value").distinct(), cutoff)
    # First stored value, in column order, that has the closest spelling.
    nearest = (
        close.join(norms, ["table", "value"])
        .groupBy("table", "probe")
        .agg(F.min(F.struct("pos", "actual")).alias("_n"))
    )
    steps = F.array(*[F.lit(s) for s in ("exact", "canonical", "abbreviation", "month")])
    return (
        joined.withColumn("probe", plain)
        .join(nearest, ["table", "probe"], "left")
        .select(
            "table", "literal", F.nullif("hint", F.lit("")).alias("hint"),
            F.coalesce("_h.actual", "_n.actual", "literal").alias("resolved"),
            F.when(F.col("_h").isNotNull(), F.try_element_at(steps, F.col("_h.step")))
            .when(F.col("_n").isNotNull(), F.lit("fuzzy"))
            .otherwise(F.lit("unchanged"))
            .alias("method"),
        )
    )


def resolve_column(asked: DataFrame, forms: DataFrame, cutoff: float = fv.COLUMN_CUTOFF) -> DataFrame:
    """Actual column for every (table, asked) name: canonical, expanded, fuzzy, unchanged."""
    plain = normalize_token(F.col("asked"))
    probes = asked.select("table", "asked").distinct().withColumns(
        {"probe": plain, "_long": expand_abbreviations(plain)}
    )
    first = forms.select("table", F.col("form").alias("probe"), F.col("column").alias("_canonical"))
    second = forms.select("table", F.col("form").alias("_long"), F.col("column").alias("_expanded"))
    known = probes.join(first, ["table", "probe"], "left").join(second, ["table", "_long"], "left")
    open_ones = known.filter(F.coalesce("_canonical", "_expanded").isNull()).select("table", "probe").distinct()
    names = forms.select("table", "column", "pos").distinct().withColumn("value", normalize_token(F.col("column")))
    close = fuzzy_match(open_ones, names.select("table", "value").distinct(), cutoff)
    nearest = (
        close.join(names, ["table", "value"])
        .groupBy("table", "probe")
        .agg(F.min_by("column", "pos").alias("_fuzzy"))
    )
    return known.join(nearest, ["table", "probe"], "left").select(
        "table", "asked",
        F.coalesce("_canonical", "_expanded", "_fuzzy", "asked").alias("resolved"),
        F.when(F.col("_canonical").isNotNull(), F.lit("canonical"))
        .when(F.col("_expanded").isNotNull(), F.lit("expanded"))
        .when(F.col("_fuzzy").isNotNull(), F.lit("fuzzy"))
        .otherwise(F.lit("unchanged"))
        .alias("method"),
    )


def rewrite_literals(statements: DataFrame, index: DataFrame, key: str = "sql_id", table: str = "table", sql: str = "sql") -> DataFrame:
    """Logged SQL with every single-quoted, non-numeric literal as it is stored."""
    found = statements.select(
        key, F.col(table).alias("table"), sql,
        F.regexp_extract_all(F.col(sql), F.lit(LITERAL), F.lit(1)).alias("_literals"),
        F.split(F.col(sql), LITERAL, -1).alias("_between"),
    )
    each = kept(found.select(key, "table", F.posexplode("_literals").alias("_at", "literal")), "literals")
    wanted = each.filter(~F.col("literal").rlike(r"^[0-9]+(\.[0-9]+)?$"))
    resolved = resolve_values(
        wanted.select("table", "literal", F.lit(None).cast("string").alias("hint")), index
    ).select("table", "literal", "resolved")
    # A stored value is written as a literal, so a quote in it is doubled; what was typed stays as it was.
    stored = F.when(F.col("resolved") == F.col("literal"), F.col("literal")).otherwise(
        F.coalesce(F.replace("resolved", F.lit("'"), F.lit("''")), "literal")
    )
    fixed = (
        lookup(each, resolved, ["table", "literal"], HOT_LEAST)
        .groupBy(key)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_at", stored.alias("v")))),
                lambda r: r["v"],
            ).alias("_values")
        )
    )
    pieces = F.zip_with(
        "_between", "_values",
        lambda text, value: F.when(value.isNull(), text).otherwise(F.concat(text, F.lit("'"), value, F.lit("'"))),
    )
    return found.join(fixed, key, "left").select(
        key, "table", sql,
        F.when(F.col("_values").isNull(), F.col(sql)).otherwise(F.array_join(pieces, "")).alias("rewritten"),
    )


def index_dump(index: DataFrame, table: str | None = None, column: str | None = None) -> DataFrame:
    out = index
    if table is not None:
        out = out.filter(F.col("table") == table)
    if column is not None:
        out = out.filter(F.col("column") == column)
    return out


def actual_values(index: DataFrame, table: str, column: str) -> DataFrame:
    return index_dump(index, table, column).select("table", "column", "actual").distinct()

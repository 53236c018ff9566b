"""Tables of the session catalog, and external databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from insight_spark.functions import fixed_values as fv

JDBC_DRIVERS = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver"),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver"),
    "sqlite": ("jdbc:sqlite:{path}", "org.sqlite.JDBC"),
}


def jdbc_options(
    db_type: str, dbtable: str, user: str | None = None, password: str | None = None,
    partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
    partitions: int = 32, fetch_size: int = 10_000, **place,
) -> dict[str, str]:
    """Reader options; with a partition column the table is read in parallel ranges."""
    if db_type not in JDBC_DRIVERS:
        raise ValueError(f"unsupported database type: {db_type}")
    url, driver = JDBC_DRIVERS[db_type]
    options = {"url": url.format(**place), "driver": driver, "dbtable": dbtable, "fetchsize": str(fetch_size)}
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    if partition_column:
        if lower is None or upper is None:
            raise ValueError("a partition column needs lower and upper bounds")
        options |= {
            "partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def scan_jdbc(spark: SparkSession, db_type: str, dbtable: str, **settings) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(db_type, dbtable, **settings)).load()


def upload_table_name(conversation_id: str, file_name: str) -> str:
    """Python twin of ``table_name_for`` for the one name a write needs."""
    stem = file_name.rsplit("/", 1)[-1]
    stem = stem[: stem.rindex(".")] if "." in stem[1:] else stem
    clean = "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in stem).lower()
    return f"{fv.TABLE_PREFIX}{conversation_id[: fv.TABLE_ID_CHARS]}_{clean}"[: fv.TABLE_NAME_CHARS]


def write_table(df: DataFrame, name: str, path: str | None = None, partition_by: list[str] | None = None) -> str:
    """Import a frame as a table, replacing an earlier one of the name."""
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(f"`{name}`")
    return name


def list_tables(spark: SparkSession, conversation_id: str | None = None) -> DataFrame:
    """Tables of the catalog; those of one session when its id is given."""
    prefix = f"{fv.TABLE_PREFIX}{conversation_id[: fv.TABLE_ID_CHARS]}_" if conversation_id else ""
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith(prefix)]
    return spark.createDataFrame([(n,) for n in sorted(names)], "table_name string")


def schema_rows(df: DataFrame, table: str) -> list[tuple]:
    return [
        (table, pos, f.name, f.dataType.simpleString(), not f.nullable, False)
        for pos, f in enumerate(df.schema)
    ]


def table_schema(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, pos, column, type, notnull, primary_key) from the schemas alone."""
    rows = [row for name, df in tables.items() for row in schema_rows(df, name)]
    return spark.createDataFrame(
        rows, "table string, pos int, column string, type string, notnull boolean, primary_key boolean"
    )


def schema_text(schema: DataFrame) -> DataFrame:
    """One text per table; a table has a bounded number of columns."""
    line = F.concat(
        F.lit("  - "), "column", F.lit(" ("), "type", F.lit(") "),
        F.when(F.col("notnull"), F.lit("NOT NULL")).otherwise(F.lit("NULL")),
        F.when(F.col("primary_key"), F.lit(" PRIMARY KEY")).otherwise(F.lit("")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return schema.groupBy("table").agg(
        F.concat(
            F.lit("Table: "), F.first("table"), F.lit("\nColumns:\n"),
            F.array_join(F.transform(ordered, lambda r: r["line"]), "\n"),
        ).alias("text")
    )


def table_sample(df: DataFrame, order: list[str] | None = None, n: int = 5) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def table_info(df: DataFrame, table: str) -> DataFrame:
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(table).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"),
        F.lit(", ".join(df.columns)).alias("columns"),
    )


def table_metadata(df: DataFrame, files: DataFrame) -> DataFrame:
    """Rows, columns, types and file size (``files`` is a ``binaryFile`` listing)."""
    size = files.select(F.sum("length")).scalar()
    types = ", ".join(f"{name}:{kind}" for name, kind in df.dtypes)
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"), F.lit(", ".join(df.columns)).alias("columns"),
        F.lit(types).alias("dtypes"), (size / (1024 * 1024)).alias("file_size_mb"),
    )


def drop_session_tables(spark: SparkSession, conversation_id: str | None = None) -> list[str]:
    """Drop the tables of one session, or every uploaded table when no id is given."""
    prefix = fv.TABLE_PREFIX + (f"{conversation_id[: fv.TABLE_ID_CHARS]}_" if conversation_id else "")
    gone = sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix))
    for name in gone:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    return gone

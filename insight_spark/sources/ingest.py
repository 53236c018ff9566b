"""Uploaded files of a conversation to chunks, tables and a status per file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from insight_spark.functions.text import file_extension, file_name
from insight_spark.operators.retrieval import cap_chunks, split_lines, split_recursive, split_structured
from insight_spark.operators.profile import table_chunks
from insight_spark.operators.relational import coerce_numeric, string_columns
from insight_spark.operators.scale import kept
from insight_spark.session import fresh_path
from insight_spark.sources import csv_records
from insight_spark.sources.files import (
    binary_files,
    cell_chunks,
    no_glob,
    part_chunks,
    scan_csv,
    scan_text,
    scan_workbook,
    text_lines,
    word_parts,
    workbook_cells,
)
from insight_spark.sources.tables import upload_table_name, write_table

# File endings by how they are read.
TABLE_TYPES, DOCUMENT_TYPES = ("csv", "xlsx"), ("txt", "docx")
CHUNK_COLUMNS = ["chunk_id", "conversation_id", "source", "source_type", "chunk_type", "text", "columns"]
# Possessive runs: the matcher neither recurses nor goes back, however long a field is.
CELL = r'("(?:[^"]++|"")*+"[^,]*+|[^,]*+),'
CHUNK_ORDER = ["source", "path", "pos", "chunk_no", "chunk_id"]


def csv_row_chunks(records: DataFrame) -> DataFrame:
    """Records of CSV files (path, row, record) as "Row i: column: value" texts, for files of any header.

    ``from_csv`` needs one schema; here every file brings its own header, so the
    cells are found with a quote-aware pattern and paired with the header names.
    """
    def cells(record):
        raw = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(CELL), F.lit(1))
        bare = F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
        return bare

    headers = records.filter("row = 0").select("path", cells(F.col("record")).alias("names"))
    each = records.filter("row > 0").join(headers, "path").select("path", "names", (F.col("row") - 1).cast("int").alias("row"), "record")
    named = F.array_join(
        F.zip_with(
            "names", cells(F.col("record")),
            lambda n, c: F.concat(n, F.lit(": "), F.when(c.isNull() | (c == ""), F.lit("nan")).otherwise(c)),
        ),
        ", ",
    )
    source = file_name(F.col("path"))
    return each.select(
        "path", F.lit("csv_row").alias("type"), "row",
        F.concat(F.lit("From "), source, F.lit(", Row "), F.col("row").cast("string"), F.lit(":\n"), named).alias("text"),
        F.col("names").alias("columns"),
    )


def with_ids(pieces: DataFrame, conversation_id: str) -> DataFrame:
    """Chunk columns plus the origin that orders them; an id is a hash of its origin."""
    origin = F.concat_ws("\x1f", F.lit(conversation_id), "path", "type", F.coalesce("pos", F.lit(-1)), "chunk_no", "chunk")
    return pieces.select(
        F.sha2(origin, 256).alias("chunk_id"), F.lit(conversation_id).alias("conversation_id"),
        file_name(F.col("path")).alias("source"), "source_type", F.col("type").alias("chunk_type"),
        F.col("chunk").alias("text"), "columns", "path", "pos", "chunk_no",
    )


def ingest_files(
    files: DataFrame, conversation_id: str, cap: int | None = None, with_path: bool = False, texts: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(chunks, status) of uploaded files (path, content).

    The contents are read once and laid out by file ending in the shared folder;
    contents of unsupported files are not kept. An unsupported or broken file only
    shows in the status. All chunks are returned unless ``cap`` limits them per
    conversation. No table is made here, so ``sql_table`` is null; see
    :func:`ingest_paths`. Large files are better named than handed over:
    :func:`ingest_folder`. ``texts`` are the paths of further, stored text files, which are
    read in splits.
    """
    spark = files.sparkSession
    listed = files.select("path", "content", file_extension(F.col("path")).alias("_ext"))
    kind = F.when(F.col("_ext").isin(*TABLE_TYPES, *DOCUMENT_TYPES), F.col("_ext")).otherwise("other")
    place = fresh_path(spark, "uploads")
    listed.withColumns({"kind": kind, "content": F.when(kind != "other", F.col("content"))}).write.partitionBy("kind").parquet(place)
    stored = spark.read.schema("path string, content binary, _ext string, kind string").parquet(place)
    of_kind = lambda ending: stored.filter(F.col("kind") == ending).select("path", "content")
    lines = csv_records.content_lines(of_kind("csv"))
    plain, listing = _plain_pieces(of_kind("txt")), stored.select("path", "_ext")
    if texts:
        plain = plain.unionByName(_text_pieces(text_lines(spark, [no_glob(path) for path in texts])))
        named = spark.createDataFrame([(path,) for path in texts], "path string")
        listing = listing.unionByName(named.withColumn("_ext", file_extension(F.col("path"))))
    chunks, status = _ingested(listing, lines, of_kind("xlsx"), of_kind("docx"), plain, conversation_id, cap)
    return chunks, status if with_path else status.drop("path")


def ingest_folder(spark: SparkSession, folder, conversation_id: str, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`ingest_files` for all files below a folder (or folders), each kind loaded by its own ending.

    CSV and text files are read in splits, so their size is not bounded by what one row or task holds.
    """
    listing = binary_files(spark, folder).select("path", file_extension(F.col("path")).alias("_ext"))
    load = lambda ending: binary_files(spark, folder, _any_case(ending)).select("path", "content")
    lines = csv_records.csv_lines(spark, folder, _any_case("csv"))
    plain = _text_pieces(text_lines(spark, folder, _any_case("txt")))
    chunks, status = _ingested(listing, lines, load("xlsx"), load("docx"), plain, conversation_id, cap)
    return chunks, status.drop("path")


def _plain_pieces(files: DataFrame) -> DataFrame:
    """Chunks of text files (path, content) as :func:`_ingested` takes them."""
    texts = scan_text(files).select("path", "text")
    return _as_pieces(split_recursive(texts))


def _text_pieces(lines: DataFrame) -> DataFrame:
    return _as_pieces(split_lines(lines))


def _as_pieces(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "path", F.lit("txt").alias("type"), F.lit(None).cast("int").alias("pos"),
        F.lit(None).cast("array<string>").alias("columns"), "chunk_no", "chunk",
    )


def _any_case(ending: str) -> str:
    return "*." + "".join(f"[{c}{c.upper()}]" for c in ending)


def _ingested(
    listed: DataFrame, lines: DataFrame, books: DataFrame, word: DataFrame, plain: DataFrame, conversation_id: str, cap: int | None
) -> tuple[DataFrame, DataFrame]:
    """``listed`` is (path, _ext), ``plain`` the chunks of text files. Every file is parsed once: its parts, with errors as rows, and its chunks
    are kept in the shared folder, and chunks and status read them there."""
    cells, parts = kept(workbook_cells(books), "cells"), kept(word_parts(word), "parts")
    records = kept(csv_records.records(lines), "records")
    none = F.lit(None).cast("array<string>")
    tables = csv_row_chunks(records).select("path", "type", F.col("row").alias("pos"), "text", "columns").unionByName(
        cell_chunks(cells).select("path", "type", F.col("row").alias("pos"), "text", none.alias("columns"))
    )
    documents = part_chunks(parts).select("path", "type", F.col("position").alias("pos"), "text", none.alias("columns"))
    split = split_structured(tables).withColumn("source_type", F.lit("csv")).unionByName(
        split_recursive(documents).unionByName(plain).withColumn("source_type", F.lit("document"))
    )
    pieces = kept(split, "pieces")
    chunks = capped(with_ids(pieces, conversation_id), cap)
    broken = (
        parts.filter(F.col("error").isNotNull()).select("path", "error")
        .unionByName(cells.filter(F.col("error").isNotNull()).select("path", "error"))
    )
    counts = pieces.groupBy("path").agg(F.count("*").alias("chunks"))
    kind = F.when(F.col("_ext").isin(*TABLE_TYPES), F.lit("hybrid")).when(
        F.col("_ext").isin(*DOCUMENT_TYPES), F.lit("document")
    )
    status = (
        listed.select("path", "_ext", file_name(F.col("path")).alias("source"))
        .join(broken, "path", "left")
        .join(counts, "path", "left")
        .select(
            "path", F.col("source").alias("filename"), F.col("_ext").alias("format"), kind.alias("type"),
            F.lit(None).cast("string").alias("sql_table"),
            F.coalesce("chunks", F.lit(0)).alias("chunks"),
            F.when(kind.isNull(), F.lit("skipped")).when(F.col("error").isNotNull(), F.lit("error")).otherwise(F.lit("ready")).alias("status"),
            "error",
        )
    )
    return chunks, status


def capped(chunks: DataFrame, cap: int | None) -> DataFrame:
    """The chunk columns; with a ``cap`` only so many chunks per conversation, in their order."""
    if cap is not None:
        chunks = cap_chunks(chunks, ["conversation_id"], CHUNK_ORDER, cap)
    return chunks.select(*CHUNK_COLUMNS)


def existing_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The given paths that exist; missing ones are skipped, as on upload."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(conf).exists(place):
            out.append(path)
    return out


def typed_columns(df: DataFrame) -> DataFrame:
    """Text columns that hold only numbers as numbers, found in one pass."""
    texts = string_columns(df)
    if not texts:
        return df
    row = df.agg(
        *[F.count(F.col(c)).alias(f"n_{i}") for i, c in enumerate(texts)],
        *[F.count(coerce_numeric(F.col(c))).alias(f"d_{i}") for i, c in enumerate(texts)],
        *[F.count(F.when(F.col(c).rlike(r"^[+-]?[0-9]{1,18}$"), 1)).alias(f"i_{i}") for i, c in enumerate(texts)],
    ).first()
    kinds = {
        c: "bigint" if row[f"i_{i}"] == row[f"n_{i}"] else "double"
        for i, c in enumerate(texts)
        if row[f"n_{i}"] and row[f"d_{i}"] == row[f"n_{i}"]
    }
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def read_table_file(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, or the first sheet of a workbook, as a typed table."""
    if path.lower().endswith(".csv"):
        return scan_csv(spark, path)
    book = spark.read.format("binaryFile").load(path).select("path", "content")
    problem = workbook_cells(book).filter(F.col("kind") == "error").select("error").first()
    if problem is not None:
        raise ValueError(problem[0])
    return typed_columns(scan_workbook(book).drop("path", "row"))


def ingest_table_file(
    spark: SparkSession, path: str, conversation_id: str, table_path: str | None = None
) -> tuple[DataFrame, str]:
    """Import a structured file as a table and turn it into row, group and overview
    texts: (pieces, table name). Members of a group are listed in column order."""
    source = path.rsplit("/", 1)[-1]
    df = read_table_file(spark, path)
    name = write_table(df, upload_table_name(conversation_id, source), table_path)
    stored = spark.table(f"`{name}`")
    texts = table_chunks(stored, source, stored.columns)
    pieces = split_structured(texts.select(F.col("chunk_type").alias("type"), "text")).select(
        F.lit(path).alias("path"), "type", F.lit(None).cast("int").alias("pos"), "chunk_no", "chunk",
        F.array(*[F.lit(c) for c in stored.columns]).alias("columns"), F.lit("csv").alias("source_type"),
    )
    return pieces, name


def ingest_paths(
    spark: SparkSession, paths: list[str], conversation_id: str, table_folder: str | None = None, cap: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(chunks, status) of one upload; structured files also become tables.

    All chunks are returned unless ``cap`` limits them per conversation.

    The driver walks over the files of the upload, each of which is a distributed
    job of its own. Missing files are skipped; a broken one only shows in the status.
    """
    found = existing_files(spark, paths)
    if not found:
        raise FileNotFoundError("none of the given files exists")
    structured = [p for p in found if p.lower().endswith(TABLE_TYPES)]
    others = [p for p in found if p not in structured]
    pieces, rows = [], []
    for path in structured:
        source = path.rsplit("/", 1)[-1]
        ending = source.rsplit(".", 1)[-1].lower()
        try:
            place = f"{table_folder}/{upload_table_name(conversation_id, source)}" if table_folder else None
            made, name = ingest_table_file(spark, path, conversation_id, place)
            pieces.append(made)
            rows.append((source, ending, "hybrid", name, made.count(), "ready", None))
        except Exception as problem:  # one bad file must not fail the upload
            rows.append((source, ending, "hybrid", None, 0, "error", str(problem)))
    schema = "filename string, format string, type string, sql_table string, chunks bigint, status string, error string"
    status = spark.createDataFrame(rows, schema)
    parts = [with_ids(made, conversation_id) for made in pieces]
    if others:
        files = spark.read.format("binaryFile").load(others).select("path", "content")
        chunks, other_status = ingest_files(files, conversation_id)
        parts.append(chunks.withColumns({"path": F.col("source"), "pos": F.lit(None).cast("int"), "chunk_no": F.lit(0)}))
        status = status.unionByName(other_status)
    if not parts:
        raise ValueError("no file of the upload could be read")
    together = reduce(DataFrame.unionByName, parts)
    return capped(together, cap), status

"""Files: CSV, Excel workbooks, text, Word documents and web pages."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from insight_spark.functions.text import file_name
from insight_spark.operators.scale import join_null_safe, kept, number_rows, small_batches
from insight_spark.sources import csv_records, office

WORD_SCHEMA = "path string, kind string, position int, text string, error string"
CELL_SCHEMA = (
    "path string, sheet_no int, sheet string, kind string, row int, names array<string>, cells array<string>, error string"
)
SAMPLE_ROWS = 3
# Rows, and characters of them, that are handed on together.
ROWS_HELD, HELD_CHARACTERS = 5000, 4 << 20
# Types that CSV columns are tried for, in this order, and what their values look like.
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
INFERRED = {
    "int": WHOLE, "bigint": WHOLE, "double": r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$",
    "date": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "timestamp": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9:.]+)?\S*$",
    "boolean": r"(?i)^(true|false)$",
}


def scan_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """CSV with a header. Give a schema for large inputs: inferring reads them twice.

    Files are read in splits whatever their quotes hold. By default one pass over the
    text tells whether a quoted field goes on in a next line; ``multi_line`` says so at
    once. Rows of several files come under the header of the first.
    """
    if multi_line is None:
        multi_line = csv_records.any_break(csv_records.csv_lines(spark, path))
    if multi_line:
        return records_table(csv_records.records(csv_records.csv_lines(spark, path)), schema)
    reader = spark.read.option("header", True).option("escape", '"')
    if schema:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def records_table(records: DataFrame, schema: str | None = None) -> DataFrame:
    """(path, row, record) as a table; row 0 of a file is its header. Without a schema types are found in one pass."""
    kept_records = records if schema else kept(records, "csv-records")
    options = {"escape": '"', "multiLine": "true"}
    if schema:
        parsed = F.from_csv("record", F.lit(schema), options)
        return kept_records.filter("row > 0").select(parsed.alias("_r")).select("_r.*")
    first = kept_records.filter("row = 0").agg(F.min_by("record", "path")).first()[0]
    if first is None:
        return records.sparkSession.createDataFrame([], "value string").drop("value")
    names = next(csv.reader([first.replace("\n", " ")]))
    texts = ", ".join(f"_{i} string" for i in range(len(names)))
    body = kept_records.filter("row > 0").select(F.from_csv("record", F.lit(texts), options).alias("_r")).select("_r.*")
    return inferred(body).toDF(*names)


def inferred(df: DataFrame) -> DataFrame:
    """Text columns as the narrowest type that all their values have, found in one pass."""
    def fits(name: str, kind: str) -> Column:
        return F.when(F.col(name).rlike(INFERRED[kind]), F.col(name).try_cast(kind))

    counts = [F.count(F.col(c)).alias(f"{c}_n") for c in df.columns]
    counts += [F.count(fits(c, kind)).alias(f"{c}_{kind}") for c in df.columns for kind in INFERRED]
    found = df.agg(*counts).first()
    kinds = {c: next((k for k in INFERRED if found[f"{c}_n"] and found[f"{c}_{k}"] == found[f"{c}_n"]), "string") for c in df.columns}
    return df.select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in df.columns])


def binary_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def text_lines(spark: SparkSession, path, pattern: str | None = None) -> DataFrame:
    """(path, block, place, line, bytes, size): the lines of text files, read in splits.

    Lines are in the order of ``block`` and ``place``; ``bytes`` is the length that a line has in its file of ``size``.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    # The path as the other readers name it: not escaped.
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return reader.text(path).select(
        F.regexp_replace(plain, "^file:///", "file:/").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.coalesce(F.try_validate_utf8("value"), F.make_valid_utf8("value")).alias("line"),
        F.octet_length("value").cast("long").alias("bytes"), F.col("_metadata.file_size").alias("size"),
    )


def no_glob(path: str) -> str:
    """A path in which no character stands for others."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def scan_text(files: DataFrame) -> DataFrame:
    """One row per file: (path, source, type, text). ``files`` is (path, content)."""
    readable = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.make_valid_utf8(F.col("content").cast("string")))
    return files.select("path", file_name(F.col("path")).alias("source"), F.lit("txt").alias("type"), readable.alias("text"))


def _word_rows(path: str, content: bytes) -> Iterator[tuple]:
    counts = {"paragraph": 0, "table": 0}
    for kind, number, text in office.word_blocks(io.BytesIO(content)):
        if text or kind == "table":
            counts[kind] += 1
            yield path, kind, number, text, None
    yield path, "summary", None, f"Paragraphs: {counts['paragraph']}\nTables: {counts['table']}", None


def _each_file(read, columns: dict[str, pa.DataType], empty: tuple):
    """mapInArrow body: the rows that ``read`` gives per file, ROWS_HELD or HELD_CHARACTERS of them together; an
    unreadable file gives one error row instead of what comes after the error."""
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), columns.values())], names=list(columns))

    def run(batches):
        ready, letters = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                held, path = [], batch.column(0)[i].as_py()
                try:
                    for row in read(path, batch.column(1)[i].as_py()):
                        held.append(row)
                        if len(held) == ROWS_HELD:
                            yield batch_of(held)
                            held = []
                except Exception as problem:  # one bad file must not fail the batch
                    held = [(path, *empty, f"{type(problem).__name__}: {problem}")]
                ready += held
                letters += sum(len(value) for row in held for value in row if isinstance(value, str))
                if len(ready) >= ROWS_HELD or letters >= HELD_CHARACTERS:
                    yield batch_of(ready)
                    ready, letters = [], 0
        if ready:
            yield batch_of(ready)

    return run


def word_parts(files: DataFrame) -> DataFrame:
    """Parts of Word files: (path, kind, position, text, error); kind is summary,
    paragraph, table or error."""
    small_batches(files.sparkSession)
    columns = {"path": pa.string(), "kind": pa.string(), "position": pa.int32(), "text": pa.string(), "error": pa.string()}
    return files.select("path", "content").mapInArrow(_each_file(_word_rows, columns, ("error", None, None)), WORD_SCHEMA)


def scan_docx(files: DataFrame) -> DataFrame:
    """Word files as chunks: a summary, every non-empty paragraph, every table.

    The parser sees a whole file, so it also counts; no join or shuffle follows.
    """
    return part_chunks(word_parts(files))


def part_chunks(parts: DataFrame) -> DataFrame:
    """The chunks of :func:`scan_docx` from :func:`word_parts`."""
    source = file_name(F.col("path"))
    kind = F.col("kind")
    place = F.when(kind == "table", F.lit(", Table ")).otherwise(F.lit(", Paragraph "))
    text = F.when(
        kind == "summary", F.concat(F.lit("Word Document: "), source, F.lit("\n"), F.col("text"))
    ).otherwise(
        F.concat(F.lit("From "), source, place, F.col("position").cast("string"), F.lit(":\n"), F.col("text"))
    )
    return parts.filter(kind != "error").select(
        "path", source.alias("source"), F.concat(F.lit("docx_"), kind).alias("type"), "position", text.alias("text")
    )


def _sheet_rows(path: str, content: bytes) -> Iterator[tuple]:
    with office.archive_of(content) as archive:
        shared = office.SharedStrings(archive)
        for sheet in office.sheets(archive):
            for kind, number, header, cells in office.table_rows(office.sheet_rows(archive, sheet, shared), SAMPLE_ROWS):
                yield path, sheet.number, sheet.name, kind, number, header, cells, None


def workbook_cells(files: DataFrame) -> DataFrame:
    """Every sheet as (path, sheet_no, sheet, kind, row, names, cells, error).

    Kind "row" is a data row, numbered from 0 below the header in ``names``; kind
    "sheet" has the number of rows and, in ``cells``, three sample lines.
    """
    small_batches(files.sparkSession)
    texts = pa.list_(pa.string())
    columns = {
        "path": pa.string(), "sheet_no": pa.int32(), "sheet": pa.string(), "kind": pa.string(), "row": pa.int32(),
        "names": texts, "cells": texts, "error": pa.string(),
    }
    return files.select("path", "content").mapInArrow(_each_file(_sheet_rows, columns, (0, None, "error", 0, None, None)), CELL_SCHEMA)


def scan_workbook(files: DataFrame, header: list[str] | None = None, sheet_no: int = 0) -> DataFrame:
    """One sheet of workbooks that share a header as a table of text columns.

    Without ``header`` the header of the first file is read.
    """
    cells = workbook_cells(files).filter(F.col("sheet_no") == sheet_no)
    if header is None:
        first = cells.filter(F.col("kind") == "sheet").select(F.min_by("names", "path")).first()
        header = first[0] or []
    return cells.filter(F.col("kind") == "row").select(
        "path", "row", *[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(header)]
    )


def list_sheets(spark: SparkSession, path, pattern: str = "*.[xX][lL][sS][xX]") -> DataFrame:
    """(path, sheet_no, sheet, part, error): the sheets of all workbooks below a folder, listed by tasks; only the
    directory of a file is read. A broken workbook is one row with an error."""
    paths = binary_files(spark, path, pattern).select("path")
    spread = paths.repartition(max(1, spark.sparkContext.defaultParallelism))

    def run(batches):
        for batch in batches:
            for name in batch["path"]:
                try:
                    with office.open_stored(name) as stream, zipfile.ZipFile(stream) as archive:
                        rows = [(name, *sheet, None) for sheet in office.sheets(archive)]
                except Exception as problem:  # one bad file must not fail the listing
                    rows = [(name, None, None, None, f"{type(problem).__name__}: {problem}")]
                yield pd.DataFrame(rows, columns=["path", "sheet_no", "sheet", "part", "error"]).astype({"sheet_no": "Int32"})

    return spread.mapInPandas(run, "path string, sheet_no int, sheet string, part string, error string")


def stored_sheets(spark: SparkSession, path, columns: list[str] | None = None, sheet_no: int | None = None) -> DataFrame:
    """Sheets of stored workbooks as :func:`workbook_cells` gives them, a task's share being whole sheets.

    A sheet is read while it is unpacked, ROWS_HELD rows at a time: neither a file nor a
    sheet is held as one value, only the shared strings of its file. With ``columns`` the
    other cells are left out; a missing column is null.
    """
    listed = kept(list_sheets(spark, path), "sheets")
    wanted = listed if sheet_no is None else listed.filter((F.col("sheet_no") == sheet_no) | F.col("error").isNotNull())
    names = ["path", "sheet_no", "sheet", "kind", "row", "names", "cells", "error"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names)

    def rows_of(name: str, sheet: office.Sheet):
        with office.open_stored(name) as stream, zipfile.ZipFile(stream) as archive:
            shared = office.SharedStrings(archive)
            for kind, number, header, cells in office.table_rows(office.sheet_rows(archive, sheet, shared), SAMPLE_ROWS):
                if columns is not None:
                    if kind == "row":
                        place = {name: i for i, name in enumerate(header)}
                        cells = [cells[place[c]] if c in place and place[c] < len(cells) else None for c in columns]
                    header = columns
                yield name, sheet.number, sheet.name, kind, number, header, cells, None

    def run(batches):
        for batch in batches:
            for name, number, sheet, part, error in batch.itertuples(index=False):
                if error is not None:
                    yield frame([(name, 0, None, "error", 0, None, None, error)])
                    continue
                held = []
                try:
                    for row in rows_of(name, office.Sheet(int(number), sheet, part)):
                        held.append(row)
                        if len(held) == ROWS_HELD:
                            yield frame(held)
                            held = []
                except Exception as problem:  # one bad sheet must not fail the others
                    held = [(name, int(number), sheet, "error", 0, None, None, f"{type(problem).__name__}: {problem}")]
                if held:
                    yield frame(held)

    # Sheets are dealt out one by one, whatever file they are of.
    tasks = max(1, min(wanted.count(), 10 * spark.sparkContext.defaultParallelism))
    return wanted.repartition(tasks, "path", "sheet_no").mapInPandas(run, CELL_SCHEMA)


def workbook_chunks(files: DataFrame) -> DataFrame:
    """All sheets as row texts plus a summary per sheet with three sample rows."""
    return cell_chunks(workbook_cells(files))


def cell_chunks(cells: DataFrame) -> DataFrame:
    """The chunks of :func:`workbook_chunks` from :func:`workbook_cells`."""
    source = file_name(F.col("path"))
    number = F.col("row").cast("string")
    named = F.array_join(
        F.zip_with("names", "cells", lambda n, c: F.concat(n, F.lit(": "), F.coalesce(c, F.lit("nan")))), ", "
    )
    is_row = F.col("kind") == "row"
    row_text = F.concat(
        F.lit("From "), source, F.lit(", Sheet '"), F.col("sheet"), F.lit("', Row "), number, F.lit(":\n"), named
    )
    summary = F.concat(
        F.lit("Excel File: "), source, F.lit(", Sheet: "), F.col("sheet"), F.lit("\nColumns: "),
        F.array_join("names", ", "), F.lit("\nTotal Rows: "), number, F.lit("\n\nSample:\n"), F.array_join("cells", "\n"),
    )
    return cells.filter(F.col("kind") != "error").select(
        "path", "sheet", F.when(is_row, F.lit("excel_row")).otherwise(F.lit("excel")).alias("type"),
        F.when(is_row, F.col("row")).alias("row"), F.when(is_row, row_text).otherwise(summary).alias("text"),
    )


def page_text(html: Column) -> Column:
    """Readable text of a web page: no scripts, styles, comments or tags."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<script\b.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style\b.*?</style>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    # The entities that pages use; &amp; last.
    for entity, character in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
        ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
    ):
        out = F.replace(out, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(out, r"[\s\x{00A0}]+", " "))


def pages_to_documents(pages: DataFrame, document: Column, page_key: str, html: str = "html") -> DataFrame:
    """Pages of each document: a summary with the page count, then every non-empty page.

    Page numbers follow ``page_key`` (a number) within a document.
    """
    texts = pages.select(document.alias("source"), page_key, page_text(F.col(html)).alias("_text"))
    numbered = number_rows(texts, [page_key], "_no", ["source"]).withColumn("page", (F.col("_no") + 1).cast("int"))
    totals = texts.groupBy("source").agg(F.count("*").cast("int").alias("total_pages"))
    body = (
        join_null_safe(numbered.filter(F.col("_text") != ""), totals, ["source"])
        .select(
            "source", F.lit("page").alias("type"), "page", "total_pages",
            F.concat(
                F.lit("From "), F.coalesce("source", F.lit("unknown")), F.lit(", Page "), F.col("page").cast("string"), F.lit(":\n"), "_text"
            ).alias("text"),
        )
    )
    summary = totals.select(
        "source", F.lit("page_summary").alias("type"), F.lit(None).cast("int").alias("page"), "total_pages",
        F.concat(F.lit("Document: "), F.coalesce("source", F.lit("unknown")), F.lit("\nTotal Pages: "), F.col("total_pages").cast("string")).alias("text"),
    )
    return summary.unionByName(body)

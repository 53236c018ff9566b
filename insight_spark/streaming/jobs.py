"""Structured Streaming: file ingest and route classification; see :mod:`rollup` for conversations."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from insight_spark.functions.text import file_extension, file_name
from insight_spark.operators.routing import classify_route
from insight_spark.sources.chunk_store import write_chunks
from insight_spark.sources.files import no_glob
from insight_spark.sources.ingest import TABLE_TYPES, ingest_files, ingest_paths

PROCESSING = "processing"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_ingest_files(
    spark: SparkSession, folder: str, conversation_id: str, chunk_path: str, status_path: str,
    checkpoint: str, files_per_batch: int = 1000, table_folder: str | None = None,
    derived: Iterable[Callable[[str], object]] = (),
) -> StreamingQuery:
    """Watch a folder; every micro-batch of files becomes chunks and a status per file.

    A file is ``processing`` from the moment its batch begins and then ``ready``, ``error``
    or ``skipped``; :func:`read_status` gives the newest. A batch that stops half-way leaves
    its files processing; when it is run again it replaces its own output, so a file has
    one final state. Before that state is written, what was derived from the
    conversation's chunks (vocabulary, search index) is dropped: each of ``derived`` is
    called with the conversation. With a ``table_folder`` structured files also become
    tables, one import per file. Only paths, at most ``files_per_batch``, come to the driver; text
    files are read in splits and none is held as a whole.
    """
    files = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch).load(folder)
    )

    def put_status(status: DataFrame, batch_id: int, step: int) -> None:
        status.select(
            "path", "filename", "format", "type", F.col("chunks").cast("bigint").alias("chunks"), "status", "error"
        ).write.mode("overwrite").parquet(f"{status_path}/batch={batch_id}/step={step}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        ending = file_extension(F.col("path"))
        named = batch.select("path", file_name(F.col("path")).alias("filename"), ending.alias("format"))
        put_status(named.withColumns({
            "type": F.lit(None).cast("string"), "chunks": F.lit(None).cast("bigint"), "status": F.lit(PROCESSING),
            "error": F.lit(None).cast("string"),
        }), batch_id, 0)
        place = f"{chunk_path}/batch={batch_id}"
        # Files are read again by name: a filter on a batch would still read every content.
        kinds = [(r["path"], r["format"]) for r in named.select("path", "format").toLocalIterator()]
        texts = [path for path, kind in kinds if kind == "txt"]
        tables = [path for path, kind in kinds if kind in TABLE_TYPES and table_folder]
        others = [no_glob(path) for path, kind in kinds if kind != "txt" and not (kind in TABLE_TYPES and table_folder)]
        empty = spark.createDataFrame([], "path string, content binary")
        contents = spark.read.format("binaryFile").load(others).select("path", "content") if others else empty
        chunks, status = ingest_files(contents, conversation_id, with_path=True, texts=texts)
        if tables:
            table_chunks, table_status = ingest_paths(spark, tables, conversation_id, table_folder)
            chunks = chunks.unionByName(table_chunks)
            paths = named.select("path", "filename")
            status = status.unionByName(table_status.join(paths, "filename"), allowMissingColumns=True)
        write_chunks(chunks.withColumn("meta", F.create_map(F.lit("batch"), F.lit(str(batch_id)))), place)
        for drop in derived:
            drop(conversation_id)
        put_status(status, batch_id, 1)

    return (
        files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_status(spark: SparkSession, status_path: str) -> DataFrame:
    """The newest state of every file: (path, filename, format, type, chunks, status, error)."""
    rows = spark.read.parquet(status_path)
    columns = ["filename", "format", "type", "chunks", "status", "error"]
    newest = F.max(F.struct("batch", "step", *columns)).alias("_newest")
    return rows.groupBy("path").agg(newest).select("path", *[F.col(f"_newest.{c}").alias(c) for c in columns])


def classify_stream(questions: DataFrame) -> DataFrame:
    """Route of every question on a stream (question, has_docs, has_csv, files)."""
    return questions.withColumn(
        "route", classify_route(F.col("question"), F.col("has_docs"), F.col("has_csv"), F.col("files"))
    )

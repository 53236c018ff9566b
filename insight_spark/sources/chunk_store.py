"""Chunks and their vectors, one partition per conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK_SCHEMA = (
    "chunk_id string, conversation_id string, source string, source_type string, chunk_type string, "
    "text string, columns array<string>, meta map<string,string>, embedding array<float>"
)


def shaped(df: DataFrame) -> DataFrame:
    """The store's columns in order; absent ones are null."""
    wanted = [part.strip().split(" ", 1) for part in CHUNK_SCHEMA.split(", ")]
    return df.select(
        *[
            (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in wanted
        ]
    )


def write_chunks(df: DataFrame, path: str, append: bool = False) -> None:
    """Write chunks; unless appending, the conversations in ``df`` are replaced.

    Rows are dealt out by conversation and rebalanced by size: a small conversation
    is one file, a large one is written by several tasks.
    """
    (
        shaped(df).hint("rebalance", "conversation_id")
        .write.mode("append" if append else "overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("conversation_id")
        .parquet(path)
    )


def read_chunks(spark: SparkSession, path: str, conversation_id: str | None = None) -> DataFrame:
    """Stored chunks; one conversation reads only its own folder."""
    schema = ", ".join(p for p in CHUNK_SCHEMA.split(", ") if not p.startswith("conversation_id"))
    df = spark.read.schema(schema + ", conversation_id string").parquet(path)
    return df if conversation_id is None else df.filter(F.col("conversation_id") == conversation_id)


def delete_chunks(spark: SparkSession, path: str, conversation_id: str) -> bool:
    """Remove one conversation's folders, those of streamed batches as well, through the file system Spark uses."""
    jvm = spark.sparkContext._jvm
    escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(conversation_id)
    store = jvm.org.apache.hadoop.fs.Path(path)
    system = store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    batches = [batch.getPath() for batch in system.globStatus(jvm.org.apache.hadoop.fs.Path(store, "batch=*")) or []]
    gone = [system.delete(jvm.org.apache.hadoop.fs.Path(place, f"conversation_id={escaped}"), True) for place in [store, *batches]]
    return any(gone)

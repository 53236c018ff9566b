"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from insight_spark.session import fresh_path

# Spark hands Python batches of at most so many rows, so a batch of long texts stays small.
ROWS_PER_BATCH = 256
# Batches are put together up to about this size before they are worked on. Work on a chunk takes up
# to 25 times its size in arrays, in each of an executor's Python workers.
CHUNK_BYTES = 4 << 20
# Word separators of the contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch can hold, whatever the session says."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive batches joined to about ``limit`` bytes; no chunk is empty."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield pa.concat_batches(held)


def map_chunks(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` over chunks of bounded size; ``work`` may return None for no rows."""
    small_batches(df.sparkSession)

    def run(batches):
        for chunk in chunks(batches):
            out = work(chunk)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name like ``wish`` that ``df`` does not have in any case."""
    taken, name = {c.lower() for c in df.columns}, f"_{wish}"
    while name.lower() in taken:
        name += "_"
    return name


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def kept_table(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back.

    What follows reads the files, so an executor that is lost costs a read and
    not the work before it. Nothing is held on one machine.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def text_key(text_col: str) -> Column:
    """With the id it names a row: rows of equal id and text have the same verdict."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def text_column(chunk: pa.RecordBatch, name: str) -> pa.Array:
    """The texts of a chunk with null as the empty text."""
    import pyarrow.compute as pc

    return pc.fill_null(chunk.column(name).cast(pa.string()), "")


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive runs of the given lengths; 0 for an empty run."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]

"""Token ids in Simple-8b words, in files that Spark writes and reads.

A 64-bit word holds a selector in its top four bits and, below, as many ids as
the selector says, the first id lowest. A slot with all bits set is an escape:
the id stands in the block's escape list. Blocks of equally many ids begin on a
word, and a segment keeps the word and escape count of each block, so all blocks
of a segment are decoded at once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from insight_spark.llm.common import id_type, map_chunks, small_batches, text_column
from insight_spark.llm.tokens import shared_tokens
from insight_spark.session import fresh_path

BLOCK = 512
# A segment takes whole documents until it has about so many ids.
SEGMENT = 1 << 15
# Ids in a word and bits of each, by selector; 0 and 1 stand for runs of zeros.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
# Blocks whose selectors are chosen together, so that the arrays stay in the processor's cache.
TILE = 64
# Ids of so many bits go three to a word; narrower slots with escapes must save against that.
PLAIN = 20
# Selectors with narrower slots have no escape.
ESCAPE_FROM = 4


class Coded(NamedTuple):
    words: np.ndarray  # uint64
    words_per_block: np.ndarray
    escapes: np.ndarray  # uint32
    escapes_per_block: np.ndarray


def _fits(width: int) -> int:
    """The first id that a slot of this width cannot hold itself."""
    return (1 << width) - (width >= ESCAPE_FROM)


def _choose(ids: np.ndarray) -> np.ndarray:
    """For every place in every block the selector of fewest bits per id, were a word to begin there."""
    tiles = [_choose_tile(ids[start : start + TILE]) for start in range(0, len(ids), TILE)]
    return np.concatenate(tiles) if tiles else np.zeros(ids.shape, np.uint8)


def _choose_tile(ids: np.ndarray) -> np.ndarray:
    blocks, size = ids.shape
    best = np.full(ids.shape, np.inf, np.float32)
    choice = np.zeros(ids.shape, np.uint8)
    for selector, (count, width) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist())):
        over = ids >= _fits(width)
        fitting = size - np.count_nonzero(over, axis=1)
        if width < ESCAPE_FROM:
            # Without escapes a word needs ``count`` small ids, or those up to the block's end.
            rows = np.flatnonzero((fitting >= count) | ~over[:, -1])
        else:
            # Else three ids of PLAIN bits in a word are cheaper, wherever it begins.
            rows = np.flatnonzero(fitting * 3 >= count) if width < PLAIN else np.arange(blocks)
        if not len(rows):
            continue
        over = over[rows] if len(rows) < blocks else over
        large = np.zeros((len(rows), size + 1), np.int16)
        misfits = np.empty(over.shape, np.int16)
        np.cumsum(over, axis=1, dtype=np.int16, out=large[:, 1:])
        whole = max(0, size + 1 - count)  # places where a full word fits
        if whole:
            np.subtract(large[:, size + 1 - whole :], large[:, :whole], out=misfits[:, :whole])
        np.subtract(large[:, -1:], large[:, whole:-1], out=misfits[:, whole:])
        held = np.minimum(count, size - np.arange(size)).astype(np.float32)
        cost = misfits.astype(np.float32)
        cost *= np.float32(32)
        cost += np.float32(64)
        cost /= held
        if width < ESCAPE_FROM:
            cost[misfits > 0] = np.inf
        if len(rows) < blocks:
            better = cost < best[rows]
            best[rows] = np.where(better, cost, best[rows])
            choice[rows] = np.where(better, np.uint8(selector), choice[rows])
        else:
            better = cost < best
            np.copyto(best, cost, where=better)
            choice[better] = selector
    return choice


def encode(ids: np.ndarray) -> Coded:
    """Codes a (blocks, BLOCK) array of ids below 2**32."""
    blocks, size = ids.shape
    choice = _choose(ids)
    lane, place = np.arange(blocks), np.zeros(blocks, np.int64)
    found = []
    while len(lane):
        selector = choice[lane, place]
        found.append((lane * size + place, selector))
        place = place + COUNTS[selector]
        open_lanes = place < size
        lane, place = lane[open_lanes], place[open_lanes]
    begin = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
    selector = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.uint8)
    order = np.argsort(begin, kind="stable")
    begin, selector = begin[order], selector[order]
    words = selector.astype(np.uint64) << np.uint64(60)
    flat = np.append(ids.reshape(-1).astype(np.uint64), np.uint64(0))
    escaped = [np.empty(0, np.int64)]
    for s in np.unique(selector):
        count, width = int(COUNTS[s]), int(WIDTHS[s])
        if not width:
            continue
        rows = np.flatnonzero(selector == s)
        at = begin[rows, None] + np.arange(count)
        at[at >= (begin[rows, None] // size + 1) * size] = len(flat) - 1
        values = flat[at]
        if width >= ESCAPE_FROM:
            over = values >= _fits(width)
            escaped.append(at[over])
            values[over] = (1 << width) - 1
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
        words[rows] |= np.bitwise_or.reduce(values << shifts, axis=1)
    escape_at = np.sort(np.concatenate(escaped))
    return Coded(
        words, np.bincount(begin // size, minlength=blocks), flat[escape_at].astype(np.uint32),
        np.bincount(escape_at // size, minlength=blocks),
    )


def decode(coded: Coded, size: int = BLOCK) -> np.ndarray:
    """The (blocks, size) ids of ``encode``."""
    blocks = len(coded.words_per_block)
    selector = (coded.words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    block = np.repeat(np.arange(blocks), coded.words_per_block)
    before = np.cumsum(counts) - counts
    first_word = np.cumsum(coded.words_per_block) - coded.words_per_block
    begin = before - before[first_word[block]] + block * size if len(block) else before
    stop = (block + 1) * size
    out = np.zeros(blocks * size, np.uint32)
    escaped = [np.empty(0, np.int64)]
    for s in np.unique(selector):
        count, width = int(COUNTS[s]), int(WIDTHS[s])
        if not width:
            continue
        rows = np.flatnonzero(selector == s)
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
        mask = np.uint64((1 << width) - 1)
        values = coded.words[rows, None] >> shifts & mask
        at = begin[rows, None] + np.arange(count)
        inside = at < stop[rows, None]
        out[at[inside]] = values[inside]
        if width >= ESCAPE_FROM:
            escaped.append(at[inside & (values == mask)])
    out[np.sort(np.concatenate(escaped))] = coded.escapes
    return out.reshape(blocks, size)


def segments(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, Coded]:
    """Segment of every document, blocks per segment, and the code of all segments, each padded to whole blocks."""
    starts = np.cumsum(counts) - counts
    segment = starts // SEGMENT
    segment = np.cumsum(np.diff(segment, prepend=segment[:1]) > 0)
    sizes = np.bincount(segment, counts).astype(np.int64)
    blocks = -(-sizes // BLOCK)
    padded = np.zeros(int(blocks.sum()) * BLOCK, np.uint32)
    first = (np.cumsum(blocks) - blocks) * BLOCK
    shift = first - (np.cumsum(sizes) - sizes)
    padded[np.arange(len(ids)) + np.repeat(shift, sizes)] = ids
    return segment, blocks, encode(padded.reshape(-1, BLOCK))


SCHEMA = (
    "file int, first_id bigint, n_ids bigint, doc_ids array<{kind}>, doc_sizes array<bigint>, "
    "block_words binary, words binary, block_escapes binary, escapes binary"
)


def write(
    df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode all texts in ascending order of id and write them below ``path``.

    A row of the files is a segment: whole documents, their ids and sizes, and
    the coded blocks with the words and escapes of each. ``file`` numbers the
    tasks in order of id, ``first_id`` counts the token ids before the segment
    in its file. Null ids come first; equal ids go by a hash of their text, so a
    repeated id is not one task's burden unless its text repeats too. Spark
    commits the files, so a task that is run again leaves no trace.
    """
    small_batches(df.sparkSession)
    kind = id_type(df, id_col)
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    ordered = (
        df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
        .withColumn("_tie", F.xxhash64("_text"))
        .repartitionByRange("_id", "_tie").sortWithinPartitions("_id", "_tie")
        .select("_id", "_text", F.spark_partition_id().alias("_file"))
    )

    def run(batches):
        from insight_spark.llm.common import chunks

        before = 0
        for chunk in chunks(batches):
            ids, counts = shared_tokens(tokenizer).encode(text_column(chunk, "_text"))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
            segment, blocks, coded = segments(ids, counts)
            rows = len(blocks)
            docs = np.concatenate(([0], np.cumsum(np.bincount(segment, minlength=rows)))).astype(np.int32)
            sizes = np.bincount(segment, counts, rows).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(blocks)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows, chunk.column(2)[0].as_py()), pa.int32()),
                    pa.array(before + np.cumsum(sizes) - sizes), pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(docs), chunk.column(0)),
                    pa.ListArray.from_arrays(pa.array(docs), pa.array(counts)),
                    _binary(coded.words_per_block.astype("<u2"), ends),
                    _binary(coded.words.astype("<u8"), _at(coded.words_per_block, ends)),
                    _binary(coded.escapes_per_block.astype("<u2"), ends),
                    _binary(coded.escapes.astype("<u4"), _at(coded.escapes_per_block, ends)),
                ],
                names=names,
            )
            before += int(sizes.sum())

    ordered.mapInArrow(run, SCHEMA.format(kind=kind)).write.parquet(path, compression="zstd")


def _at(per_block: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(per_block)))[ends]


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary per segment: the values between consecutive ``ends``."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    )


def _values(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per document, decoded from the files below ``path``.

    ``ids`` holds little-endian unsigned 32-bit ids; ``start`` counts the ids of
    all documents before it. The ids before a file are the sum over a short
    table with one row per file.
    """
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    totals = files.groupBy("file").agg(F.sum("n_ids").alias("_n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        per_block = _values(chunk.column(5), "<u2").astype(np.int64)
        escapes_per_block = _values(chunk.column(7), "<u2").astype(np.int64)
        coded = Coded(_values(chunk.column(6), "<u8"), per_block, _values(chunk.column(8), "<u4"), escapes_per_block)
        flat = decode(coded).reshape(-1)
        blocks = pc.binary_length(chunk.column(5)).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        sizes = chunk.column(2).to_numpy(zero_copy_only=False)
        kept = np.arange(int(sizes.sum())) + np.repeat(
            (np.cumsum(blocks) - blocks) * BLOCK - (np.cumsum(sizes) - sizes), sizes
        )
        ids = flat[kept].astype("<u4")
        counts = chunk.column(4).flatten().to_numpy(zero_copy_only=False)
        docs = pc.list_value_length(chunk.column(4)).to_numpy(zero_copy_only=False).astype(np.int64)
        segment = np.repeat(np.arange(len(docs)), docs)
        ends = np.cumsum(counts)
        shift = chunk.column(1).to_numpy(zero_copy_only=False) - (np.cumsum(sizes) - sizes)
        return pa.RecordBatch.from_arrays(
            [
                chunk.column(3).flatten(), chunk.column(0).take(pa.array(segment)),
                pa.array(ends - counts + shift[segment]), pa.array(counts), _binary(ids, np.concatenate(([0], ends))),
            ],
            names=["doc_id", "file", "start", "n_tokens", "ids"],
        )

    docs = map_chunks(files, work, f"doc_id {kind}, file int, start bigint, n_tokens bigint, ids binary")
    return docs.join(F.broadcast(bases), "file").select(
        "doc_id", (F.col("start") + F.col("_base")).alias("start"), "n_tokens", "ids"
    )


def round_trip(
    df: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write all documents to a fresh folder of the shared directory and read them back.

    A null or empty text has the end id alone. Rows are documents: repeated rows
    and null ids are written like any other. An empty table gives no rows; other
    columns are not read.
    """
    path = fresh_path(df.sparkSession, "token-files")
    write(df, path, tokenizer, end_id, id_col, text_col)
    return read(df.sparkSession, path)

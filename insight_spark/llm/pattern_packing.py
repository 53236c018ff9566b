"""Packing documents into fixed-length sequences by length patterns.

Only the histogram of piece lengths decides the plan: patterns of up to three
length classes that fill a sequence are fitted to it by non-negative least
squares, their repeat counts are rounded down, and what is left over goes by
best fit, longest first, into free space or new sequences. All of this works on
counts, so its cost does not depend on the number of documents. The pieces then
find their own place from their length and their rank among equal lengths.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from insight_spark.llm.common import CHUNK_BYTES, chunks, id_type, kept_table, small_batches, text_column
from insight_spark.llm.tokens import shared_tokens

LIMIT = 2048
# Lengths are fitted in classes of LIMIT / CLASSES tokens.
CLASSES = 256
# A fitted pattern may leave so many tokens of a sequence free; looser ones go to the rest.
SLACK = 1


class Plan(NamedTuple):
    """Where the r-th piece of a length goes; entries are sorted by (length, first rank).

    An entry covers ``per_sequence`` pieces of its length in each of consecutive
    sequences from ``sequence`` on, the first of them at ``offset``.
    """

    first_entry: np.ndarray  # by length: where its entries begin; one more at the end
    first_rank: np.ndarray
    per_sequence: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, max_steps: int = 3000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    passive: list[int] = []
    target = a.T @ b
    tolerance = 1e-9 * max(float(np.abs(b).max(initial=0)), 1e-300)
    for _ in range(max_steps):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        passive.append(best)
        while passive:
            chosen = a[:, passive]
            try:
                solved = np.linalg.solve(chosen.T @ chosen, target[passive])
            except np.linalg.LinAlgError:  # dependent patterns
                solved = np.linalg.lstsq(chosen, b, rcond=None)[0]
            if (solved > 0).all():
                x[:] = 0
                x[passive] = solved
                break
            now = x[passive]
            down = solved <= 0
            step = float(np.min(now[down] / np.maximum(now[down] - solved[down], 1e-300)))
            x[passive] = now + step * (solved - now)
            out = [p for p, s, v in zip(passive, solved, x[passive]) if s <= 0 and v <= 1e-15]
            x[out] = 0
            passive = [p for p in passive if p not in set(out)] if out else passive[:-1]
    return x


def full_patterns(classes: int) -> list[tuple[int, ...]]:
    """All sets of one to three classes (1 to ``classes``, each standing for its upper end) that fill a sequence."""
    out: list[tuple[int, ...]] = [(classes,)]
    out += [(classes - i, i) for i in range(1, classes // 2 + 1)]
    out += [
        (classes - i - j, j, i)
        for i in range(1, classes // 3 + 1) for j in range(i, (classes - i) // 2 + 1)
    ]
    return out


def make_plan(histogram: dict[int, int], limit: int = LIMIT, classes: int = CLASSES) -> Plan:
    """The plan for ``histogram`` (length -> pieces)."""
    classes = min(classes, limit)
    width = -(-limit // classes)
    classes = -(-limit // width)
    left = {length: count for length, count in histogram.items() if count > 0}
    packs = _fitted(left, limit, width, classes)
    packs = _best_fit(left, packs, limit)
    return _entries(packs, limit)


def _fitted(left: dict[int, int], limit: int, width: int, classes: int) -> dict[tuple[int, ...], int]:
    """Patterns fitted by least squares and rounded down; takes their pieces out of ``left``."""
    totals = np.zeros(classes)
    for length in sorted(left):
        number = -(-length // width)
        totals[number - 1] += left[length]
    packs: dict[tuple[int, ...], int] = defaultdict(int)
    if not totals.any():
        return packs
    # Only patterns whose classes all occur can be used.
    patterns = [p for p in full_patterns(classes) if all(totals[c - 1] for c in p)]
    if not patterns:
        return packs
    matrix = np.zeros((classes, len(patterns)))
    for column, pattern in enumerate(patterns):
        for c in pattern:
            matrix[c - 1, column] += 1
    repeats = nonnegative_least_squares(matrix, totals / totals.sum()) * totals.sum()
    for column in np.argsort(-repeats, kind="stable"):
        times = int(repeats[column] + 1e-6)
        while times > 0 and (chosen := _members(patterns[column], left, limit, width)):
            # As many equal sequences at once as the chosen lengths allow.
            run = min(times, *(left[n] // chosen.count(n) for n in chosen))
            packs[tuple(sorted(chosen, reverse=True))] += run
            for n in chosen:
                left[n] -= run
            times -= run
    return packs


def _members(pattern: tuple[int, ...], left: dict[int, int], limit: int, width: int) -> list[int]:
    """Exact lengths for a pattern's classes that leave at most SLACK tokens free, or none."""
    tops = [number * width for number in pattern]
    for first in range(min(limit, tops[0]), tops[0] - width, -1):
        if not left.get(first):
            continue
        chosen = [first]
        for place, top in enumerate(tops[1:], 1):
            room = limit - sum(chosen)
            last = place == len(pattern) - 1
            low = max(1, room - SLACK) if last else top - width + 1
            for length in range(room if last else min(room, top), low - 1, -1):
                if left.get(length, 0) > chosen.count(length):
                    chosen.append(length)
                    break
        if len(chosen) == len(pattern) and sum(chosen) >= limit - SLACK:
            return chosen
    return []


def _best_fit(left: dict[int, int], packs: dict[tuple[int, ...], int], limit: int) -> dict[tuple[int, ...], int]:
    """Puts the rest, longest first, into the fullest sequences that have room, many equal ones at a time."""
    by_room: list[dict[tuple[int, ...], int]] = [defaultdict(int) for _ in range(limit + 1)]
    for pattern, count in packs.items():
        by_room[limit - sum(pattern)][pattern] += count
    for length in sorted(left, reverse=True):
        count = left[length]
        for room in range(length, limit + 1):
            while count and by_room[room]:
                pattern = next(iter(by_room[room]))
                used = min(count, by_room[room][pattern])
                # A sequence takes as many of these as fit before the next one is opened.
                fits = min(room // length, -(-count // used) if used else 1)
                used = min(used, count // fits)
                by_room[room][pattern] -= used
                if not by_room[room][pattern]:
                    del by_room[room][pattern]
                by_room[room - fits * length][pattern + (length,) * fits] += used
                count -= used * fits
        if count:
            fits = limit // length
            if count // fits:
                by_room[limit - fits * length][(length,) * fits] += count // fits
            if count % fits:
                by_room[limit - count % fits * length][(length,) * (count % fits)] += 1
    out: dict[tuple[int, ...], int] = {}
    for held in by_room:
        out.update(held)
    return out


def _entries(packs: dict[tuple[int, ...], int], limit: int) -> Plan:
    rows, taken, sequence = [], defaultdict(int), 0
    for pattern in sorted(packs):
        count, offset = packs[pattern], 0
        for length in dict.fromkeys(pattern):
            times = pattern.count(length)
            rows.append((length, taken[length], times, sequence, offset))
            taken[length] += times * count
            offset += times * length
        sequence += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return Plan(
        np.searchsorted(table[:, 0], np.arange(limit + 2)), table[:, 1], table[:, 2], table[:, 3], table[:, 4], sequence
    )


def place(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece."""
    # Ranks of one length begin at 0, so (length, rank) becomes one ascending key.
    most = int(max(plan.first_rank.max(initial=0), rank.max(initial=0))) + 1
    entry_length = np.repeat(np.arange(len(plan.first_entry) - 1), np.diff(plan.first_entry))
    entry = np.searchsorted(entry_length * most + plan.first_rank, length * most + rank, side="right") - 1
    nth = rank - plan.first_rank[entry]
    times = plan.per_sequence[entry]
    return plan.sequence[entry] + nth // times, plan.offset[entry] + nth % times * length


def cut_lengths(counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces per document and all piece lengths; the first piece of a cut document takes the remainder."""
    pieces = np.maximum(-(-counts // limit), 1)
    lengths = np.full(int(pieces.sum()), limit, np.int64)
    firsts = np.cumsum(pieces) - pieces
    lengths[firsts] = counts - (pieces - 1) * limit
    return pieces, lengths


def token_pieces(
    df: DataFrame, tokenizer: str, end_id: int = 0, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The pieces of all documents with their ids, written to the shared folder.

    ``ids`` holds little-endian unsigned 32-bit ids, the last of a document is
    ``end_id``. ``task`` and ``nth`` number the pieces of equal length: they are
    set while the table is written, and what was committed does not change.
    """
    small_batches(df.sparkSession)
    names = [id_col, "piece", "start", "length", "ids", "task", "nth"]

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for chunk in chunks(batches, CHUNK_BYTES):
            ids, counts = shared_tokens(tokenizer).encode(text_column(chunk, text_col))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            pieces, lengths = cut_lengths(counts + 1, limit)
            row = np.repeat(np.arange(len(pieces)), pieces)
            number = np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]
            ends = np.cumsum(lengths)
            start = ends - lengths - (np.cumsum(counts + 1) - counts - 1)[row]
            order = np.argsort(lengths, kind="stable")
            ordered = lengths[order]
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(lengths, minlength=limit + 1)
            offsets = np.concatenate(([0], 4 * ends)).astype(np.int32)
            packed = pa.Array.from_buffers(
                pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(lengths),
                    packed, pa.array(np.full(len(row), task), pa.int32()), pa.array(nth),
                ],
                names=names,
            )

    schema = (
        f"`{id_col}` {id_type(df, id_col)}, piece int, start bigint, length bigint, ids binary, task int, nth bigint"
    )
    return kept_table(df.select(id_col, text_col).mapInArrow(run, schema), "pieces", "zstd")


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` (from ``token_pieces``) without the numbering, with sequence_id and offset.

    Only the histogram of lengths, at most ``limit`` numbers, comes to the
    driver. A piece's rank among equal lengths is its number in the task that
    wrote it plus what earlier tasks wrote; nothing is sorted.
    """
    sizes = pieces.groupBy("task", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept_table(
        sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "ranks"
    )
    histogram = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(make_plan(histogram, limit))
    ranked = pieces.join(starts, ["task", "length"]).withColumn("_rank", F.col("_before") + F.col("nth"))
    kept = [c for c in pieces.columns if c not in ("task", "nth")]
    given = ranked.select(*kept, "_rank")
    fields = ", ".join(f"`{c}` {id_type(given, c)}" for c in kept)
    small_batches(pieces.sparkSession)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(kept.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(len(kept)).to_numpy(zero_copy_only=False)
            sequence, offset = place(plan.value, length, rank)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"]
            )

    return given.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(
    df: DataFrame, tokenizer: str, end_id: int = 0, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenize, cut and pack: one row per piece with the CRC-32 of its ids, its sequence and its place in it.

    A null or empty text is one piece that holds the end id alone. Documents of
    more than ``limit`` ids are cut, the first piece may be shorter. Rows are
    documents: repeated rows and null ids are packed like any other. An empty
    table gives no rows; other columns are not read. Sequences are numbered
    from 0 and filled from offset 0 without gaps.
    """
    pieces = token_pieces(df, tokenizer, end_id, limit, id_col, text_col)
    # The checksum is taken from the stored ids; the ids themselves need not travel further.
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), limit)

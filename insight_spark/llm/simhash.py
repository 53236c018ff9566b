"""SimHash near-duplicates found by multi-index hashing.

Fingerprints that differ in at most ``bits`` bits are cut into so few segments
that one segment differs in one bit at most. Each fingerprint therefore stands
in one table per segment, and looks up its segment's Hamming ball of radius one
there. Of two segments that differ in a bit one has a zero in that place, so
setting zero bits is enough; the whole distance is verified on what is found.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.llm.common import free_name, id_type, kept_table, map_chunks, text_key
from insight_spark.llm.components import connected_components

SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned SimHash of the ``words``-word shingles of a text; zero without a word."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) < words:
        hashes = [digest(joined, SEED)]
    else:
        ends = list(accumulate(len(word) + 1 for word in found))
        starts = [0, *ends[: len(ends) - words]]
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :])]
    return _majority(np.array(hashes, np.uint64))


def _majority(hashes: np.ndarray) -> int:
    set_bits = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):  # a long text takes no more memory than a short one
        rows = np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += rows.sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, text_key, fp) per row; ``fp`` is the fingerprint as a signed long, null text counts as empty."""

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        values = [fingerprint(text, words) for text in chunk.column(2).to_pylist()]
        signed = np.array(values, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*chunk.columns[:2], pa.array(signed)], names=["id", "text_key", "fp"])

    given = df.select(id_col, text_key(text_col).alias("text_key"), F.col(text_col).cast("string"))
    return map_chunks(given, work, f"id {id_type(df, id_col)}, text_key bigint, fp bigint")


def links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b) for all different values of ``prints.fp`` at most ``bits`` bits apart; a pair may come twice."""
    if not 0 <= bits < 64:
        raise ValueError("bits must be from 0 to 63")
    segments = (bits + 2) // 2  # so that floor(bits / segments) <= 1
    radius = bits // segments
    cuts = [64 * j // segments for j in range(segments + 1)]
    parts = [
        f"named_struct('seg', {j}, 'width', {b - a}, 'val', shiftrightunsigned(fp, {a}) & {_mask(b - a)}L)"
        for j, (a, b) in enumerate(zip(cuts, cuts[1:]))
    ]
    known = prints.select("fp").distinct()
    table = known.selectExpr("fp", f"inline(array({', '.join(parts)}))").select("seg", "val", F.col("fp").alias("b"))
    ball = "array(val)"
    if radius:
        ball = "array_distinct(concat(array(val), transform(sequence(0, width - 1), i -> val | shiftleft(1L, i))))"
    probes = known.selectExpr("fp", f"inline(array({', '.join(parts)}))").selectExpr(
        "seg", "fp AS a", f"explode({ball}) AS val"
    )
    return (
        probes.join(table, ["seg", "val"])
        .filter(f"a <> b AND bit_count(a ^ b) <= {bits}")
        .select("a", "b")
    )


def _mask(width: int) -> int:
    return -1 if width == 64 else (1 << width) - 1


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3
) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id, the smallest id of its near-duplicate group.

    Null and word-free texts have fingerprint zero and link like any other; a
    text of fewer words than a shingle is one shingle. Repeated rows and equal
    texts share a fingerprint and so a group. A null id has a fingerprint and
    takes part in its group, but is never the group's smallest id; a group of
    null ids has a null component_id. An empty table gives no rows. Other
    columns, whatever their names, are not read.

    Copies meet in one partial aggregation, so neither an index key nor an edge
    list grows with the number of copies.
    """
    prints = kept_table(fingerprints(df, id_col, text_col, words), "fingerprints")
    placed = _groups(prints, F.min("id"), links(prints, bits))
    return prints.join(placed, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first").alias("component_id"),
    )


def _groups(prints: DataFrame, least: Column, edges: DataFrame) -> DataFrame:
    """(fp, first) for every fingerprint: ``least``, a minimum over ``prints``, of its whole component under ``edges``.

    Written to the shared folder, so that both sides of a join with it are dealt
    anew and a hot fingerprint can be split.
    """
    labels = connected_components(edges).withColumnRenamed("node", "fp")
    groups = prints.groupBy("fp").agg(least.alias("first"))
    labelled = groups.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "first")
    firsts = labelled.groupBy("label").agg(F.min("first").alias("first"))
    return kept_table(labelled.drop("first").join(firsts, "label").select("fp", "first"), "components")


def keep_one(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3
) -> DataFrame:
    """One row, with all its columns, of every near-duplicate group: that of the smallest id.

    Among rows of the smallest id the one with the smallest text hash stays, of
    repeated rows the least by their columns as JSON. A null id counts as the greatest.
    """
    prints = kept_table(fingerprints(df, id_col, text_col, words), "fingerprints")
    return keep_first(df, prints, links(prints, bits), id_col, text_col)


def keep_first(df: DataFrame, prints: DataFrame, edges: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``keep_one`` for groups that ``edges`` make of ``prints`` (id, text_key, fp), a row per row of ``df``."""
    key = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("text_key").alias("text_key"))
    placed = _groups(prints, F.min(key), edges)
    doubled = prints.join(placed, "fp").filter(
        ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key")))
    )
    mark, drop_id, drop_key, row = (free_name(df, wish) for wish in ("text_key", "drop_id", "drop_key", "row"))
    dropped = doubled.select(F.col("id").alias(drop_id), F.col("text_key").alias(drop_key)).distinct()
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(drop_id)) & (F.col(mark) == F.col(drop_key))
    kept = df.withColumn(mark, text_key(text_col)).join(dropped, same, "left_anti")
    if not prints.groupBy("id", "text_key").count().filter("count > 1").isEmpty():
        rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != id_col])
        least = kept.groupBy(id_col, mark).agg(F.min_by(rest, F.to_json(rest)).alias(row))
        kept = least.select(id_col, *[F.col(row).getField(c).alias(c) for c in df.columns if c != id_col])
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])

"""Records of CSV files that Spark splits by bytes, whatever line breaks their quotes hold.

A split cannot know whether it begins inside a quoted field. So every split first
reports what it would do to either case: whether a field is open at its end, and how
many records begin in it. These effects are composed in file order, which tells every
split its true beginning; then each cuts its own records. What lies on both sides of
a border is put together from the few pieces that touch one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from insight_spark.operators.scale import kept

# A field is quoted from its first character on; other quotes are ordinary characters.
_CLOSED = re.compile(r'(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)(?:,|\Z))*+\Z')
_CLOSING = re.compile(r'(?:[^"]++|"")*+"[^,]*+(?:,|\Z)')


class Effect(NamedTuple):
    """What a run of lines does if it begins outside a quoted field (0) or inside one (1)."""

    open: tuple[int, int]  # a field is open at its end
    starts: tuple[int, int]  # records that begin in it
    owns: tuple[int, int]  # the record that is open at its end began in it


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line."""
    if '"' not in line:
        return inside
    if inside:
        closing = _CLOSING.match(line)
        if closing is None:
            return True
        line = line[closing.end() :]
        # A field that ends with the line ends the record; after a comma the next field begins.
    return _CLOSED.match(line) is None


class _Reader:
    """The effect of lines that come one by one."""

    def __init__(self):
        self.open, self.starts, self.owns = [False, True], [0, 0], [False, False]

    def add(self, line: str) -> None:
        for case in (0, 1):
            if not self.open[case]:
                if not line.strip():
                    continue
                self.starts[case] += 1
                self.owns[case] = True
            self.open[case] = open_after(line, self.open[case])

    def effect(self) -> Effect:
        owns = tuple(int(o and own) for o, own in zip(self.open, self.owns))
        return Effect(tuple(map(int, self.open)), tuple(self.starts), owns)


def csv_lines(spark: SparkSession, path, pattern: str | None = None) -> DataFrame:
    """(path, block, value): the lines of text files with the start of the split they came in."""
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def content_lines(files: DataFrame) -> DataFrame:
    """The same from (path, content) rows; each content is one split."""
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\r\n?", "\n")
    return files.select("path", F.lit(0).cast("bigint").alias("block"), F.explode(F.split(text, "\n")).alias("value"))


def _runs(batches) -> Iterator[tuple[tuple[str, int], list[str], bool]]:
    """((path, block), lines, whether it is the first batch of them); a split's lines come in order, after another split's."""
    last = None
    for batch in batches:
        paths, blocks, lines = (batch.column(i).to_pylist() for i in range(3))
        start = 0
        for at in range(1, len(lines) + 1):
            if at == len(lines) or paths[at] != paths[start] or blocks[at] != blocks[start]:
                key = (paths[start], blocks[start])
                yield key, lines[start:at], key != last
                last, start = key, at


def effects(lines: DataFrame) -> DataFrame:
    """(path, block, open, starts, owns) of every split."""

    def run(batches):
        found, reader, key = [], None, None
        for key_now, part, fresh in _runs(batches):
            if fresh:
                if reader is not None:
                    found.append((*key, *reader.effect()))
                reader, key = _Reader(), key_now
            for line in part:
                reader.add(line)
        if reader is not None:
            found.append((*key, *reader.effect()))
        if found:
            columns = list(zip(*found))
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(v) if isinstance(v, tuple) else v for v in c], k) for c, k in zip(columns, kinds)],
                names=["path", "block", "open", "starts", "owns"],
            )

    return lines.mapInArrow(run, "path string, block long, open array<long>, starts array<long>, owns array<long>")


def any_break(lines: DataFrame) -> bool:
    """Some record goes on in a next line: then a line that begins outside a quoted field ends inside one.

    Only lines with a quote are looked at, and not all once one is found.
    """
    def run(batches):
        for batch in batches:
            found = [line for line in batch.column(0).to_pylist() if open_after(line, False)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found[:1], pa.string())], names=["value"])

    return not lines.filter(F.contains("value", F.lit('"'))).select("value").mapInArrow(run, "value string").isEmpty()


def entries(effect: DataFrame) -> DataFrame:
    """(path, block, inside, origin, before): how each split truly begins.

    ``origin`` is the split in which the record open at its beginning began and
    ``before`` the number of records that began earlier in the file. A file's splits,
    one row per 128 MB or so, are composed in order.
    """

    def compose(splits: pd.DataFrame) -> pd.DataFrame:
        inside, origin, before, out = 0, -1, 0, []
        for row in splits.sort_values("block").itertuples():
            out.append((row.path, row.block, inside, origin, before))
            if row.open[inside] and row.owns[inside]:
                origin = row.block
            before += row.starts[inside]
            inside = int(row.open[inside])
        return pd.DataFrame(out, columns=["path", "block", "inside", "origin", "before"])

    return effect.groupBy("path").applyInPandas(compose, "path string, block long, inside int, origin long, before long")


def records(lines: DataFrame) -> DataFrame:
    """(path, row, record): every record of every file, numbered from 0, without empty lines.

    Line breaks within a record are single line feeds. A field that is never closed ends with
    its file.
    """
    begin = kept(entries(effects(lines)), "csv-splits")
    # One entry per split of the input: the origin of the record it begins inside of, or None.
    known = {(r["path"], r["block"]): r["origin"] if r["inside"] else None for r in begin.toArrow().to_pylist()}
    shared = lines.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        out: list[tuple] = []
        key = before = None
        held: list[str] = []
        began = opened = False
        nth = 0

        def put(whole: bool) -> None:
            out.append((*key, key[1] if began else before, nth - 1 if began else -1, whole, "\n".join(held)))
            held.clear()

        for key_now, part, fresh in _runs(batches):
            if fresh:
                if held:
                    put(False)  # goes on in the next split
                if key_now not in shared.value:
                    raise RuntimeError("the input was split in another way than before; read it again")
                key, before, nth = key_now, shared.value[key_now], 0
                opened, began = before is not None, False
            for line in part:
                if not opened:
                    if not line.strip():
                        continue
                    began = True
                    nth += 1
                held.append(line)
                opened = open_after(line, opened)
                if not opened:
                    put(began)
            if len(out) > 10_000:
                yield _batch(out)
                out.clear()
        if held:
            put(False)
        if out:
            yield _batch(out)

    cut = lines.mapInArrow(run, "path string, block long, origin long, nth long, whole boolean, record string")
    starts = begin.select("path", F.col("block").alias("origin"), "before")
    # Pieces of a record that lies across a border of splits; at most two of a split.
    joined = (
        cut.filter(~F.col("whole")).groupBy("path", "origin")
        .agg(F.max("nth").alias("nth"), F.array_sort(F.collect_list(F.struct("block", "record"))).alias("pieces"))
        .select("path", "origin", "nth", F.array_join(F.transform("pieces", lambda p: p["record"]), "\n").alias("record"))
    )
    every = cut.filter("whole").select("path", "origin", "nth", "record").unionByName(joined)
    return every.join(starts, ["path", "origin"]).select("path", (F.col("before") + F.col("nth")).alias("row"), "record")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "block", "origin", "nth", "whole", "record"]
    )

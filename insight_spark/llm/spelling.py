"""Spelling variants: words one inserted, deleted or replaced letter apart, by a bit-sliced position index.

For every (position, letter) the index holds a bitset over the words of a block.
A query word is read once; the words that agree with it so far, and those that
agree with one error, are two sets that move on together: a replaced letter keeps
its place, an inserted or deleted one shifts the position looked up by one. One
operation works on 64 words at a time.

Blocks keep the work near the number of real neighbours: of two words one edit
apart the first half or the second half of the shorter one's length is the same,
so only words that share a half are compared. A large block is cut into parts
that meet pairwise, each pair of parts a small group of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.llm.common import kept_table
from insight_spark.operators.scale import lookup

LETTERS = r"([a-zÀ-ÿ]+)"
# Words of a block that are compared in one group; a larger block is cut.
PART = 2048
# Words and letters of the groups that share one index.
INDEX_WORDS = 4096
INDEX_LETTERS = 1 << 17
QUERIES = 512  # worked on at once
ROWS_PER_TASK = 100_000


def runs(df: DataFrame, text_col: str = "text", *others: str) -> DataFrame:
    """(others, run): a row per maximal run of Latin letters of every text, A to Z lower-cased; null text: none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(F.col(text_col).cast("string"), upper, upper.lower())
    return df.select(*others, F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(1))).alias("run"))


def misspell(id_col: str, run_col: str = "run", modulus: int = 97) -> Column:
    """The run, less one letter where ``modulus`` divides the crc32 of ``id:run``; a null id counts as empty."""
    run = F.col(run_col)
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), run)
    h = F.crc32(named.cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % modulus == 0, cut).otherwise(run)


def vocabulary(words: DataFrame, word_col: str = "run", least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) for the words of at least so many letters and occurrences; null is no word."""
    return (
        words.select(F.col(word_col).alias("word")).filter(F.length("word") >= least_length)
        .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)
    )


def variants(counted: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``counted`` (word, n; each word once).

    Words are of a to z and U+00C0 to U+00FF; null and empty words are left out.
    ``form`` is the near word of the largest n (ties: the smallest), if that is at least
    ``factor`` times the word's n; ``root`` follows forms to the last. A word of any
    length is compared whole. An empty table gives no rows; other columns are not read.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, so that forms lead to an end")
    words = kept_table(
        counted.filter(F.length("word") > 0).select("word", F.col("n").cast("long").alias("n")), "vocabulary"
    )
    near = (
        neighbours(words)
        .groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best"))).alias("top"))
    )
    taken = -F.col("top.n") >= factor * F.col("n")
    formed = kept_table(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, F.col("top.best")).alias("form"), F.when(taken, -F.col("top.n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(formed)
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root) for the words with a form; n at least doubles with each step, so 63 steps suffice."""
    current = kept_table(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    for _ in range(7):
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = lookup(current, ahead, "root")
        current = kept_table(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if current.filter("moved").isEmpty():
            break
    return current.select("word", "root")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): near words found in one group; a word has a row per group that found any.

    Every near pair is found in one group only, so the counts add up.
    """
    total = words.count()
    placed = _blocks(words)
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, 4 * total // ROWS_PER_TASK)
    grouped = placed.repartition(tasks, "shorter", "block", "part", "other").sortWithinPartitions(
        "shorter", "block", "part", "other"
    )
    return grouped.mapInArrow(_search, "word string, n_near long, best_n long, best string")


def _blocks(words: DataFrame) -> DataFrame:
    """Where each word is compared: (shorter, block, part, other, ahead, role, word, n).

    A block is (length of the shorter word, which half, that half). ``role`` is 1 for an
    indexed word, 2 for a query, 3 for both.
    """
    halves = []
    for less in (0, 1):
        short = F.length("word") - less
        first = F.floor(short / 2).cast("int")
        for ahead, half in ((True, F.substring("word", F.lit(1), first)), (False, F.expr(f"right(word, length(word) - {less} - floor((length(word) - {less}) / 2))"))):
            halves.append(F.struct(
                short.alias("shorter"), F.lit(ahead).alias("ahead"),
                F.xxhash64(F.lit(ahead), short, half).alias("block"),
            ))
    # A block's words have its length or one letter more.
    rows = words.select("word", "n", F.inline(F.array(*halves))).filter("shorter > 0")
    large = rows.groupBy("block").count().filter(F.col("count") > PART).select(
        "block", F.ceil(F.col("count") / PART).cast("int").alias("parts")
    )
    rows = rows.join(kept_table(large, "large-blocks"), "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    places = F.when(
        F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("other"), F.lit(3).alias("role")))
    ).otherwise(F.concat(
        F.transform(every, lambda i: F.struct(own.alias("part"), i.alias("other"), F.lit(1).alias("role"))),
        F.transform(every, lambda i: F.struct(i.alias("part"), own.alias("other"), F.lit(2).alias("role"))),
    ))
    return rows.select("shorter", "block", "ahead", "word", "n", F.inline(places))


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; whole groups of like lengths are put together to one index."""
    held: list[list[tuple]] = []
    group: list[tuple] = []
    last = None
    words = letters = 0
    for batch in batches:
        names = ("shorter", "block", "part", "other", "ahead", "role", "word", "n")
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
            key = row[:4]
            if key != last:
                if len(group) > 1:
                    held.append(group)
                    words += len(group)
                    letters += sum(len(r[6]) for r in group)
                if held and (words >= INDEX_WORDS or letters >= INDEX_LETTERS or key[0] > 2 * held[0][0][0]):
                    yield from _work(held)
                    held, words, letters = [], 0, 0
                group, last = [], key
            group.append(row)
    if len(group) > 1:
        held.append(group)
    if held:
        yield from _work(held)


def _work(groups: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
    found = _match(groups)
    if found[0]:
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[0], pa.string()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64()), pa.array(found[3], pa.string())],
            names=["word", "n_near", "best_n", "best"],
        )


class PositionIndex:
    """A bitset over ``words`` for every (position, letter) that occurs; bit i stands for words[i]."""

    def __init__(self, words: list[str]):
        coded = [np.frombuffer(word.encode("latin-1"), np.uint8) for word in words]
        lengths = np.array([len(c) for c in coded])
        letters = np.concatenate(coded).astype(np.int64)
        places = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.keys, slot = np.unique(places * 256 + letters, return_inverse=True)
        self.wide = -(-len(words) // 64) * 64
        bits = np.zeros((len(self.keys) + 1, self.wide), bool)  # the last row: no word has it
        bits[slot, np.repeat(np.arange(len(words)), lengths)] = True
        self.table = _packed(bits)
        self.lengths = lengths

    def having(self, place: int, letters: np.ndarray) -> np.ndarray:
        """For each query letter the words with it at ``place``."""
        if place < 0:
            return np.zeros((len(letters), self.table.shape[1]), np.uint64)
        want = place * 256 + letters
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return self.table[np.where(self.keys[at] == want, at, len(self.keys))]

    def of_length(self, length: int) -> np.ndarray:
        bits = np.zeros((1, self.wide), bool)
        bits[0, : len(self.lengths)] = self.lengths == length
        return _packed(bits)[0]


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64, copy=False)


def near_sets(index: PositionIndex, queries: np.ndarray, shorter: int, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitsets per query (rows of letters of one length): words one edit away, and words with the same first ``ahead`` letters.

    A query of ``shorter`` letters is compared with words of its length and of one more, a
    query of ``shorter + 1`` letters with words of one less.
    """
    length = queries.shape[1]
    shape = (len(queries), index.table.shape[1])
    same = np.full(shape, ~np.uint64(0))
    begin = same.copy()
    replaced = np.zeros(shape, np.uint64)
    inserted = same.copy()  # the word's first letter is the additional one
    deleted = np.zeros(shape, np.uint64)
    for j in range(length):
        letters = queries[:, j]
        here = index.having(j, letters)
        if length == shorter:
            replaced = (replaced & here) | (same & ~here)
            same = same & here
            inserted = (inserted & index.having(j + 1, letters)) | same
        else:
            deleted = (deleted & index.having(j - 1, letters)) | same
            same = same & here
        if j + 1 == ahead:
            begin = same.copy()
    if length == shorter:
        return (replaced & index.of_length(shorter)) | (inserted & index.of_length(shorter + 1)), begin
    return deleted & index.of_length(shorter), begin


def _match(groups: list[list[tuple]]) -> tuple[list, list, list, list]:
    """Per query word with near words in its group: word, their number, the largest n, the smallest word of that n."""
    rows = [(g, *row) for g, group in enumerate(groups) for row in group]
    # In this order the first bit of a set is its best word.
    indexed = sorted((r for r in rows if r[6] & 1), key=lambda r: (-r[8], r[7]))
    out: tuple[list, list, list, list] = ([], [], [], [])
    if not indexed:
        return out
    index = PositionIndex([r[7] for r in indexed])
    members = np.zeros((len(groups), index.wide), bool)
    members[[r[0] for r in indexed], np.arange(len(indexed))] = True
    members = _packed(members)
    alike: dict[tuple, list[tuple]] = {}
    for r in rows:
        if r[6] & 2:
            alike.setdefault((r[1], len(r[7]), r[5]), []).append(r)
    for (shorter, length, ahead), asked in alike.items():
        step = max(1, min(QUERIES, (1 << 22) // length))
        for start in range(0, len(asked), step):
            part = asked[start : start + step]
            letters = np.frombuffer("".join(r[7] for r in part).encode("latin-1"), np.uint8).reshape(len(part), length)
            near, begin = near_sets(index, letters.astype(np.int64), shorter, shorter // 2)
            near &= begin if ahead else ~begin
            near &= members[[r[0] for r in part]]
            counts = np.bitwise_count(near).sum(1, dtype=np.int64)
            for i in np.flatnonzero(counts):
                word = int(np.flatnonzero(near[i])[0])
                bits = int(near[i, word])
                best = indexed[64 * word + (bits & -bits).bit_length() - 1]
                for column, value in zip(out, (part[i][7], int(counts[i]), best[8], best[7])):
                    column.append(value)
    return out

"""Closest strings by difflib ratio from a count-filtered index of letters and letter pairs.

A ratio of c or more over S letters in all means M >= c*S/2 matched letters. So two
such strings share M letters (with repeats), their lengths are at most a factor
(2-c)/c apart, and as the matched blocks are at most S-2M+1, they share 3M-S-1
letter pairs or more. Of two sets that share t items, the rarest ``size - t + m`` of
each share m. Every string therefore stands in the index under the m-sets of its
rarest letters, or pairs of letters where it is long, and only strings with a common
key are candidates. A hot key is cut into parts. The ratio of every candidate is
verified, so the result is exact.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from insight_spark.operators.scale import kept

# Counted items whose frequency orders all others; items beside them are the rarest.
ORDERED = 50_000
# Candidates of one key that one task makes.
KEY_PAIRS = 1 << 20
# Close matches are looked for first where there are more pairs than this.
FEW_PAIRS = 4_000_000
CLOSE = 0.9
BINS = 64
SLACK = 1e-9
LETTERS, TRIPLES, PAIRS = 1, 2, 3


def closest(probes: DataFrame, values: DataFrame, cutoff: float) -> DataFrame:
    """(scope, probe, value, ratio) for distinct (scope, probe) and (scope, value): the value of the greatest
    ratio that is ``cutoff`` or more, of equal ones the greatest value. A null scope, probe or value matches nothing."""
    if not 2 / 3 < cutoff <= 1:
        raise ValueError("the index needs a cutoff above 2/3")
    asked = kept(probes.dropna().distinct(), "probes")
    known = kept(values.dropna().distinct(), "values")
    order = _order(known)
    if cutoff >= CLOSE or asked.count() * known.count() <= FEW_PAIRS:
        return _verified(candidates(asked, known, cutoff, order), cutoff)
    # What has a close match needs no wider search.
    near = kept(_verified(candidates(asked, known, CLOSE, order), CLOSE), "close")
    rest = kept(asked.join(near, ["scope", "probe"], "left_anti"), "rest")
    return near.unionByName(_verified(candidates(rest, known, cutoff, order), cutoff))


def _items(text: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Letters and pairs of neighbouring letters, each with the number of its repeat, so that they are sets."""
    return _numbered(text), _numbered([text[i : i + 2] for i in range(len(text) - 1)])


def _numbered(parts) -> list[tuple[str, int]]:
    seen: dict[str, int] = {}
    out = []
    for part in parts:
        seen[part] = seen.get(part, 0) + 1
        out.append((part, seen[part]))
    return out


def _order(values: DataFrame):
    """Frequencies of the most frequent items of the values, sent to the executors."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                letters, pairs = _items(text)
                counts.update(letters)
                counts.update(pairs)
            if len(counts) > 500_000:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    partial = values.select("value").mapInArrow(run, "part string, nth int, n long")
    counted = partial.groupBy("part", "nth").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "part", "nth").limit(ORDERED).collect()
    return values.sparkSession.sparkContext.broadcast({(r["part"], r["nth"]): r["n"] for r in top})


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in counts], pa.string()), pa.array([n for _, n in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())],
        names=["part", "nth", "n"],
    )


def shared_letters(length: int, cutoff: float) -> int:
    """Letters that a string of this length shares with any string of the ratio, at least."""
    return ceil(cutoff * length / (2 - cutoff) - SLACK)


def shared_pairs(length: int, cutoff: float) -> int:
    """Letter pairs that it shares at least; may be negative."""
    return ceil((1.5 * cutoff - 1) * 2 * length / (2 - cutoff) - 1 - SLACK)


def keys(text: str, cutoff: float, order: dict[tuple[str, int], int]) -> Iterator[tuple]:
    """Keys of which two strings of the ratio have one in common, whatever their lengths.

    Both long: pairs of letters. One of them tiny: single letters. Otherwise: three letters.
    """
    length = len(text)
    if not length:
        yield (LETTERS,)
        return
    letters, pairs = _items(text)
    rank = lambda item: (order.get(item, 0), item)
    most = length * (2 - cutoff) / cutoff + SLACK  # the longest string it can match
    least = length * cutoff / (2 - cutoff) - SLACK
    if is_tiny(ceil(least), cutoff):
        yield from ((LETTERS, item) for item in letters)
    if not is_tiny(int(most), cutoff) and not is_long(ceil(least), cutoff):
        first = sorted(letters, key=rank)[: max(0, length - shared_letters(length, cutoff)) + 3]
        yield from ((TRIPLES, *some) for some in combinations(sorted(first), 3))
    if is_long(length, cutoff):
        together = 2 if cutoff >= 0.85 else 1
        first = sorted(pairs, key=rank)[: len(pairs) - shared_pairs(length, cutoff) + together]
        yield from ((PAIRS, *some) for some in combinations(sorted(first), together))


def is_tiny(length: int, cutoff: float) -> bool:
    """Too short to share three letters."""
    return shared_letters(length, cutoff) < 3


def is_long(length: int, cutoff: float) -> bool:
    """Long enough to share two pairs of letters."""
    return shared_pairs(length, cutoff) >= 2


def _keyed(strings: DataFrame, column: str, cutoff: float, order) -> DataFrame:
    """(scope, key, text): a row per key of every string."""

    def run(batches):
        for batch in batches:
            scopes, texts, found = [], [], []
            for scope, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for key in keys(text, cutoff, order.value):
                    scopes.append(scope)
                    texts.append(text)
                    found.append(repr(key))
                if len(found) > 100_000:
                    yield _key_batch(scopes, texts, found)
                    scopes, texts, found = [], [], []
            if found:
                yield _key_batch(scopes, texts, found)

    keyed = strings.select("scope", column).mapInArrow(run, f"scope string, {column} string, name string")
    return keyed.select("scope", F.xxhash64("name").alias("key"), column)


def _key_batch(scopes, texts, found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (scopes, texts, found)], names=["scope", "text", "name"])


def candidates(asked: DataFrame, known: DataFrame, cutoff: float, order) -> DataFrame:
    """(scope, probe, value) that share a key and are of matching lengths; a pair comes once per common key."""
    left, right = kept(_keyed(asked, "probe", cutoff, order), "probe-keys"), kept(_keyed(known, "value", cutoff, order), "value-keys")
    by = ["scope", "key"]
    sizes = left.groupBy(*by).agg(F.count("*").alias("n")).join(right.groupBy(*by).agg(F.count("*").alias("m")), by)
    hot = kept(
        sizes.filter(F.col("n") * F.col("m") > KEY_PAIRS).select(*by, F.ceil(F.col("n") * F.col("m") / KEY_PAIRS).cast("int").alias("parts")),
        "hot-keys",
    )
    parts = F.coalesce("parts", F.lit(1))
    cut = right.join(hot, by, "left").select(*by, "value", F.pmod(F.xxhash64("value"), parts).cast("int").alias("part"))
    asking = left.join(hot, by, "left").select(*by, "probe", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    shorter = F.least(F.length("probe"), F.length("value"))
    longer = F.greatest(F.length("probe"), F.length("value"))
    near = shorter >= longer * (cutoff / (2 - cutoff)) - SLACK
    return asking.join(cut, [*by, "part"]).filter(near).select("scope", "probe", "value")


def _verified(pairs: DataFrame, cutoff: float) -> DataFrame:
    """The best candidate of every probe by its ratio."""

    def run(batches):
        last = None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            fresh = [row for row, before in zip(rows, [last, *rows]) if row != before]
            last = rows[-1] if rows else last
            if fresh:
                yield _best(fresh, cutoff)

    part = F.pmod(F.xxhash64("value"), F.lit(8))
    # Copies of a pair lie next to each other; the pairs of one probe go to at most eight tasks.
    placed = pairs.repartition("scope", "probe", part).sortWithinPartitions("scope", "probe", "value")
    found = placed.mapInArrow(run, "scope string, probe string, value string, ratio double")
    return found.groupBy("scope", "probe").agg(F.max(F.struct("ratio", "value")).alias("best")).select(
        "scope", "probe", F.col("best.value").alias("value"), F.col("best.ratio").alias("ratio")
    )


def _best(rows: list[tuple[str, str, str]], cutoff: float) -> pa.RecordBatch:
    """Per probe of the rows the best value; a pair whose common letters cannot reach it is left out."""
    texts = sorted({text for _, *pair in rows for text in pair})
    place = {text: i for i, text in enumerate(texts)}
    counts = np.zeros((len(texts), BINS), np.int32)
    for i, text in enumerate(texts):
        for letter, n in Counter(text).items():
            counts[i, ord(letter) % BINS] += n
    left, right = (np.array([place[row[c]] for row in rows]) for c in (1, 2))
    total = counts[left].sum(1) + counts[right].sum(1)
    bound = np.where(total > 0, 2.0 * np.minimum(counts[left], counts[right]).sum(1) / np.maximum(total, 1), 1.0)
    best: dict[tuple[str, str], tuple[float, str]] = {}
    for i in np.argsort(-bound, kind="stable").tolist():
        scope, probe, value = rows[i]
        if bound[i] + SLACK < max(cutoff, best.get((scope, probe), (0.0, ""))[0]):
            continue
        ratio = difflib.SequenceMatcher(None, value, probe).ratio()
        if ratio >= cutoff and (ratio, value) > best.get((scope, probe), (0.0, "")):
            best[scope, probe] = (ratio, value)
    found = sorted(best)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([s for s, _ in found], pa.string()), pa.array([p for _, p in found], pa.string()),
            pa.array([best[key][1] for key in found], pa.string()), pa.array([best[key][0] for key in found], pa.float64()),
        ],
        names=["scope", "probe", "value", "ratio"],
    )

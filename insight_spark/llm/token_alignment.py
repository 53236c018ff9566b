"""Alignment of two tokenizers over the same texts, each distinct text aligned once.

Rows are shuffled by their full text, so that copies meet and are counted; each
distinct text is tokenised by both vocabularies and cut into groups where tokens of
both end at the same byte. A pair of ids that share a group is linked. A text's
linked pairs add its number of copies to the corpus-wide pair counts, the counts
give the text its measures, and the measures are joined back to the rows.

Both tokenizers must cut before a single space, and after a line break between two
characters that are not white space, so what lies between two such cuts is aligned
once per worker.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.llm.common import chunks, kept_table, map_chunks, small_batches
from insight_spark.llm.tokens import _BLANK, _careful_cuts
from insight_spark.operators.scale import lookup

# Stretches remembered per worker; beyond that the memory starts anew.
REMEMBERED = 400_000
# Pairs whose counts are sent to the executors: the most frequent, at most so many (17 bytes each).
FREQUENT = 1 << 20
# Pairs counted in a task before their partial counts are handed on.
HELD_PAIRS = 1 << 20
SPACE = "\u2581"
# Signs before which a word is cut, where no entry of B has a letter before them.
SIGNS = ",.!?;:)\""
# Links of a group that are made one by one.
LARGE_GROUP = 4096


class Aligner:
    """Groups and links of texts under a byte-level BPE file (A) and a SentencePiece model (B)."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(bytes_path)
        self.first.encode_special_tokens = True
        self.second = SentencePieceProcessor(model_file=pieces_path)
        letters = _byte_letters()
        entries = {i: entry for entry, i in self.first.get_vocab().items()}
        first = [bytes(letters.get(c, 0) for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        second = [self._piece(i) for i in range(self.second.get_piece_size())]
        self.height, self.width = len(first), len(second)
        self.first_bytes, self.second_bytes = _Strings(first), _Strings(second)
        # Each id written with what may follow it: within a group, at the end of A's side, at the end of the group.
        numbers = [str(i).encode() for i in range(max(self.height, self.width))]
        self.written = _Strings(
            [n + b"," for n in numbers[: self.height]] + [n + b"|" for n in numbers[: self.height]]
            + [n + b"," for n in numbers[: self.width]] + [n + b";" for n in numbers[: self.width]]
        )
        plain = [self.second.id_to_piece(i) for i in range(self.width) if not self.second.is_byte(i)]
        # Cuts are safe where no entry reaches over them.
        self.spaces = not any(SPACE in piece.lstrip(SPACE) for piece in plain)
        self.breaks = self.spaces and not any("\n" in piece for piece in plain)
        inside = "\0".join(plain)
        self.signs = "".join(c for c in SIGNS if not re.search(rf"[^\W\d_]{re.escape(c)}", inside)) if self.breaks else ""
        self._forget()

    def _piece(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace(SPACE, " ").encode()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes | None] = []  # written out, ending in ";"; None: the bytes differ
        self.sizes = np.empty((0, 4), np.int64)  # ids of A, ids of B, groups, links
        self.starts = np.zeros(1, np.int64)
        self.pairs = np.empty(0, np.int64)
        self.times = np.empty(0, np.int64)

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """For texts that are neither null nor empty: (ids of A, ids of B, groups, links) per text, the
        groups written out, the number of distinct pairs per text, and those pairs (a * width + b) with
        the times each is linked, text after text."""
        if len(self.groups) > REMEMBERED:
            self._forget()
        stretches, codes, per_text = self._stretches(texts)
        places = self._places(stretches)
        bad = np.fromiter((self.groups[p] is None for p in places.tolist()), bool, len(places))
        text_of = np.repeat(np.arange(len(texts)), per_text)
        taken = places[codes]
        again = np.unique(text_of[bad[codes]])
        if len(again):  # such a text is judged as a whole
            whole = self._places([" " + texts[int(i)].as_py() for i in again])
            lone = np.isin(text_of, again)
            first = np.concatenate(([True], text_of[1:] != text_of[:-1]))
            taken[lone & first] = whole
            keep = ~lone | first
            taken, text_of = taken[keep], text_of[keep]
        return self._collect(taken, text_of, len(texts))

    def _collect(self, taken: np.ndarray, text_of: np.ndarray, count: int):
        bounds = np.searchsorted(text_of, np.arange(count + 1))
        sums = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(self.sizes[taken], axis=0)))
        sizes = sums[bounds[1:]] - sums[bounds[:-1]]
        distinct, inverse = np.unique(taken, return_inverse=True)
        names = np.array([self.groups[p] or b"" for p in distinct.tolist()] + [b""], object)[inverse].tolist()
        written = [b"".join(names[a:b])[:-1] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        # Stretches per text, then the pairs of those.
        held, copies = np.unique(text_of * len(distinct) + inverse, return_counts=True)
        owner, place = held // len(distinct), distinct[held % len(distinct)]
        many = self.starts[place + 1] - self.starts[place]
        at = _ranges(self.starts[place], many)
        limit = self.width * self.height
        key, times = _summed(np.repeat(owner, many) * limit + self.pairs[at], self.times[at] * np.repeat(copies, many))
        return sizes, written, np.bincount(key // limit, minlength=count), key % limit, times

    def _stretches(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct stretches of " " + text, the number of each stretch among them, and the stretches per text."""
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts, "")
        if not self.spaces:
            coded = spaced.dictionary_encode()
            return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.ones(len(texts), np.int64)
        whole = pc.match_substring_regex(texts, rf"\x00|{SPACE}")
        careful = pc.or_(whole, pc.match_substring_regex(spaced, rf" [{_BLANK}]|[{_BLANK}] "))
        cut = pc.if_else(careful, "", texts)
        if self.breaks:
            cut = pc.replace_substring_regex(cut, rf"([^{_BLANK}]\n)([^{_BLANK}])", "\\1\x00\\2")
        if self.signs:
            cut = pc.replace_substring_regex(cut, rf"(\pL)([{re.escape(self.signs)}])", "\\1\x00\\2")
        cut = pc.binary_join_element_wise(pa.scalar(" "), pc.replace_substring(cut, " ", "\x00 "), "")
        lists = pc.split_pattern(cut, "\x00")
        rows = np.flatnonzero(careful.to_numpy(zero_copy_only=False))
        if len(rows):
            split = []
            for i in rows.tolist():
                text = spaced[i].as_py()
                split.append([text] if whole[i].as_py() else _careful_cuts(text))
            where = np.arange(len(texts))
            where[rows] = len(texts) + np.arange(len(rows))
            lists = pa.concat_arrays([lists, pa.array(split, pa.list_(pa.string()))]).take(pa.array(where))
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), per_text

    def _places(self, stretches: list[str]) -> np.ndarray:
        known = self.known
        new = [s for s in stretches if s not in known]
        for start in range(0, len(new), 20_000):
            self._learn(new[start : start + 20_000])
        return np.fromiter((known[s] for s in stretches), np.int64, len(stretches))

    def _learn(self, stretches: list[str]) -> None:
        first = [e.ids for e in self.first.encode_batch_fast(stretches, add_special_tokens=False)]
        # B puts a space before what it is given; behind a line break none may stand.
        spaced = [s.startswith(" ") for s in stretches]
        second = self.second.encode([s[1:] if own else "\n" + s for s, own in zip(stretches, spaced)], num_threads=1)
        second = [ids if own else ids[2:] for ids, own in zip(second, spaced)]
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (first, second))
        a, b = (np.array([i for part in ids for i in part], np.int64) for ids in (first, second))
        raw = [s.encode() for s in stretches]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        good = self._same_bytes(raw, size, a, n_a, b, n_b)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b, size = (np.where(good, n, 0) for n in (n_a, n_b, size))
        groups, pairs, times, owner, texts = self._grouped(a, n_a, b, n_b, np.cumsum(size))
        texts = [t if ok else None for t, ok in zip(texts, good.tolist())]
        base, count = len(self.pairs), len(stretches)
        links = np.bincount(owner, times, count).astype(np.int64)
        self.known.update(zip(stretches, range(len(self.groups), len(self.groups) + count)))
        self.groups += texts
        self.sizes = np.concatenate((self.sizes, np.stack((n_a, n_b, groups, links), axis=1)))
        self.starts = np.concatenate((self.starts, base + np.cumsum(np.bincount(owner, minlength=count))))
        self.pairs = np.concatenate((self.pairs, pairs))
        self.times = np.concatenate((self.times, times))

    def _same_bytes(self, raw, size, a, n_a, b, n_b) -> np.ndarray:
        """Which stretches both tokenizers give back."""
        good = np.ones(len(raw), bool)
        for strings, ids, count in ((self.first_bytes, a, n_a), (self.second_bytes, b, n_b)):
            total = np.concatenate(([0], np.cumsum(strings.lengths[ids])))
            ends = np.cumsum(count)
            good &= total[ends] - total[ends - count] == size
        for strings, ids, count in ((self.first_bytes, a, n_a), (self.second_bytes, b, n_b)):
            made = strings.joined(ids[np.repeat(good, count)])
            given = np.frombuffer(b"".join(r for r, ok in zip(raw, good.tolist()) if ok), np.uint8)
            wrong = np.flatnonzero(made != given)
            if len(wrong):
                at = np.flatnonzero(good)
                good[at[np.searchsorted(np.cumsum(size[at]), wrong, "right")]] = False
        return good

    def _grouped(self, a, n_a, b, n_b, stops):
        """Groups per stretch; the linked pairs with their times and stretches; the groups written out."""
        end_a, end_b = (np.cumsum(s.lengths[ids]) for s, ids in ((self.first_bytes, a), (self.second_bytes, b)))
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        stretch = np.searchsorted(stops, common)  # of each group
        in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        to_a, to_b = np.cumsum(in_a), np.cumsum(in_b)
        # Every id of A with every id of B in its group; large groups by their distinct ids.
        large = in_a * in_b > LARGE_GROUP
        many = np.where(large[group_a], 0, in_b[group_a])
        partner = _ranges((to_b - in_b)[group_a], many)
        limit = self.height * self.width
        keys = [np.repeat(stretch[group_a] * limit + a * self.width, many) + b[partner]]
        times = [np.ones(len(partner), np.int64)]
        for g in np.flatnonzero(large).tolist():
            left, n = np.unique(a[to_a[g] - in_a[g] : to_a[g]], return_counts=True)
            right, m = np.unique(b[to_b[g] - in_b[g] : to_b[g]], return_counts=True)
            keys.append((stretch[g] * limit + left[:, None] * self.width + right).reshape(-1))
            times.append((n[:, None] * m).reshape(-1))
        key, times = _summed(np.concatenate(keys), np.concatenate(times))
        # A's ids of a group stand before B's.
        place_a, place_b = np.arange(len(a)) + (to_b - in_b)[group_a], np.arange(len(b)) + to_a[group_b]
        piece = np.empty(len(a) + len(b), np.int64)
        piece[place_a] = a + np.where(np.arange(1, len(a) + 1) == to_a[group_a], self.height, 0)
        piece[place_b] = 2 * self.height + b + np.where(np.arange(1, len(b) + 1) == to_b[group_b], self.width, 0)
        line = self.written.joined(piece).tobytes()
        ends = np.cumsum(n_a + n_b)
        byte_ends = np.concatenate(([0], np.cumsum(self.written.lengths[piece])))[np.concatenate(([0], ends))].tolist()
        texts = [line[x:y] for x, y in zip(byte_ends[:-1], byte_ends[1:])]
        return np.bincount(stretch, minlength=len(stops)), key % limit, times, key // limit, texts


class _Strings:
    """Byte strings one after the other."""

    def __init__(self, parts: list[bytes]):
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def joined(self, which: np.ndarray) -> np.ndarray:
        return self.flat[_ranges(self.starts[which], self.lengths[which])]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start, as many as its count."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def _byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=1)
def shared_aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """One pair of tokenizers and one memory per worker process."""
    return Aligner(bytes_path, pieces_path)


def text_digest(text_col: str) -> Column:
    """Names a text; null for the null and the empty text."""
    text = F.col(text_col).cast("string")
    return F.unhex(F.sha2(F.when(text != "", text).cast("binary"), 256))


def aligned_texts(df: DataFrame, bytes_path: str, pieces_path: str, text_col: str = "text") -> DataFrame:
    """Per distinct text that is not null or empty: text_key, copies, n_a, n_b, n_groups, n_links, groups, pairs, times.

    ``groups`` is the sha256 of the groups written out, or '' where either tokenizer does not
    give back the text; then all numbers are 0.
    """
    texts = df.select(F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    distinct = texts.groupBy("text").agg(F.count("*").alias("copies"))

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        aligner = shared_aligner(bytes_path, pieces_path)
        sizes, written, per_text, pairs, times = aligner.align(chunk.column(2))
        digests = [hashlib.sha256(w).hexdigest() if w else "" for w in written]
        offsets = pa.array(np.concatenate(([0], np.cumsum(per_text))).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [*chunk.columns[:2], *(pa.array(sizes[:, i]) for i in range(4)), pa.array(digests, pa.string()),
             pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(times))],
            names=["text_key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
        )

    return map_chunks(
        distinct.select(text_digest("text").alias("text_key"), "copies", "text"), work,
        "text_key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, "
        "pairs array<long>, times array<long>",
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): in how many documents the pair is linked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for chunk in chunks(batches):
            lists = chunk.column(1)
            weights = np.repeat(chunk.column(0).to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            pairs, counts = _summed(
                np.concatenate((pairs, lists.flatten().to_numpy())), np.concatenate((counts, weights))
            )
            if len(pairs) > HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])
                pairs, counts = pairs[:0], counts[:0]
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    small_batches(aligned.sparkSession)
    partial = aligned.select("copies", "pairs").mapInArrow(run, "pair long, n long")
    return partial.groupBy("pair").agg(F.sum("n").alias("n"))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    if not len(keys):
        return keys, values
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[heads], np.add.reduceat(values, heads)


def align(
    df: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text",
    frequent: int = FREQUENT,
) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, and one that either tokenizer does not give back byte for byte,
    has zeros and ''. Repeated rows and null ids stay and count as documents; an empty
    table gives no rows; other columns are not read.

    Counts of at most ``frequent`` pairs are sent to the executors, the most frequent ones;
    links of the others, each of which few documents hold, meet their counts in a join.
    """
    spark = df.sparkSession
    rows = kept_table(df.select(F.col(id_col).alias("id"), text_digest(text_col).alias("text_key")), "keyed")
    aligned = kept_table(aligned_texts(df, bytes_path, pieces_path, text_col), "aligned", codec="zstd")
    width = shared_aligner(bytes_path, pieces_path).width
    counted = kept_table(pair_counts(aligned), "pair-counts")
    # One row per id of A: no more than its vocabulary.
    tops = counted.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n").alias("top"))
    judged = kept_table(
        counted.withColumn("a", F.expr(f"pair div {width}")).join(F.broadcast(tops), "a")
        .select("pair", "n", (F.col("n") == F.col("top")).alias("best"), F.floor(8 * F.log2("n")).cast("int").alias("level")),
        "pair-levels",
    )
    least, held = 1 << 30, 0
    for level, pairs in sorted(judged.groupBy("level").count().collect(), reverse=True):  # at most 8 x 64 levels
        if held + pairs > frequent:
            break
        least, held = level, held + pairs
    sent = judged.filter(F.col("level") >= least).select("pair", "n", "best").toArrow().sort_by("pair")
    table = spark.sparkContext.broadcast(tuple(sent.column(i).to_numpy() for i in range(3)))

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        pairs, counts, best = table.value
        lists = chunk.column(1)
        asked, times = lists.flatten().to_numpy(), chunk.column(2).flatten().to_numpy()
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.minimum(np.searchsorted(pairs, asked), max(len(pairs) - 1, 0))
        hit = pairs[at] == asked if len(pairs) else np.zeros(len(asked), bool)
        n = np.zeros(len(asked), np.int64)
        top = np.zeros(len(asked), bool)
        n[hit], top[hit] = counts[at[hit]], best[at[hit]]
        ends = np.cumsum(lengths)

        def summed(values: np.ndarray) -> pa.Array:
            total = np.concatenate(([0], np.cumsum(values)))
            return pa.array(total[ends] - total[ends - lengths])

        missed = np.concatenate(([0], np.cumsum(~hit)))
        offsets = pa.array(np.concatenate(([0], missed[ends])).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [chunk.column(0), summed(times * top), summed(times * n),
             pa.ListArray.from_arrays(offsets, pa.array(asked[~hit])), pa.ListArray.from_arrays(offsets, pa.array(times[~hit]))],
            names=["text_key", "n_best", "count_sum", "rare", "rare_times"],
        )

    scored = kept_table(
        map_chunks(
            aligned.select("text_key", "pairs", "times"), work,
            "text_key binary, n_best long, count_sum long, rare array<long>, rare_times array<long>",
        ),
        "scored",
    )
    rare = (
        scored.select("text_key", F.explode(F.arrays_zip("rare", "rare_times")).alias("link"))
        .select("text_key", F.col("link.rare").alias("pair"), F.col("link.rare_times").alias("times"))
        .join(judged.filter(F.col("level") < least), "pair")
        .select("text_key", (F.col("best").cast("long") * F.col("times")).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
    )
    sums = scored.select("text_key", "n_best", "count_sum").unionByName(rare).groupBy("text_key").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    measures = kept_table(
        aligned.select("text_key", "n_a", "n_b", "n_groups", "n_links", "groups").join(sums, "text_key"), "measures"
    )
    return lookup(rows, measures, "text_key").select(
        F.col("id").alias(id_col), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("groups", F.lit("")).alias("groups_sha256"),
    )

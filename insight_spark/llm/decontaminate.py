"""Benchmark decontamination by spaced seeds.

Fixed masks pick some of a few adjacent words; equal picks of a benchmark item
and a document give the same hash, even where a word between them was replaced.
A filter of fixed size lets through the places of a document whose hash may
belong to an item. Only these, with the words around them, are joined with the
items' hashes, and every alignment found is verified word by word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.llm.common import chunks, free_name, id_type, kept_table, map_chunks, small_batches, text_key

# Fixed masks: six words each out of 8, 10 and 12. Together they meet 98 of 100 stretches of
# 15 words in which three were replaced.
MASKS = ("11001111", "1100101011", "110100100101")
# Items of up to so many words must match as a whole, so their masks are made for their length.
SHORT = 13
# An overlap is a stretch of at least so many words (of the whole item, if that is shorter) ...
MIN_OVERLAP = 13
# ... that begins and ends with an equal word and has at least this percentage of equal words.
MIN_EQUAL = 80
# Words kept on either side of a hit for the verification.
MARGIN = 40
# The filter has 2**FILTER_BITS bits and tests PROBES of them, however many items there are.
FILTER_BITS = 26
PROBES = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(10).integers(1 << 62, 1 << 63, 64, np.uint64) | np.uint64(1)


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, one per word
    counts: np.ndarray  # words per text


def split(texts: pa.Array) -> Words:
    """Runs of letters and digits in lower case, as 64-bit hashes."""
    plain = pc.utf8_lower(pc.replace_substring_regex(texts, r"[^\pL\pN\pM]+", " "))
    lists = pc.split_pattern(pc.utf8_trim(plain, " "), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    hashed = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # a text without a word splits into one empty word
        real = codes != blank
        counts = np.add.reduceat(real, np.cumsum(counts) - counts, dtype=np.int64) if len(counts) else counts
        codes = codes[real]
    return Words(hashed[codes] if len(codes) else np.empty(0, np.uint64), counts)


def short_masks(length: int) -> tuple[str, ...]:
    """Masks over a whole item of ``length`` words, of which any accepted match fits one.

    Its first and last word are equal and at most a fifth of the others replaced, so of one
    part more than there are replaced words one part is whole.
    """
    if length < 3:
        return ("1" * length,)
    parts = length * (100 - MIN_EQUAL) // 100 + 1
    cuts = [1 + (length - 2) * i // parts for i in range(parts + 1)]
    return tuple(
        "1" + "".join("1" if a <= i < b else "0" for i in range(1, length - 1)) + "1" for a, b in zip(cuts, cuts[1:])
    )


def seeds(words: Words, masks: tuple[str, ...] = MASKS):
    """(key, place) per mask, for every place where the mask fits into a text."""
    total = len(words.hashes)
    left = np.repeat(np.cumsum(words.counts), words.counts) - np.arange(total)
    for number, mask in enumerate(masks):
        place = np.flatnonzero(left >= len(mask))
        key = np.full(len(place), number + 1, np.uint64) * _MIX
        for shift in (i for i, sign in enumerate(mask) if sign == "1"):
            key += words.hashes[place + shift] * _FACTORS[shift]
        key ^= key >> np.uint64(32)
        yield key * _MIX, place


def _probes(key: np.ndarray):
    shift = np.uint64(64 - FILTER_BITS)
    for probe in range(PROBES):
        yield (key * _FACTORS[probe + 32]) >> shift


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words, item_no) per item with text, written to the shared folder.

    ``words`` holds the words' hashes, 8 bytes each; ``item_no`` is unique.
    """

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        words = split(chunk.column(1))
        return pa.RecordBatch.from_arrays([chunk.column(0), _packed(words.hashes, words.counts)], names=["item_id", "words"])

    texts = items.select(id_col, F.col(text_col).cast("string")).dropna()
    listed = map_chunks(texts, work, f"item_id {id_type(items, id_col)}, words binary")
    return kept_table(listed.withColumn("item_no", F.monotonically_increasing_id()), "items")


def _packed(hashes: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], 8 * np.cumsum(counts))).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(hashes))]
    )


def all_masks(items: DataFrame, masks: tuple[str, ...] = MASKS) -> tuple[str, ...]:
    """The masks, and those for the lengths of the short items that there are (at most SHORT lengths)."""
    size = F.expr("octet_length(words) div 8")
    lengths = items.select(size.alias("n")).filter(F.col("n").between(1, SHORT)).distinct().collect()
    return (*masks, *(mask for n in sorted(r["n"] for r in lengths) for mask in short_masks(n)))


def item_seeds(items: DataFrame, masks: tuple[str, ...] = MASKS, general: int = len(MASKS)) -> DataFrame:
    """(key, item_no, item_pos) for every seed of the items, once per key and place.

    Masks after the first ``general`` are for items of just their length.
    """
    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        held = chunk.column(1).to_pylist()
        words = Words(np.frombuffer(b"".join(held), np.uint64), np.array([len(w) // 8 for w in held]))
        begin = np.cumsum(words.counts) - words.counts
        size = np.repeat(words.counts, words.counts)
        keys, places = [], []
        for number, (key, place) in enumerate(seeds(words, masks)):
            fits = size[place] > SHORT if number < general else size[place] == len(masks[number])
            keys.append(key[fits])
            places.append(place[fits])
        place = np.concatenate(places)
        item = np.repeat(np.arange(len(held)), words.counts)[place]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(keys).view(np.int64)), chunk.column(2).take(pa.array(item)),
                pa.array((place - begin[item]).astype(np.int32)),
            ],
            names=["key", "item_no", "item_pos"],
        )

    return map_chunks(items, work, "key bigint, item_no bigint, item_pos int").distinct()


def build_filter(keys: DataFrame) -> np.ndarray:
    """The bit filter of all keys as 64-bit words.

    The bits are set in Spark; at most 2**(FILTER_BITS - 6) numbers come to the
    driver, whatever the number of keys.
    """

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        key = chunk.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        bit = np.unique(np.concatenate(list(_probes(key))))
        word, first = np.unique(bit >> np.uint64(6), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first)
        return pa.RecordBatch.from_arrays(
            [pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))], names=["word", "bits"]
        )

    found = map_chunks(keys.select("key"), work, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = found.toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _passes(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places whose key may be in the filter."""
    kept = np.arange(len(key))
    for probe in range(PROBES):
        bit = (key[kept] * _FACTORS[probe + 32]) >> np.uint64(64 - FILTER_BITS)
        kept = kept[(bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]
        if not len(kept):
            break
    return kept


def hit_regions(df: DataFrame, bits, masks: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """Stretches of documents around places that pass the filter, written to the shared folder.

    (region, doc_id, text_key, words, places, keys): the stretch's word hashes,
    and per hit its place in the stretch and its key. ``region`` is unique.
    """
    small_batches(df.sparkSession)
    names = ["region", "doc_id", "text_key", "words", "places", "keys"]
    reach = max(map(len, masks)) + MARGIN

    def run(batches):
        from pyspark import TaskContext

        region = TaskContext.get().partitionId() << 33
        for chunk in chunks(batches):
            words = split(chunk.column(2))
            found = [(place[kept], key[kept]) for key, place in seeds(words, masks) for kept in (_passes(key, bits.value),)]
            place = np.concatenate([p for p, _ in found])
            if not len(place):
                continue
            order = np.argsort(place, kind="stable")
            place, key = place[order], np.concatenate([k for _, k in found])[order]
            doc = np.repeat(np.arange(len(words.counts)), words.counts)[place]
            new = np.concatenate(([True], (np.diff(place) > 2 * reach) | (np.diff(doc) > 0)))
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(place)))
            ends = np.cumsum(words.counts)
            owner = doc[first]
            begin = np.maximum(place[first] - MARGIN, (ends - words.counts)[owner])
            stop = np.minimum(place[first + sizes - 1] + reach, ends[owner])
            lengths = stop - begin
            at = np.arange(int(lengths.sum())) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(region + np.arange(len(first))), chunk.column(0).take(pa.array(owner)),
                    chunk.column(1).take(pa.array(owner)), _packed(words.hashes[at], lengths),
                    pa.ListArray.from_arrays(offsets, pa.array((place - np.repeat(begin, sizes)).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(key.view(np.int64))),
                ],
                names=names,
            )
            region += len(first)

    schema = (
        f"region bigint, doc_id {id_type(df, id_col)}, text_key bigint, words binary, places array<int>, keys array<bigint>"
    )
    given = df.select(id_col, text_key(text_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return kept_table(given.mapInArrow(run, schema), "regions")


def overlap(document: np.ndarray, item: np.ndarray, shift: int) -> int:
    """Length of the longest stretch with enough equal words when the item begins ``shift`` words into the document."""
    low, high = max(0, -shift), min(len(item), len(document) - shift)
    equal = document[low + shift : high + shift] == item[low:high]
    places = np.flatnonzero(equal)
    if not len(places):
        return 0
    # A stretch has enough equal words if its sum of these steps is not negative.
    total = np.concatenate(([0], np.cumsum(np.where(equal, 100 - MIN_EQUAL, -MIN_EQUAL))))
    starts, ends = total[places], total[places + 1]
    earliest = np.searchsorted(-np.minimum.accumulate(starts), -ends)
    return int((places - places[np.minimum(earliest, np.arange(len(places)))]).max()) + 1


def matches(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS,
) -> DataFrame:
    """(doc_id, text_key, item_id, overlap): every item a document overlaps with, and the longest overlap in words.

    Words are runs of letters and digits, compared in lower case. A short item matches
    as a whole, one of a single word wherever that word stands: leave out items that
    are no text. Null and empty texts on either side match nothing.
    """
    listed = item_words(items, item_col, item_text_col)
    general = len(masks)
    masks = all_masks(listed, masks)
    sown = kept_table(item_seeds(listed, masks, general), "seeds")
    bits = df.sparkSession.sparkContext.broadcast(build_filter(sown))  # 2**FILTER_BITS bits
    regions = hit_regions(df, bits, masks, id_col, text_col)
    hits = regions.select("region", F.explode(F.arrays_zip("places", "keys")).alias("_h")).select(
        "region", F.col("_h.places").alias("place"), F.col("_h.keys").alias("key")
    )
    aligned = hits.join(sown, "key").select("region", "item_no", (F.col("place") - F.col("item_pos")).alias("shift")).distinct()
    given = (
        aligned.join(regions.select("region", "doc_id", "text_key", F.col("words").alias("doc_words")), "region")
        .join(listed.withColumnRenamed("words", "item_words"), "item_no")
        .select("doc_id", "text_key", "item_id", "doc_words", "item_words", "shift")
    )

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        documents, texts, shifts = (chunk.column(i).to_pylist() for i in (3, 4, 5))
        found, enough = [], []
        for document, item, shift in zip(documents, texts, shifts):
            item = np.frombuffer(item, np.uint64)
            found.append(overlap(np.frombuffer(document, np.uint64), item, shift))
            enough.append(found[-1] >= min(MIN_OVERLAP, len(item)))
        out = pa.RecordBatch.from_arrays(
            [*chunk.columns[:3], pa.array(found, pa.int32())], names=["doc_id", "text_key", "item_id", "overlap"]
        )
        return out.filter(pa.array(enough, pa.bool_()))

    kinds = f"doc_id {id_type(df, id_col)}, text_key bigint, item_id {id_type(items, item_col)}, overlap int"
    return map_chunks(given, work, kinds).groupBy("doc_id", "text_key", "item_id").agg(F.max("overlap").alias("overlap"))


def _same_row(flagged: DataFrame, id_col: str, mark: str) -> Column:
    return F.col(f"`{id_col}`").eqNullSafe(flagged[flagged.columns[0]]) & (F.col(mark) == flagged[flagged.columns[1]])


def report(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """Per row: id, contaminated, items (ids of the items it overlaps with, ascending), longest overlap in words.

    Repeated rows and null ids stay and are judged alike; an empty table gives
    no rows, an empty benchmark flags nothing; other columns are not read.
    """
    found = kept_table(matches(df, items, id_col, text_col, **columns), "matches")
    flagged = found.groupBy(F.col("doc_id").alias("_flag_id"), F.col("text_key").alias("_flag_key")).agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("overlap").alias("longest")
    )
    rows = df.select(id_col, text_key(text_col).alias("_text_key"))
    return rows.join(flagged, _same_row(flagged, id_col, "_text_key"), "left").select(
        id_col, F.col("longest").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast(found.select(F.collect_set("item_id")).schema[0].dataType)).alias("items"),
        F.coalesce("longest", F.lit(0)).alias("longest"),
    )


def drop_contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The rows, with all their columns, that overlap with no item."""
    found = kept_table(matches(df, items, id_col, text_col, **columns), "matches")
    mark, flag_id, flag_key = (free_name(df, wish) for wish in ("text_key", "flag_id", "flag_key"))
    flagged = found.select(F.col("doc_id").alias(flag_id), F.col("text_key").alias(flag_key)).distinct()
    rows = df.withColumn(mark, text_key(text_col))
    return rows.join(flagged, _same_row(flagged, id_col, mark), "left_anti").drop(mark)

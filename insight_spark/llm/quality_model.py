"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal.

A text's words and runs of signs are hashed, alone and in adjacent pairs, into
a fixed number of weights. The model is learned from a bounded sample of
labelled texts, one after the other; scoring is a sparse dot product per text
where the text lies.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.llm.common import id_type, map_chunks, segment_sums, text_column

BITS = 18
# The training sample: at most so many labelled texts, the first ones by the hash of their id.
SAMPLE = 5000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.5, 1.0
PAIR = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    """``weights`` has 2**bits entries and the bias at its end."""

    weights: np.ndarray
    bits: int


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every word and pair of adjacent words, how many each text has, and its words.

    Texts come one after the other; the words of a text stand before its pairs.
    """
    marked = pc.replace_substring_regex(texts, r"([^\pL\pN\s]+)", r" \1 ")
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(marked))
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    hashed = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if not len(codes):
        return np.empty(0, np.int64), np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    word = hashed[codes]
    # An empty text splits into one empty word; it has none.
    blank = np.flatnonzero(pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False))
    if len(blank):
        real = codes != blank[0]
        counts = segment_sums(real, counts).astype(np.int64)
        word = word[real]
    shift = np.uint64(64 - bits)
    pairs = (word[:-1] * PAIR ^ word[1:]) * PAIR
    pairs[word[:-1] == word[1:]] = PAIR  # a doubled word is one feature, whichever word it is
    ends = np.cumsum(counts)
    inside = np.ones(max(len(word) - 1, 0), bool)
    inside[ends[(ends > 0) & (ends < len(word))] - 1] = False
    pair_counts = np.maximum(counts - 1, 0)
    buckets = np.empty(len(word) + int(pair_counts.sum()), np.int64)
    text_of = np.repeat(np.arange(len(counts)), counts)
    pair_before = np.concatenate(([0], np.cumsum(pair_counts)))[text_of]
    buckets[np.arange(len(word)) + pair_before] = ((word * PAIR) >> shift).astype(np.int64)
    pair_text = np.repeat(np.arange(len(counts)), pair_counts)
    buckets[np.arange(len(pair_text)) + ends[pair_text]] = (pairs[inside] >> shift).astype(np.int64)
    return buckets, counts + pair_counts, counts


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 per text; a text without a word gets the bias alone."""
    buckets, counts, _ = features(texts, model.bits)
    sums = segment_sums(model.weights[buckets], counts)
    return 1 / (1 + np.exp(-np.clip(model.weights[-1] + sums / np.sqrt(np.maximum(counts, 1)), -35, 35)))


class Ftrl:
    """Follow the regularised leader (proximal), one example at a time."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(values @ w, -35, 35)))
        g = (p - label) * values
        before = self.n[at]
        after = before + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
        self.n[at] = after


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """``examples``: distinct buckets, values, label; the bias is bucket ``2**bits``."""
    learner = Ftrl((1 << bits) + 1)
    for _ in range(epochs):
        for at, values, label in examples:
            learner.learn(at, values, label)
    return Model(learner.weights().astype(np.float32), bits)


def examples_of(texts: pa.Array, labels: list[int], bits: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    buckets, counts, _ = features(texts, bits)
    out = []
    for part, size, label in zip(np.split(buckets, np.cumsum(counts)[:-1]), counts, labels):
        at, times = np.unique(part, return_counts=True)
        out.append((
            np.append(at, 1 << bits).astype(np.int32),
            np.append(times / np.sqrt(max(size, 1)), 1.0).astype(np.float32), label,
        ))
    return out


def train(
    df: DataFrame,
    labels: DataFrame,
    keep: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    bits: int = BITS,
) -> Model:
    """Fit on a sample of at most ``sample`` labelled texts: those first by the hash of their id.

    ``keep`` restricts the ids that may be learned from. An id without a 0/1
    label, or with both, is not used; an id labelled twice alike counts once. A
    repeated id takes part once, by the text of the least features. Without a usable label every weight is
    zero and every score 0.5. Only the sample's ids are broadcast, and only its
    texts leave the scan.
    """
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if keep is not None:
        usable = usable.filter(keep)
    chosen = (
        usable.groupBy(id_col).agg(F.min(label_col).alias("_low"), F.max(label_col).alias("_label"))
        .filter("_low = _label")
        .select(id_col, F.col("_label").cast("int").alias("_label"), F.xxhash64(id_col).alias("_order"))
        .orderBy("_order", id_col).limit(sample)
    )
    texts = df.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    picked = texts.join(F.broadcast(chosen), id_col).select("_order", "_label", "_text")

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        found = examples_of(chunk.column(2), chunk.column(1).to_pylist(), bits)
        return pa.RecordBatch.from_arrays(
            [
                chunk.column(0), chunk.column(1),
                pa.array([at.tobytes() for at, _, _ in found], pa.binary()),
                pa.array([values.tobytes() for _, values, _ in found], pa.binary()),
            ],
            names=["_order", "_label", "at", "vals"],
        )

    hashed = map_chunks(picked, work, "_order bigint, _label int, at binary, vals binary")
    # One row per id, reduced in the tasks: an id that many rows bear sends no more than any other.
    single = hashed.groupBy("_order", "_label").agg(F.min(F.struct("at", "vals")).alias("_least")).select("_order", "_label", "_least.*")
    rows = single.orderBy("_order", "at", "vals").toLocalIterator()
    examples = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["vals"], np.float32), r["_label"]) for r in rows]
    return fit(examples, bits)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, score) per row, whole texts; score is the probability of label 1.

    Null and empty texts have no feature and get the bias alone. Rows are scored
    one by one: repeated rows and null ids stay, an empty table gives no rows,
    other columns are not read.
    """
    weights = df.sparkSession.sparkContext.broadcast(model)  # 4 * 2**bits bytes, whatever the data

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        found = scores(weights.value, text_column(chunk, text_col))
        return pa.RecordBatch.from_arrays([chunk.column(0), pa.array(found, pa.float64())], names=[id_col, "score"])

    return map_chunks(df.select(id_col, text_col), work, f"`{id_col}` {id_type(df, id_col)}, score double")


def keep_good(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose text scores ``threshold`` or more."""
    weights = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(chunk.column(place).cast(pa.string()), "")
        return chunk.filter(pa.array(scores(weights.value, texts) >= threshold))

    return map_chunks(df, work, fields)

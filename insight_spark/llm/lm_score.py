"""Cross-entropy difference: how much better a target model reads a text than a background model.

Both are word bigram models over one vocabulary, the words of the corpus that occur
``LEAST`` times and one class of all others, with the word's own probability as prior
and smoothed alike. Words are named by 32 bits of a hash, so a pair of words is one
number; counts are kept by pair in Spark tables that grow with the corpus. A pair that
occurs fewer than ``LEAST`` times says nothing beyond its words. A text's score is the
mean over its words of target loss less background loss; the lower, the closer it is
to the target.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.llm.common import chunks, free_name, id_type, kept_table, map_chunks, segment_sums, small_batches, text_column
from insight_spark.llm.decontaminate import _passes, build_filter
from insight_spark.operators.scale import lookup

# Names of the text's beginning, and of "any word" in rows that count single words and all words.
START, ANY = 0, 1
# Occurrences in all texts from which a word or a pair has numbers of its own.
LEAST = 10
# Weight of the word's own probability in counts, and what each word gets besides its count there.
PRIOR, ADDED = 20.0, 0.5
# Pairs (16 bytes each) and words (24 bytes) that are sent to the executors, the most frequent; what is
# beyond them meets its numbers in a join.
FREQUENT_PAIRS, FREQUENT_WORDS = 1 << 21, 1 << 20
# Pairs counted in a task before they are handed on.
HELD = 3 << 20


class Models(NamedTuple):
    """``pairs`` is (pair, n, target, background), ``words`` is (word, n, own_target, own_background, after_target,
    after_background): losses, to be added for a pair that is not listed. ``others`` are those of a word that is not."""

    pairs: DataFrame
    words: DataFrame
    others: tuple[float, float, float, float]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each text's words among them, and words per text.

    Words are runs of letters and digits or of signs, in lower case. A text
    without a word has none.
    """
    marked = pc.utf8_lower(pc.replace_substring_regex(texts, r"([^\pL\pN\pM\s]+)", r" \1 "))
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(marked))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:
        real = codes != blank
        counts, codes = segment_sums(real, counts).astype(np.int64), codes[real]
    return coded.dictionary, codes, counts


def word_names(words: pa.Array) -> np.ndarray:
    """32-bit names; two words of one name, of four thousand million, are one word of the vocabulary."""
    hashed = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.empty(0, np.uint64)
    return np.maximum((hashed >> np.uint64(32)).astype(np.int64), 2)


def text_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pair (word before, word) at every word, as one number, and words per text; the first word follows START."""
    distinct, codes, counts = split(texts)
    word = word_names(distinct)[codes] if len(codes) else np.empty(0, np.int64)
    before = np.concatenate(([START], word[:-1])) if len(word) else word
    before[(np.cumsum(counts) - counts)[counts > 0]] = START
    return (before.astype(np.uint64) << np.uint64(32)).view(np.int64) | word, counts


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[heads], *(np.add.reduceat(v[order], heads) if len(heads) else v for v in values)


def pair_counts(df: DataFrame, text_col: str, target_col: str) -> DataFrame:
    """(pair, target, background): occurrences in the target texts and in all; word w alone is the pair (ANY, w), all
    words together are (ANY, ANY)."""

    def run(batches):
        held, size = [], 0

        def batch():
            keys, target, background = _summed(*(np.concatenate([h[i] for h in held]) for i in range(3)))
            # Counts of a task fit 32 bits each; one number of two keeps the shuffle small.
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(target << 32 | background)], names=["pair", "counts"])

        for chunk in chunks(batches):
            pairs, counts = text_pairs(text_column(chunk, text_col))
            chosen = np.repeat(chunk.column(1).to_numpy(zero_copy_only=False).astype(np.int64), counts)
            for keys in (pairs, pairs & 0xFFFFFFFF | ANY << 32, np.full(len(pairs), ANY << 32 | ANY)):
                held.append(_summed(keys, chosen, np.ones(len(keys), np.int64)))
                size += len(held[-1][0])
            if size > HELD:
                held = [_summed(*(np.concatenate([h[i] for h in held]) for i in range(3)))]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield batch()
                    held, size = [], 0
        if size:
            yield batch()

    small_batches(df.sparkSession)
    partial = df.select(text_col, target_col).mapInArrow(run, "pair bigint, counts bigint")
    # Dealt out before it is added up: the tasks have added up theirs.
    return partial.repartition("pair").groupBy("pair").agg(
        F.sum(F.shiftrightunsigned("counts", 32)).alias("target"), F.sum(F.col("counts").bitwiseAND(0xFFFFFFFF)).alias("background")
    )


def train(df: DataFrame, is_target: Column, text_col: str = "text", least: int = LEAST) -> Models:
    """Both models from all texts; the target model from those where ``is_target`` holds (null: it doesn't).

    Nothing but totals comes to the driver.
    """
    mark = free_name(df, "target")
    marked = df.select(text_col, F.coalesce(is_target, F.lit(False)).alias(mark))
    single, word = F.shiftrightunsigned("pair", 32) == ANY, F.col("pair").bitwiseAND(0xFFFFFFFF)
    counted = kept_table(
        pair_counts(marked, text_col, mark).filter((F.col("background") >= least) | (single & (word == ANY))), "pairs", codec="zstd"
    )
    own = counted.filter(single & (word != ANY)).select(word.alias("word"), "target", "background")
    listed = counted.filter(~single).select(
        "pair", F.shiftrightunsigned("pair", 32).alias("before"), word.alias("word"), "target", "background"
    )
    every = counted.filter(single & (word == ANY)).select("target", "background").first() or (0, 0)
    n_words, *known = own.agg(F.count("*"), F.sum("target"), F.sum("background")).first()
    totals = [n + ADDED * (n_words + 1) for n in every]
    rare = [(n - (k or 0) + ADDED) / total for n, k, total in zip(every, known, totals)]
    after = listed.groupBy(F.col("before").alias("word")).agg(
        F.sum("target").alias("follow_target"), F.sum("background").alias("follow_background")
    )

    def own_loss(count: str, total: float) -> Column:
        return -F.log((F.coalesce(count, F.lit(0)) + ADDED) * (PRIOR / total))

    def after_loss(count: str) -> Column:
        return F.log(F.coalesce(count, F.lit(0)) + PRIOR)

    words = kept_table(
        own.join(after, "word", "full").select(
            "word", F.coalesce("background", "follow_background").alias("n"),
            own_loss("target", totals[0]).alias("own_target"), own_loss("background", totals[1]).alias("own_background"),
            after_loss("follow_target").alias("after_target"), after_loss("follow_background").alias("after_background"),
        ),
        "words",
    )
    owns = words.select("word", "own_target", "own_background")
    follows = words.select(F.col("word").alias("before"), "after_target", "after_background")
    joined = lookup(kept_table(lookup(listed, owns, "word"), "own-losses"), follows, "before")

    def pair_loss(side: str) -> Column:
        return F.col(f"after_{side}") - F.log(F.col(side) + F.exp(-F.col(f"own_{side}")))

    pairs = kept_table(
        joined.select("pair", F.col("background").alias("n"), pair_loss("target").alias("target"), pair_loss("background").alias("background")),
        "pair-losses",
    )
    base = float(np.log(PRIOR))
    return Models(pairs, words, (*(float(-np.log(PRIOR * share)) for share in rare), base, base))


def frequent(table: DataFrame, most: int) -> Column:
    """Which rows of ``table`` are among the at most ``most`` with the greatest ``n``; equal sizes stay together."""
    level = F.floor(8 * F.log2("n")).cast("int")
    least, held = 1 << 30, 0
    for number, rows in sorted(table.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 8 x 64
        if held + rows > most:
            break
        least, held = number, held + rows
    return level >= least


def score(
    df: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text",
    most_pairs: int = FREQUENT_PAIRS, most_words: int = FREQUENT_WORDS,
) -> DataFrame:
    """(``id_col``, n_tokens, target_loss, background_loss, score) per row, whole texts.

    Losses are means per word, score is target_loss - background_loss; a null
    text and one without a word have no word and 0 everywhere. Repeated rows and
    null ids stay, an empty table gives no rows, other columns are not read.

    The most frequent pairs and words are sent to the executors, and filters of fixed
    size over the others; only words that these cannot judge meet the tables.
    """
    spark = df.sparkSession
    common = frequent(models.pairs, most_pairs)
    sent = models.pairs.filter(common).select("pair", "target", "background").toArrow().sort_by("pair")
    usual = frequent(models.words, most_words)
    known = models.words.filter(usual).drop("n").toArrow().sort_by("word")
    rest = models.pairs.filter(~common)
    bits = build_filter(rest.select(F.col("pair").alias("key")))
    word_bits = build_filter(models.words.filter(~usual).select(F.col("word").alias("key")))
    others = np.array(models.others)
    shared = spark.sparkContext.broadcast((
        sent["pair"].to_numpy(), np.stack([sent[c].to_numpy() for c in ("target", "background")], 1).astype(np.float32),
        known["word"].to_numpy(), np.stack([known[c].to_numpy() for c in known.column_names[1:]], 1).astype(np.float32), bits, word_bits,
    ))

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        pair_keys, pair_losses, word_keys, word_losses, pair_bits, word_bits = shared.value
        pairs, counts = text_pairs(text_column(chunk, "text"))
        distinct, inverse = np.unique(pairs, return_inverse=True)
        at, listed = _found(pair_keys, distinct)
        plain = ~listed
        plain[_passes(distinct.view(np.uint64), pair_bits)] = False
        losses = np.zeros((len(distinct), 2))
        for name, side in ((distinct & 0xFFFFFFFF, slice(0, 2)), (distinct >> 32 & 0xFFFFFFFF, slice(2, 4))):
            word, word_known = _found(word_keys, name)
            losses += np.where(word_known[:, None], word_losses[word][:, side], others[side]) if len(word_keys) else others[side]
            elsewhere = np.zeros(len(name), bool)
            elsewhere[_passes(name.view(np.uint64), word_bits)] = True
            plain &= word_known | ~elsewhere
        losses[~plain] = 0
        losses[listed] = pair_losses[at[listed]]
        is_open = ~(listed | plain)
        sums = [pa.array(segment_sums(losses[inverse, side], counts)) for side in (0, 1)]
        owner = np.repeat(np.arange(len(counts)), counts)[is_open[inverse]]
        key, times = np.unique(owner * max(len(distinct), 1) + inverse[is_open[inverse]], return_counts=True)
        per_row = np.bincount(key // max(len(distinct), 1), minlength=len(counts))
        offsets = pa.array(np.concatenate(([0], np.cumsum(per_row))).astype(np.int32))
        listed_of = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values))
        return pa.RecordBatch.from_arrays(
            [chunk.column(0), pa.array(counts), *sums, listed_of(distinct[key % max(len(distinct), 1)]), listed_of(times)],
            names=["id", "n_tokens", "target", "background", "open", "times"],
        )

    rows = map_chunks(
        df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), work,
        f"id {id_type(df, id_col)}, n_tokens bigint, target double, background double, open array<bigint>, times array<bigint>",
    )
    scored = kept_table(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    links = scored.select("row", F.explode(F.arrays_zip("open", "times")).alias("link")).select(
        "row", F.col("link.open").alias("pair"), F.col("link.times").alias("times")
    )
    asked = kept_table(links.select("pair").distinct().join(rest.drop("n"), "pair", "left").select(
        "pair", F.col("pair").bitwiseAND(0xFFFFFFFF).alias("word"), F.shiftrightunsigned("pair", 32).alias("before"), "target", "background"
    ), "open-pairs")
    owns = models.words.select("word", "own_target", "own_background")
    follows = models.words.select(F.col("word").alias("before"), "after_target", "after_background")
    judged = lookup(kept_table(lookup(asked, owns, "word"), "open-words"), follows, "before")

    def loss(side: str, own: float, after: float) -> Column:
        return F.coalesce(side, F.coalesce(f"own_{side}", F.lit(own)) + F.coalesce(f"after_{side}", F.lit(after))).alias(side)

    own_t, own_b, after_t, after_b = models.others
    judged = judged.select("pair", loss("target", own_t, after_t), loss("background", own_b, after_b))
    late = links.join(judged, "pair").groupBy("row").agg(
        F.sum(F.col("target") * F.col("times")).alias("late_target"), F.sum(F.col("background") * F.col("times")).alias("late_background")
    )
    per_word = F.greatest("n_tokens", F.lit(1))
    means = [((F.col(side) + F.coalesce(f"late_{side}", F.lit(0.0))) / per_word).alias(f"{side}_loss") for side in ("target", "background")]
    return scored.join(late, "row", "left").select(F.col("id").alias(id_col), "n_tokens", *means).withColumn(
        "score", F.col("target_loss") - F.col("background_loss")
    )


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def mark_target(df: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", flag: str = "_target") -> DataFrame:
    """``df`` with a boolean ``flag``, a new column: the id is in ``target_ids``.

    The ids may be as many as the documents, so both sides are always dealt out
    by id and never broadcast: the plan is the same at every size.
    """
    if flag in df.columns:
        raise ValueError(f"column {flag} exists")
    mark = free_name(df, "target_id")
    ids = target_ids.select(F.col(id_col).alias(mark)).distinct()
    return df.join(ids.hint("merge"), F.col(f"`{id_col}`") == F.col(mark), "left").withColumn(flag, F.col(mark).isNotNull()).drop(mark)

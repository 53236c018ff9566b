"""Stored posting blocks: built once, searched by BM25 without reading a text again.

The documents of a scope (a conversation, say) are dealt into shards of a few thousand.
A block holds the postings of one word in one shard and the greatest score that any of
them gives, so the blocks of a question's words bound what a shard can score. A question
meets the shards of the greatest bounds first; of the others only those whose bound
reaches its k-th score so far. All postings of a document lie in one shard, so every
score is whole where it is made.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from insight_spark.functions import fixed_values as fv
from insight_spark.functions.text import tokenize_words
from insight_spark.operators.scale import BLOCK_CELLS, keep_best, kept, merge_best, top_n_per_group

# Documents and words of a shard, about.
SHARD_DOCS = 4096
SHARD_WORDS = 4_000_000
LEAST_DOCS = 256
# Questions that meet a shard in one task, about.
QUERY_ROWS = 16_384
# Shards that a question meets before bounds are compared.
FIRST_SHARDS = 8
# Scores are rounded to six digits.
SLACK = 1e-6
# The scope of an index without scopes.
ALL = "all"


class PostingIndex:
    """An index in ``path``: blocks (scope, shard, term, docs, tfs, lengths, n, peak) and sizes (scope, documents, length).

    ``peak`` is the greatest BM25 part of the block's postings at the mean length ``mean``
    of the scope when the block was written.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str):
        self.spark, self.path, self.id_type = spark, path, id_type

    def blocks(self) -> DataFrame:
        kind = f"shard string, term string, docs array<{self.id_type}>, tfs array<int>, lengths array<int>, n bigint, peak double, mean double, scope string"
        return self.spark.read.schema(kind).parquet(f"{self.path}/blocks")

    def sizes(self) -> DataFrame:
        """(scope, documents, length) over all additions."""
        stored = self.spark.read.schema("documents bigint, length bigint, scope string").parquet(f"{self.path}/sizes")
        return stored.groupBy("scope").agg(F.sum("documents").alias("documents"), F.sum("length").alias("length"))

    def scoped_frequency(self) -> DataFrame:
        return self.blocks().groupBy("scope", "term").agg(F.sum("n").alias("df"))

    def frequency(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df) over all scopes, of all words or of those in ``terms`` (term)."""
        blocks = self.blocks().select("term", "n")
        wanted = blocks if terms is None else blocks.join(terms, "term", "left_semi")
        return wanted.groupBy("term").agg(F.sum("n").alias("df"))

    def documents(self) -> int:
        return self.sizes().agg(F.sum("documents")).first()[0] or 0

    def add(
        self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: str | None = None,
        tokens: Callable = tokenize_words, replace: bool = False, stored: str | None = None,
    ) -> None:
        """Index documents; with ``replace`` the scopes that occur in them are written anew.

        A document without a word counts in the statistics. Ids must not repeat within a scope. ``stored`` names
        the column of a written table that has the words already; the texts are not read then.
        """
        in_scope = F.col(scope).cast("string") if scope else F.lit(ALL)
        found = F.col(stored) if stored else tokens(F.col(text))
        words = docs.select(in_scope.alias("scope"), F.col(doc_id).alias("doc"), F.coalesce(found, F.array().cast("array<string>")).alias("tokens"))
        # Words of letters travel as one text; those of another tokeniser may hold blanks.
        held = F.array_join("tokens", " ") if tokens is tokenize_words else F.col("tokens")
        words = words.select("scope", "doc", held.alias("tokens"), F.size("tokens").alias("length"))
        words = words if stored else kept(words, "tokens")
        sizes = kept(words.groupBy("scope").agg(F.count("*").alias("documents"), F.sum("length").alias("length")), "sizes")
        cores = self.spark.sparkContext.defaultParallelism
        shards = F.greatest(
            F.ceil(F.col("documents") / SHARD_DOCS), F.ceil(F.col("total") / SHARD_WORDS),
            F.least(F.lit(cores), F.floor(F.col("documents") / LEAST_DOCS)), F.lit(1),
        )
        shape = sizes.select("scope", "documents", F.col("length").alias("total")).select(
            "scope", shards.cast("int").alias("shards"), (F.col("total") / F.col("documents")).alias("mean")
        )
        # Tasks by the number of shards: the bytes they are made of would give few of them.
        few = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores)
        parts = max(1, min(shape.agg(F.sum("shards")).first()[0] or 1, few))
        batch = uuid.uuid4().hex[:8]
        placed = words.join(shape, "scope").select(
            "scope", "doc", "tokens", "mean",
            F.concat(F.lit(f"{batch}-"), F.pmod(F.xxhash64("doc"), "shards").cast("string")).alias("shard"),
        )
        kind = f"scope string, shard string, term string, docs array<{self.id_type}>, tfs array<int>, lengths array<int>, n bigint, peak double, mean double"
        made = placed.repartition(parts, "scope", "shard").groupBy("scope", "shard").applyInArrow(_shard_blocks, kind)
        for frame, name in ((made, "blocks"), (sizes, "sizes")):
            if not scope and not replace:  # one folder: its rows need not be sorted by scope
                frame.drop("scope").write.mode("append").parquet(f"{self.path}/{name}/scope={ALL}")
                continue
            (
                frame.write.mode("overwrite" if replace else "append").option("partitionOverwriteMode", "dynamic")
                .partitionBy("scope").parquet(f"{self.path}/{name}")
            )

    def delete(self, scope: str) -> bool:
        """Remove what one scope has in the index."""
        jvm = self.spark.sparkContext._jvm
        folder = f"scope={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(scope)}"
        gone = []
        for name in ("blocks", "sizes"):
            place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{folder}")
            gone.append(place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True))
        return any(gone)

    # --- Search -------------------------------------------------------------

    def search(
        self, queries: DataFrame, query_id: str = "query_id", text: str = "text", doc_id: str = "doc_id",
        k: int = fv.CANDIDATES, scope: str | None = None, tokens: Callable = tokenize_words,
    ) -> DataFrame:
        """(query, doc, score, rank): the best ``k`` documents of its scope per query."""
        words = kept(self._asked(queries, query_id, text, scope, tokens), "questions")
        # The index is read once; what follows reads the blocks of the questions' words.
        blocks = kept(self.blocks().join(words.select("scope", "term").distinct(), ["scope", "term"], "left_semi"), "wanted")
        asked = kept(self._weights(words, blocks), "asked")
        shards = kept(blocks.select("scope", "shard").distinct(), "shards")
        most = shards.groupBy("scope").count().agg(F.max("count")).first()[0] or 0
        query_type = queries.schema[query_id].dataType.simpleString()
        if most <= FIRST_SHARDS:
            found = self._scores(asked, asked.select("query", "scope").distinct().join(shards, "scope"), query_type, k, blocks)
        else:
            pairs = kept(self.bounds(asked, blocks), "bounds")
            near = kept(top_n_per_group(pairs, ["query"], [F.desc("bound"), F.col("shard")], FIRST_SHARDS).drop("rank", "bound"), "first-shards")
            first = kept(
                top_n_per_group(self._scores(asked, near, query_type, k, blocks), ["query"], [F.desc("score"), F.col("doc")], k).drop("rank"),
                "first-hits",
            )
            rest = further_shards(pairs, near, first, k)
            found = first.unionByName(self._scores(asked, rest.drop("bound"), query_type, k, blocks))
        ranked = top_n_per_group(found, ["query"], [F.desc("score"), F.col("doc")], k)
        return ranked.select(F.col("query").alias(query_id), F.col("doc").alias(doc_id), "score", "rank")

    def weights(self, queries: DataFrame, query_id: str, text: str, scope: str | None, tokens: Callable) -> DataFrame:
        """(query, scope, term, weight, mean): Okapi weights; a word in more than half of the documents gets a
        quarter of the mean IDF of its scope."""
        return self._weights(self._asked(queries, query_id, text, scope, tokens), self.blocks())

    def _asked(self, queries: DataFrame, query_id: str, text: str, scope: str | None, tokens: Callable) -> DataFrame:
        """(query, scope, term, times): the words of the questions."""
        return (
            queries.select(
                F.col(query_id).alias("query"), (F.col(scope).cast("string") if scope else F.lit(ALL)).alias("scope"),
                F.explode(tokens(F.col(text))).alias("term"),
            )
            .groupBy("query", "scope", "term").agg(F.count("*").alias("times"))
        )

    def _weights(self, asked: DataFrame, blocks: DataFrame) -> DataFrame:
        """:meth:`weights` of the words of :meth:`_asked`; the whole vocabulary is read only where one of them is in
        more than half of the documents of its scope."""
        found = kept(asked.join(self._idf(blocks.groupBy("scope", "term").agg(F.sum("n").alias("df"))), ["scope", "term"]), "idf")
        common = found.filter("raw < 0").select("scope").distinct()
        weight = F.col("raw")
        if not common.isEmpty():
            every = self._idf(self.scoped_frequency().join(common, "scope", "left_semi"))
            found = found.join(every.groupBy("scope").agg((F.avg("raw") * 0.25).alias("floor")), "scope", "left")
            weight = F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw"))
        return found.select("query", "scope", "term", (weight * F.col("times")).alias("weight"), "mean")

    def _idf(self, frequency: DataFrame) -> DataFrame:
        """(scope, term, mean, raw) of a frequency per scope and word."""
        return frequency.join(self.sizes(), "scope").select(
            "scope", "term", (F.col("length") / F.col("documents")).alias("mean"),
            (F.log(F.col("documents") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"),
        )

    def bounds(self, asked: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        """(query, scope, shard, bound): no document of the shard scores more; shards without a word of the query are left out.

        A block written at another mean length gives at most ``new mean / old mean`` times its peak.
        """
        peaks = (blocks or self.blocks()).select("scope", "shard", "term", "peak", F.col("mean").alias("then"))
        grown = F.greatest(F.lit(1.0), F.col("mean") / F.col("then"))
        part = F.greatest(F.col("weight"), F.lit(0.0)) * F.col("peak") * grown
        return asked.join(peaks, ["scope", "term"]).groupBy("query", "scope", "shard").agg(F.sum(part).alias("bound"))

    def _scores(self, asked: DataFrame, pairs: DataFrame, query_type: str, k: int, blocks: DataFrame | None = None) -> DataFrame:
        """(query, doc, score): the best ``k`` of each shard for the queries that meet it; ``blocks`` are the index's or
        those of the asked words."""
        shape = kept(
            pairs.groupBy("scope", "shard").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("slices")), "shape"
        )
        wanted = asked.select("scope", "term").distinct()
        placed = (blocks or self.blocks()).select("scope", "shard", "term", "docs", "tfs", "lengths").join(shape, ["scope", "shard"])
        left = placed.join(wanted, ["scope", "term"], "left_semi").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        right = (
            pairs.join(shape, ["scope", "shard"]).withColumn("slice", F.pmod(F.xxhash64("query"), "slices").cast("int"))
            .select("scope", "shard", "slice", "query").join(asked, ["query", "scope"])
        )
        group = ["scope", "shard", "slice"]

        def score(known: pa.Table, terms: pa.Table) -> pa.Table:
            found = block_scores(known, terms, k)
            return pa.table({
                "query": terms["query"].take(pa.array(found[0])) if len(found[0]) else terms["query"].slice(0, 0),
                "doc": pa.array(found[1].tolist(), known["docs"].type.value_type), "score": pa.array(found[2], pa.float64()),
            })

        return (
            left.select(*group, "term", "docs", "tfs", "lengths").groupBy(*group)
            .cogroup(right.select(*group, "query", "term", "weight", "mean").groupBy(*group))
            .applyInArrow(score, f"query {query_type}, doc {self.id_type}, score double")
        )


def further_shards(pairs: DataFrame, met: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The (query, scope, shard, bound) not met yet whose bound reaches the query's k-th score so far."""
    least = hits.groupBy("query").agg(F.count("*").alias("hits"), F.min("score").alias("least"))
    rest = pairs.join(met, ["query", "scope", "shard"], "left_anti").join(least, "query", "left")
    reaches = F.coalesce("hits", F.lit(0)) < k
    return rest.filter(reaches | (F.col("bound") * (1 + SLACK) + SLACK >= F.col("least"))).drop("hits", "least")


def _shard_blocks(table: pa.Table) -> pa.Table:
    """The posting blocks of one shard."""
    tokens = table["tokens"].combine_chunks()
    if not pa.types.is_list(tokens.type):  # one text of words
        tokens = pc.split_pattern(pc.if_else(pc.equal(tokens, ""), None, tokens), " ")
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    rows = table.num_rows
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * rows + np.repeat(np.arange(rows), sizes)
    key, tf = np.unique(key, return_counts=True)
    term, doc = key // rows, key % rows
    mean = table["mean"][0].as_py() if rows else 1.0
    part = bm25_part(tf, sizes[doc], mean)
    heads = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.empty(0, np.int64)
    offsets = pa.array(np.append(heads, len(term)).astype(np.int32))
    listed = lambda values: pa.ListArray.from_arrays(offsets, values)
    count = len(heads)
    same = lambda name: pa.array([table[name][0].as_py()] * count if rows else [], pa.string())
    return pa.table({
        "scope": same("scope"), "shard": same("shard"), "term": coded.dictionary.take(pa.array(term[heads])),
        "docs": listed(table["doc"].combine_chunks().take(pa.array(doc))), "tfs": listed(pa.array(tf.astype(np.int32))),
        "lengths": listed(pa.array(sizes[doc].astype(np.int32))), "n": pa.array(np.diff(np.append(heads, len(term))).astype(np.int64)),
        "peak": pa.array(np.maximum.reduceat(part, heads) if count else np.empty(0)), "mean": pa.array(np.full(count, mean)),
    })


def bm25_part(tf: np.ndarray, length: np.ndarray, mean: float | np.ndarray) -> np.ndarray:
    """What a word adds to the score, before its weight; grows with the mean length."""
    return tf * (fv.BM25_K1 + 1) / (tf + fv.BM25_K1 * (1 - fv.BM25_B + fv.BM25_B * length / np.maximum(mean, 1e-9)))


def block_scores(known: pa.Table, asked: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query in ``asked``, document, score): the best ``k`` documents of a shard per query."""
    nothing = np.empty(0, np.int64), np.empty(0, object), np.empty(0)
    if not known.num_rows or not asked.num_rows:
        return nothing
    place = pc.index_in(asked["term"].combine_chunks(), value_set=known["term"].combine_chunks())
    rows = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
    block = pc.drop_null(place).to_numpy(zero_copy_only=False)
    lists = known["docs"].combine_chunks()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(counts) - counts
    docs = lists.flatten().dictionary_encode()
    doc, names = docs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.array(docs.dictionary.to_pylist())
    tf = known["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    mean = asked["mean"][0].as_py()
    part = bm25_part(tf, known["lengths"].combine_chunks().flatten().to_numpy(zero_copy_only=False), mean)
    query = asked["query"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[rows]
    weight = asked["weight"].to_numpy()[rows]
    order = np.argsort(query, kind="stable")
    rows, block, query, weight = rows[order], block[order], query[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.empty(0, np.int64)
    size = counts[block]
    # As many whole queries at once as make a block of cells.
    work = np.add.reduceat(size, first) if len(first) else np.empty(0, np.int64)
    batch = (np.cumsum(work) - work) // BLOCK_CELLS
    best = None
    for number in np.unique(batch):
        some = np.flatnonzero(batch == number)
        low, high = first[some[0]], first[some[-1] + 1] if some[-1] + 1 < len(first) else len(query)
        reps = size[low:high]
        ends = np.cumsum(reps)
        entry = np.repeat(starts[block[low:high]] - (ends - reps), reps) + np.arange(int(ends[-1]))
        cell = np.repeat(query[low:high].astype(np.int64), reps) * len(names) + doc[entry]
        cell, at = np.unique(cell, return_inverse=True)
        sums = np.round(np.bincount(at, np.repeat(weight[low:high], reps) * part[entry], len(cell)), 6)
        found = keep_best(cell // len(names), names[cell % len(names)], sums, k)
        best = found if best is None else merge_best([best, found], k)
    if best is None:
        return nothing
    row_of = np.zeros(int(query.max()) + 1, np.int64)
    row_of[query[first]] = rows[first]
    return row_of[best[0]], best[1], best[2]

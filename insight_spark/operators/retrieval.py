"""Document retrieval: chunks, vocabulary, BM25, vectors, fusion, guard."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from insight_spark.functions import fixed_values as fv
from insight_spark.functions.text import name_tokens, preview_text, tokenize_words
from insight_spark.operators import nearest
from insight_spark.operators.postings import PostingIndex
from insight_spark.operators.scale import join_null_safe, kept, small_batches, top_n_per_group
from insight_spark.session import fresh_path

PROSE_SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
TABLE_SEPARATORS = ["\n\n", "\n"]
# Characters of chunks that are handed on together.
CHUNK_CHARACTERS = 1 << 20
# What ``str.strip`` takes off; there is no white space beyond U+3000.
SPACES = "".join(filter(str.isspace, map(chr, range(0x3001))))


# --- Chunks -----------------------------------------------------------------

def _pieces(blocks: Iterable[str], separator: str) -> Iterator[str]:
    """Cut a text that comes in blocks before every separator, which stays at the front of its piece."""
    pattern, held, at = re.compile(re.escape(separator)), "", 0
    for block in blocks:
        if not separator:
            yield from block
            continue
        held += block
        start = end = 0
        for match in pattern.finditer(held, at):
            if match.start() > start:
                yield held[start : match.start()]
            start, end = match.span()
        # The last piece may go on in the next block; what was searched of it is not searched again.
        at = max(at, end, len(held) - len(separator) + 1) - start
        held = held[start:]
    if held:
        yield held


class _Packer:
    """Joins neighbouring pieces up to ``size``; the tail of one chunk, at most ``overlap`` long, opens the next."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, overlap
        self.window: deque[str] = deque()
        self.length = 0

    def _chunk(self) -> Iterator[str]:
        chunk = "".join(self.window).strip()
        if chunk:
            yield chunk

    def add(self, piece: str) -> Iterator[str]:
        if self.window and self.length + len(piece) > self.size:
            yield from self._chunk()
            while self.window and (self.length > self.overlap or self.length + len(piece) > self.size):
                self.length -= len(self.window.popleft())
        self.window.append(piece)
        self.length += len(piece)

    def end(self) -> Iterator[str]:
        yield from self._chunk()
        self.window.clear()
        self.length = 0


def split_blocks(blocks: Iterable[str], size: int, overlap: int, separators: list[str]) -> Iterator[str]:
    """Chunks, one by one, of a text that comes in blocks. The first of ``separators`` must be the coarsest that
    occurs in it; finer ones are used only inside pieces that are still too long."""
    packer = _Packer(size, overlap)
    finer = separators[1:]
    for piece in _pieces(blocks, separators[0]):
        if len(piece) < size:
            yield from packer.add(piece)
            continue
        yield from packer.end()
        if finer:
            yield from _chunks_of(piece, size, overlap, finer)
        else:
            yield piece
    yield from packer.end()


def split_text(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Chunks of one text: the coarsest separator that occurs, finer ones only inside pieces that are still too long."""
    return list(_chunks_of(text, size, overlap, separators))


def _chunks_of(text: str, size: int, overlap: int, separators: list[str]) -> Iterator[str]:
    present = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    return split_blocks([text], size, overlap, separators[present:])


def split_recursive(
    df: DataFrame,
    text: str = "text",
    size: int = fv.PROSE_CHUNK,
    overlap: int = fv.PROSE_OVERLAP,
    separators: list[str] | None = None,
) -> DataFrame:
    """One row per chunk: the input columns, ``chunk_no`` from 0 and ``chunk``.

    A text shorter than ``size`` is one chunk whatever its separators; only longer ones go to Python.
    """
    cuts = PROSE_SEPARATORS if separators is None else separators
    small_batches(df.sparkSession)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def chunks(texts: pa.Array) -> pa.Array:
        return pa.array([split_text(t, size, overlap, cuts) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    whole = F.col(text)
    short, bare = F.length(whole) < size, F.btrim(whole, F.lit(SPACES))
    found = F.when(short, F.when(bare != "", F.array(bare))).otherwise(chunks(F.when(~short, whole)))
    others = [name for name in df.columns if name != text]
    return df.select(*others, F.posexplode(found).alias("chunk_no", "chunk"))


def split_lines(
    lines: DataFrame, size: int = fv.PROSE_CHUNK, overlap: int = fv.PROSE_OVERLAP, separators: list[str] | None = None
) -> DataFrame:
    """:func:`split_recursive` of files that come as lines (see ``files.text_lines``): (path, chunk_no, chunk).

    A file is read in order and never held as a whole; at most its longest piece of the
    coarsest separator is. A separator is line breaks only or has none.
    """
    cuts = PROSE_SEPARATORS if separators is None else separators
    small_batches(lines.sparkSession)
    empty = (F.col("line") == "").cast("long")
    total = F.sum(F.col("bytes") + 1)  # as if the last line ended
    order = F.struct("block", "place")
    files = lines.groupBy("path").agg(
        (total <= F.max("size")).alias("_fits"), (total == F.max("size") - 2).alias("_cut"), (total < F.max("size")).alias("marked"),
        (F.count("*") > 1).alias("_many"), (F.sum(empty) > F.min_by(empty, order)).alias("_blank"),
        *[F.bool_or(F.contains("line", F.lit(s))).alias(f"_has_{i}") for i, s in enumerate(cuts)],
    )
    closed = F.col("_fits") & ~F.col("_cut")
    has = {"\n\n": F.col("_blank"), "\n": F.col("_many") | closed, "": F.lit(True)}
    level = F.coalesce(*[F.when(has.get(s, F.col(f"_has_{i}")), i) for i, s in enumerate(cuts)], F.lit(len(cuts) - 1))
    # A byte order mark, which the reader of lines takes off, belongs to the text.
    files = files.select("path", level.alias("level"), closed.alias("closed"), "marked")
    ordered = lines.join(files, "path").repartition("path").sortWithinPartitions("path", "block", "place")

    def text(first: tuple, rest: Iterable[tuple]) -> Iterator[str]:
        yield "\ufeff" * first[4] + first[1]
        for row in rest:
            yield "\n" + row[1]
        if first[3]:
            yield "\n"

    def run(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5))))
        held: list[tuple] = []
        letters = 0
        for path, own in groupby(rows, lambda row: row[0]):
            first = next(own)
            for number, chunk in enumerate(split_blocks(text(first, own), size, overlap, cuts[first[2] :])):
                held.append((path, number, chunk))
                letters += len(chunk)
                if letters >= CHUNK_CHARACTERS:
                    yield _chunk_batch(held)
                    held, letters = [], 0
        if held:
            yield _chunk_batch(held)

    return ordered.select("path", "line", "level", "closed", "marked").mapInArrow(run, "path string, chunk_no int, chunk string")


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "chunk_no", "chunk"])


def split_structured(df: DataFrame, text: str = "text") -> DataFrame:
    return split_recursive(df, text, fv.TABLE_CHUNK, fv.TABLE_OVERLAP, TABLE_SEPARATORS)


def tag_source(
    df: DataFrame, source_type: str, source: Column, columns: list[str] | None = None
) -> DataFrame:
    """Mark chunks with where they come from and, for tables, the column names."""
    names = F.array(*[F.lit(name) for name in columns or []]).cast("array<string>")
    return df.withColumns(
        {"source_type": F.lit(source_type), "source": source, "columns": names}
    )


def cap_chunks(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """First ``cap`` chunks of every conversation, numbered."""
    return top_n_per_group(df, keys, [F.col(c) for c in order], cap, "chunk_rank", salt_on=order)


def embed_text(df: DataFrame, text: str = "text", width: int = 256, embedder=None) -> DataFrame:
    """Add a unit-length ``embedding``; ``embedder`` is any Column -> Column function.

    The default hashes words into ``width`` buckets weighted by IDF; it stands in
    for a neural model and is not comparable to one.
    """
    if embedder is not None:
        return df.withColumn("embedding", embedder(F.col(text)))
    return embed_with(df, embedding_weights(df, text, width), text)


def hashed_words(df: DataFrame, text: str = "text", width: int = 256) -> DataFrame:
    """Add the words of the text (``_words``) and their counts in ``width`` buckets (``_tf``), unless they are there."""
    from pyspark.ml.feature import HashingTF

    if "_tf" in df.columns:
        return df
    words = F.coalesce(tokenize_words(F.col(text)), F.array().cast("array<string>"))
    return HashingTF(numFeatures=width, inputCol="_words", outputCol="_tf").transform(df.withColumn("_words", words))


def embedding_weights(df: DataFrame, text: str = "text", width: int = 256) -> list[float]:
    """The IDF weight of each of ``width`` buckets of hashed words."""
    from pyspark.ml.feature import IDF

    return IDF(inputCol="_tf", outputCol="_idf").fit(hashed_words(df, text, width).select("_tf")).idf.toArray().tolist()


def embed_with(df: DataFrame, weights: list[float], text: str = "text") -> DataFrame:
    """:func:`embed_text` with given weights; a table of :func:`hashed_words` is not tokenised again."""
    from pyspark.ml.feature import ElementwiseProduct, Normalizer
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    product = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="_tf", outputCol="_idf")
    weighted = product.transform(hashed_words(df, text, len(weights)))
    unit = Normalizer(inputCol="_idf", outputCol="_unit").transform(weighted)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_idf", "_unit")


# --- Vocabulary and postings ------------------------------------------------

def term_counts(df: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """Frequency of every word, per source type (or other ``by`` columns)."""
    by = by or []
    return (
        df.select(*by, F.explode(tokenize_words(F.col(text))).alias("term"))
        .groupBy(*by, "term")
        .agg(F.count("*").alias("n"))
    )


def source_vocabulary(
    chunks: DataFrame, keys: list[str], text: str = "text", columns: str | None = "columns"
) -> DataFrame:
    """(keys, term, vocabulary): csv, document or overlap.

    A term of both source types is overlap unless a column name contains it;
    such pinned terms stay with csv and may be document terms as well.
    """
    words = chunks.select(
        *keys, "source_type", F.explode(F.array_distinct(tokenize_words(F.col(text)))).alias("term")
    )
    if columns:
        pinned = (
            chunks.filter(F.col("source_type") == "csv")
            .select(*keys, F.explode(columns).alias("_name"))
            .distinct()
            .select(*keys, F.lit("pinned").alias("source_type"), F.explode(name_tokens(F.col("_name"))).alias("term"))
        )
        words = words.unionByName(pinned)
    sides = words.groupBy(*keys, "term").agg(
        F.bool_or(F.col("source_type").isin("csv", "pinned")).alias("in_csv"),
        F.bool_or(F.col("source_type") == "document").alias("in_doc"),
        F.bool_or(F.col("source_type") == "pinned").alias("is_pinned"),
    )
    overlap = F.col("in_csv") & F.col("in_doc") & ~F.col("is_pinned")
    labels = F.when(overlap, F.array(F.lit("overlap"))).otherwise(
        F.array_compact(
            F.array(F.when(F.col("in_csv"), F.lit("csv")), F.when(F.col("in_doc"), F.lit("document")))
        )
    )
    return sides.select(*keys, "term", F.explode(labels).alias("vocabulary"))


def build_postings(
    docs: DataFrame, doc_id: str, text: str = "text", tokens: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings: doc, term, tf, dl), (document frequency per term), (length per doc).

    A text is tokenised once and its words are counted where it is read; the three tables come from what that
    pass wrote. Texts of one id are one document; a posting stands once for each of their lengths.
    """
    small_batches(docs.sparkSession)
    words = docs.select(doc_id, (tokenize_words(F.col(text)) if tokens is None else tokens).alias("tokens"))
    kind = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, term string, tf bigint, dl bigint"
    counted = kept(words.mapInArrow(_word_counts, kind), "word-counts")
    lengths = counted.filter(F.col("term").isNull()).select(doc_id, "dl")
    postings = counted.filter(F.col("term").isNotNull())
    if lengths.groupBy(doc_id).count().filter("count > 1").isEmpty():
        return postings, postings.groupBy("term").agg(F.count("*").alias("df")), lengths
    merged = kept(postings.groupBy(doc_id, "term").agg(F.sum("tf").alias("tf")), "postings")
    return (
        join_null_safe(merged, lengths, [doc_id]).select(doc_id, "term", "tf", "dl"),
        merged.groupBy("term").agg(F.count("*").alias("df")), lengths,
    )


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per word of a text with its count, and one without a word for the text itself."""
    for batch in batches:
        tokens, rows = batch.column(1), batch.num_rows
        sizes = pc.list_value_length(tokens)
        length = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * rows + np.repeat(np.arange(rows), length)
        key, tf = np.unique(key, return_counts=True)
        term, doc = key // rows, key % rows
        ids, names = batch.column(0), [batch.schema.names[0], "term", "tf", "dl"]
        listed = [ids.take(pa.array(doc)), coded.dictionary.take(pa.array(term)), pa.array(tf.astype(np.int64)), pa.array(length[doc])]
        yield pa.RecordBatch.from_arrays(listed, names=names)
        whole = [ids, pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int64()), sizes.cast(pa.int64())]
        yield pa.RecordBatch.from_arrays(whole, names=names)


def lexical_index(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: str | None = None, tokens=tokenize_words,
    path: str | None = None,
) -> PostingIndex:
    """Tokenise a corpus and store its posting blocks once, for any number of searches and rerankings."""
    spark = docs.sparkSession
    index = PostingIndex(spark, path or fresh_path(spark, "postings"), docs.schema[doc_id].dataType.simpleString())
    index.add(docs, doc_id, text, scope, tokens)
    return index


# --- Lexical and vector top-k -----------------------------------------------

def bm25_topk(
    docs: DataFrame,
    queries: DataFrame,
    doc_id: str = "doc_id",
    query_id: str = "query_id",
    text: str = "text",
    query_text: str = "text",
    k: int = fv.CANDIDATES,
    scope: str | None = None,
    tokens=tokenize_words,
    index: PostingIndex | None = None,
) -> DataFrame:
    """Top ``k`` documents per query by Okapi BM25: (query, doc, score, rank).

    With an ``index`` of the documents neither they nor their texts are read. Corpus
    statistics are those of the ``scope``, e.g. conversation. A word in more than half of
    the documents gets a quarter of the mean IDF. Posting blocks whose bound cannot
    reach a query's k-th score are skipped (see :mod:`postings`). Scores are rounded
    to six digits before ranking.
    """
    stored = index or lexical_index(docs, doc_id, text, scope, tokens)
    return stored.search(queries, query_id, query_text, doc_id, k, scope, tokens)


def vector_topk(
    corpus: DataFrame,
    queries: DataFrame,
    vector_id: str = "vec_id",
    query_id: str = "query_id",
    vector: str = "embedding",
    k: int = fv.CANDIDATES,
    scope: str | None = None,
) -> DataFrame:
    """Exact top ``k`` neighbours by dot product: (query, vector id, score, rank).

    Vectors are grouped around pivots and only groups whose bound reaches a query's
    k-th score are multiplied with it, block by block (see :mod:`nearest`).
    """
    return nearest.top_k(corpus, queries, vector_id, query_id, vector, k, scope)


def dedupe_prefix(
    df: DataFrame, keys: list[str], text: str, rank: str, length: int = fv.DEDUPE_PREFIX
) -> DataFrame:
    """Best-ranked row of every (keys, text prefix); a group of copies collapses
    in the partial aggregation, before any shuffle."""
    others = [c for c in df.columns if c not in (*keys, rank)]
    return (
        df.groupBy(*keys, F.substring(text, 1, length).alias("_prefix"))
        .agg(F.min(F.struct(rank, *others)).alias("_first"))
        .select(*keys, "_first.*")
    )


def rrf_fusion(
    lexical: DataFrame,
    vectors: DataFrame,
    query_id: str,
    doc_id: str,
    weights: tuple[float, float] = (fv.LEXICAL_WEIGHT, fv.VECTOR_WEIGHT),
    constant: int = fv.FUSION_CONSTANT,
) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked lists: (query, doc, fused, fused_rank)."""
    def side(df: DataFrame, weight: float, name: str) -> DataFrame:
        return df.select(query_id, doc_id, (F.lit(weight) / (F.col("rank") + constant)).alias(name))

    # Every list names a document once per query, so a full join adds the two parts.
    fused = (
        side(lexical, weights[0], "_lexical")
        .join(side(vectors, weights[1], "_vector"), [query_id, doc_id], "full")
        .select(
            query_id, doc_id,
            F.round(F.coalesce("_lexical", F.lit(0.0)) + F.coalesce("_vector", F.lit(0.0)), 9).alias("fused"),
        )
    )
    order = Window.partitionBy(query_id).orderBy(F.desc("fused"), doc_id)
    return fused.withColumn("fused_rank", F.row_number().over(order))


def hybrid_candidates(
    fused: DataFrame, docs: DataFrame, query_id: str, doc_id: str, text: str = "text",
    k: int = fv.CANDIDATES,
) -> DataFrame:
    """Fused list with texts, one row per text prefix, best ``k`` per query.

    The list is written first: texts are not shuffled to meet a short one, and neither list is made twice.
    """
    with_text = kept(fused, "fused").join(docs.select(doc_id, F.col(text).alias("chunk")), doc_id)
    unique = dedupe_prefix(with_text, [query_id], "chunk", "fused_rank")
    return kept(top_n_per_group(unique, [query_id], [F.col("fused_rank")], k, "candidate"), "candidates")


def coverage_scorer(frequency: DataFrame | Callable[[DataFrame], DataFrame], documents: int):
    """Default reranker: share of the question's IDF weight that the chunk covers.

    ``frequency`` is (term, df) or a function that gives it for some words (term). Returns a function (pairs, question column, chunk column) -> pairs with
    ``rerank_score`` in 0..1.
    """
    def score(pairs: DataFrame, query_id: str, question: str, chunk: str) -> DataFrame:
        words = (
            pairs.select(query_id, question)
            .distinct()
            .select(query_id, F.explode(F.array_distinct(tokenize_words(F.col(question)))).alias("term"))
        )
        known = frequency(kept(words.select("term").distinct(), "asked-words")) if callable(frequency) else frequency
        terms = (
            words.join(known, "term")
            .groupBy(query_id)
            .agg(
                F.map_from_entries(
                    F.collect_list(F.struct("term", F.log(1 + F.lit(float(documents)) / F.col("df"))))
                ).alias("_idf")
            )
        )
        covered = F.array_intersect(F.map_keys("_idf"), tokenize_words(F.col(chunk)))
        gained = F.aggregate(
            covered, F.lit(0.0), lambda total, term: total + F.try_element_at(F.col("_idf"), term)
        )
        possible = F.aggregate(F.map_values("_idf"), F.lit(0.0), lambda total, w: total + w)
        return (
            pairs.join(terms, query_id, "left")
            .withColumn("rerank_score", F.coalesce(F.round(F.try_divide(gained, possible), 6), F.lit(0.0)))
            .drop("_idf")
        )

    return score


def rerank_topk(
    candidates: DataFrame, query_id: str, question: str, chunk: str, tie: str, scorer,
    k: int = fv.RERANKED,
) -> DataFrame:
    """Best ``k`` candidates per question by ``scorer``.

    ``scorer`` is a function on the pair table (see :func:`coverage_scorer`) or
    a two-argument function of Columns, e.g. a pandas UDF around a model.
    """
    import inspect

    if len(inspect.signature(scorer).parameters) == 2:
        scored = candidates.withColumn("rerank_score", scorer(F.col(question), F.col(chunk)))
    else:
        scored = scorer(candidates, query_id, question, chunk)
    return top_n_per_group(scored, [query_id], [F.desc("rerank_score"), F.col(tie)], k, "position")


def expand_low_score(
    questions: DataFrame,
    reranked: DataFrame,
    synonyms: DataFrame,
    retrieve,
    rerank,
    query_id: str,
    doc_id: str,
    question: str,
    seen: DataFrame,
    trigger: float = fv.EXPANSION_TRIGGER,
    texts: DataFrame | None = None,
    text: str = "text",
    prefix: int = fv.DEDUPE_PREFIX,
) -> DataFrame:
    """Second retrieval for questions whose best score is below ``trigger``.

    ``synonyms`` is (term, expansion). ``retrieve(questions)`` gives candidates
    with at least (query, doc); only candidates not in ``seen`` are added before
    ``rerank``, and with ``texts`` (doc, text) only those whose text begins unlike
    any seen one. Questions above the trigger never reach the expansion joins. Lists
    are written before they meet the texts, so that no text is shuffled to meet a short one.
    """
    best = reranked.groupBy(query_id).agg(F.max("rerank_score").alias("_best"))
    low = questions.join(best.filter(F.col("_best") < trigger), query_id, "left_semi")
    extra = (
        low.select(query_id, F.explode(F.array_distinct(tokenize_words(F.col(question)))).alias("term"))
        .join(synonyms, "term")
        .groupBy(query_id)
        .agg(F.array_join(F.array_sort(F.collect_set("expansion")), " ").alias("_extra"))
    )
    expanded = low.join(extra, query_id).withColumn(
        question, F.concat_ws(" ", question, "_extra")
    ).drop("_extra")
    fresh = kept(retrieve(expanded).join(seen.select(query_id, doc_id), [query_id, doc_id], "left_anti"), "fresh")
    if texts is not None:
        begins = texts.select(doc_id, F.substring(text, 1, prefix).alias("_prefix"))
        known = seen.join(begins, doc_id).select(query_id, "_prefix").distinct()
        fresh = (
            fresh.join(begins, doc_id).join(known, [query_id, "_prefix"], "left_anti")
            .groupBy(query_id, "_prefix").agg(F.min(doc_id).alias(doc_id))
        )
    old = seen.join(low.select(query_id), query_id, "left_semi")
    again = rerank(kept(old.select(query_id, doc_id).unionByName(fresh.select(query_id, doc_id)), "expanded-candidates"))
    untouched = reranked.join(low.select(query_id), query_id, "left_anti")
    return untouched.select(*again.columns).unionByName(again)


def relevance_guard(
    reranked: DataFrame, query_id: str, documents: Column,
    threshold: float = fv.GUARD_THRESHOLD, step: float = fv.GUARD_STEP, most: float = fv.GUARD_MAX,
) -> DataFrame:
    """Per question: best and mean score, the relaxed threshold, and ``not_found``."""
    relax = F.least(F.lit(most), F.greatest(F.lit(0.0), (documents - 1) * F.lit(step)))
    return (
        reranked.groupBy(query_id)
        .agg(F.max("rerank_score").alias("top_score"), F.avg("rerank_score").alias("avg_score"))
        .withColumn("threshold", F.lit(threshold) - relax)
        .withColumn(
            "not_found",
            (F.col("top_score") < F.col("threshold")) & (F.col("avg_score") < F.col("threshold")),
        )
    )


def answer_sources(
    reranked: DataFrame, query_id: str, text: str, source: str, source_type: str, page: str | None = None
) -> DataFrame:
    """One row per hit as shown under an answer."""
    cols = [
        F.col(query_id),
        "position",
        F.coalesce(F.col(source), F.lit("unknown")).alias("source"),
        F.coalesce(F.col(source_type), F.lit("unknown")).alias("type"),
        preview_text(F.col(text)).alias("preview"),
        F.col("rerank_score").alias("relevance_score"),
    ]
    return reranked.select(*cols, *([F.col(page).alias("page")] if page else []))


def source_files(sources: DataFrame, query_id: str) -> DataFrame:
    """Distinct source files per question (at most the few reranked hits)."""
    return sources.groupBy(query_id).agg(
        F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("files"),
        F.count("*").alias("source_count"),
    )


def abbreviation_synonyms(spark) -> DataFrame:
    """The abbreviation list in both directions as a (term, expansion) table."""
    rows = [(a, b) for a, b in fv.ABBREVIATIONS.items()] + [
        (b, a) for a, b in fv.ABBREVIATIONS.items() if " " not in b
    ]
    return spark.createDataFrame(rows, "term string, expansion string")

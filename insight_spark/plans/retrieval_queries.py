"""Chunks, vocabulary, BM25, vectors, fusion, reranking and the guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from insight_spark.functions import fixed_values as fv
from insight_spark.operators import expansion
from insight_spark.operators import retrieval as ret
from insight_spark.operators import routing
from insight_spark.operators.postings import PostingIndex
from insight_spark.operators.scale import kept, spread_small, top_n_per_group
from insight_spark.plans.registry import Tables, query, sql_list
from insight_spark.plans.text_queries import TOKENS_SQL, WORDS_SQL
from insight_spark.session import fresh_path
from insight_spark.sources.session_store import SessionStore


def documents(t: Tables) -> DataFrame:
    return spread_small(t.documents.select("doc_id", "text"))


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


# --- Chunks -----------------------------------------------------------------

@query("split_recursive")
def split_recursive(t: Tables) -> DataFrame:
    """Every document as chunks of at most 1000 characters, 200 of them shared."""
    return ret.split_recursive(documents(t))


@query("split_recursive_bounds", """
SELECT doc_id, true AS within_size, true AS in_text, true AS opens, true AS closes FROM documents WHERE regexp_matches(text, '\\S')""")
def split_recursive_bounds(t: Tables) -> DataFrame:
    """Per document: no chunk is too long, all are parts of the text, the first opens it and the last closes it.

    A text is trimmed once and goes along with its chunks, which are added up where they are cut: no text is shuffled.
    """
    whole = F.btrim("text", F.lit(ret.SPACES))
    given = documents(t).select("doc_id", "text", whole.alias("whole"), F.monotonically_increasing_id().alias("row"))
    return ret.split_recursive(given).groupBy("row", "doc_id").agg(
        (F.max(F.length("chunk")) <= fv.PROSE_CHUNK).alias("within_size"), F.bool_and(F.contains("whole", "chunk")).alias("in_text"),
        F.min_by(F.startswith("whole", "chunk"), "chunk_no").alias("opens"),
        F.max_by(F.endswith("whole", "chunk"), "chunk_no").alias("closes"),
    ).drop("row")


@query("split_structured")
def split_structured(t: Tables) -> DataFrame:
    return ret.split_structured(documents(t))


@query("tag_source", """
SELECT doc_id, 'document' AS source_type, source || '.txt' AS source, '' AS columns FROM documents""")
def tag_source(t: Tables) -> DataFrame:
    tagged = ret.tag_source(t.documents.select("doc_id", F.col("source").alias("name")), "document", F.concat("name", F.lit(".txt")))
    return tagged.select("doc_id", "source_type", "source", F.array_join("columns", ",").alias("columns"))


@query("embed_text_norm", f"""
SELECT doc_id, 64 AS width, CASE WHEN len({TOKENS_SQL.format('text')}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents""")
def embed_text_norm(t: Tables) -> DataFrame:
    """Every vector has the asked width and length one; a text without a word has the null vector."""
    squares = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    return embed_text(t).select("doc_id", F.size("embedding").alias("width"), F.round(F.sqrt(squares), 4).alias("norm"))


@query("embed_text")
def embed_text(t: Tables) -> DataFrame:
    """Unit vectors of all documents by hashed, IDF-weighted words."""
    return ret.embed_text(documents(t), width=64).select("doc_id", "embedding")


# --- Vocabulary and postings ------------------------------------------------

PART_TEXT_SQL = "concat_ws(' ', p_name, p_brand, p_type)"


def mixed_chunks(t: Tables) -> DataFrame:
    """Part rows as csv chunks and documents as document chunks."""
    names = t.part.columns
    rows = t.part.select(
        F.lit("csv").alias("source_type"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"),
        F.array(*[F.lit(n) for n in names]).alias("columns"),
    )
    docs = documents(t).select(
        F.lit("document").alias("source_type"), "text", F.array().cast("array<string>").alias("columns")
    )
    return rows.unionByName(docs)


VOCABULARY_SQL = f"""
terms AS (SELECT 'csv' AS s, unnest({TOKENS_SQL.format(PART_TEXT_SQL)}) AS term FROM part
 UNION ALL SELECT 'document', unnest({TOKENS_SQL.format('text')}) FROM documents
 UNION ALL SELECT 'pinned', unnest(['partkey', 'name', 'brand', 'type', 'size', 'retailprice'])),
sides AS (SELECT term, bool_or(s IN ('csv', 'pinned')) AS in_csv, bool_or(s = 'document') AS in_doc, bool_or(s = 'pinned') AS pinned
 FROM terms GROUP BY term),
vocab AS (SELECT term, 'overlap' AS vocabulary FROM sides WHERE in_csv AND in_doc AND NOT pinned
 UNION ALL SELECT term, 'csv' FROM sides WHERE in_csv AND (NOT in_doc OR pinned)
 UNION ALL SELECT term, 'document' FROM sides WHERE in_doc AND (NOT in_csv OR pinned))"""


@query("source_vocabulary", f"WITH {VOCABULARY_SQL} SELECT term, vocabulary FROM vocab")
def source_vocabulary(t: Tables) -> DataFrame:
    return ret.source_vocabulary(mixed_chunks(t), [])


@query("set_vocab", f"WITH {VOCABULARY_SQL} SELECT vocabulary, count(*) AS terms FROM vocab GROUP BY vocabulary")
def set_vocab(t: Tables) -> DataFrame:
    return ret.source_vocabulary(mixed_chunks(t), []).groupBy("vocabulary").agg(F.count("*").alias("terms"))


@query("agg_term_counts", f"""
WITH w AS (SELECT source_type, unnest(words) AS term FROM (
 SELECT 'csv' AS source_type, {TOKENS_SQL.format(PART_TEXT_SQL)} AS words FROM part
 UNION ALL SELECT 'document', {TOKENS_SQL.format('text')} FROM documents))
SELECT source_type, term, count(*) AS n FROM w GROUP BY ALL""")
def agg_term_counts(t: Tables) -> DataFrame:
    return ret.term_counts(mixed_chunks(t), by=["source_type"])


POSTINGS_SQL = f"""
words AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS ws FROM documents),
tf AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM words) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
dl AS (SELECT doc_id, len(ws) AS dl FROM words)"""


@query("build_postings", f"""
WITH {POSTINGS_SQL} SELECT tf.term, tf.doc_id, tf.tf, freq.df, dl.dl::BIGINT AS dl FROM tf JOIN freq USING (term) JOIN dl USING (doc_id)""")
def build_postings(t: Tables) -> DataFrame:
    postings, frequency, _ = ret.build_postings(documents(t), "doc_id")
    # The vocabulary is the small side: each task holds its share of it, and the postings are not sorted.
    found = postings.filter(F.col("doc_id").isNotNull()).join(frequency.hint("shuffle_hash"), "term")
    return found.select("doc_id", "term", "tf", "df", "dl")


# --- Top-k ------------------------------------------------------------------

BM25_SQL = f"""
{POSTINGS_SQL},
size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM freq, size),
weight AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM idf) ELSE raw END AS w FROM idf),
asked AS (SELECT query_id, term, count(*) AS times FROM (
 SELECT item_id AS query_id, unnest({TOKENS_SQL.format('text')}) AS term FROM benchmark) GROUP BY ALL),
bm25_all AS (SELECT a.query_id, tf.doc_id, round(sum(a.times * w.w * tf.tf * 2.5::DOUBLE /
  (tf.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / size.avgdl))), 6) AS score
 FROM asked a JOIN tf USING (term) JOIN weight w USING (term) JOIN dl ON dl.doc_id = tf.doc_id, size GROUP BY ALL),
bm25 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm25_all
 QUALIFY rank <= 10)"""


def index_of(t: Tables) -> PostingIndex:
    """The posting blocks of the documents, stored once per query run."""
    if "_lexical" not in t.__dict__:
        t._lexical = ret.lexical_index(documents(t))
    return t._lexical


def lexical(t: Tables) -> DataFrame:
    return ret.bm25_topk(documents(t), questions(t), index=index_of(t))


@query("bm25_topk", f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM bm25")
def bm25_topk(t: Tables) -> DataFrame:
    return lexical(t)


@query("bm25_join", f"""
WITH {BM25_SQL} SELECT b.query_id, b.doc_id, d.source, b.score, b.rank FROM bm25 b JOIN documents d USING (doc_id)""")
def bm25_join(t: Tables) -> DataFrame:
    """BM25 hits with the source of the document."""
    return lexical(t).join(t.documents.select("doc_id", "source"), "doc_id")


VECTOR_SQL = """
pairs AS (SELECT b.item_id AS query_id, v.vec_id AS doc_id,
  round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
 FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v),
vec AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM pairs QUALIFY rank <= 10)"""


def question_vectors(t: Tables) -> DataFrame:
    """Questions with the vector of the same number."""
    return questions(t).join(t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")


def chunk_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def semantic(t: Tables) -> DataFrame:
    return ret.vector_topk(chunk_vectors(t), question_vectors(t), "doc_id")


@query("vector_topk", f"WITH {VECTOR_SQL} SELECT query_id, doc_id, score, rank FROM vec")
def vector_topk(t: Tables) -> DataFrame:
    return semantic(t)


@query("knn_join", """
WITH pairs AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
 FROM embeddings q, embeddings v WHERE q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 6""")
def knn_join(t: Tables) -> DataFrame:
    """Six nearest other vectors of every vector."""
    vectors = t.embeddings.select("vec_id", "embedding")
    found = ret.vector_topk(vectors, vectors.withColumnRenamed("vec_id", "query_id"), "vec_id", k=7)
    others = found.filter(F.col("query_id") != F.col("vec_id")).drop("rank")
    return top_n_per_group(others, ["query_id"], [F.desc("score"), F.col("vec_id")], 6)


# --- Fusion, reranking, guard -----------------------------------------------

FUSION_SQL = f"""
{BM25_SQL}, {VECTOR_SQL},
fused AS (SELECT query_id, doc_id, round(sum(w), 9) AS fused FROM (
 SELECT query_id, doc_id, 0.5::DOUBLE / (60 + rank) AS w FROM bm25 UNION ALL SELECT query_id, doc_id, 0.5::DOUBLE / (60 + rank) FROM vec) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS INTEGER) AS fused_rank FROM fused)"""
CANDIDATE_SQL = f"""
{FUSION_SQL},
firsts AS (SELECT r.query_id, substring(d.text, 1, 100) AS prefix, min(r.fused_rank) AS fused_rank
 FROM ranked r JOIN documents d USING (doc_id) GROUP BY ALL),
cand AS (SELECT r.query_id, r.doc_id, r.fused_rank, r.fused, CAST(row_number() OVER (PARTITION BY r.query_id ORDER BY r.fused_rank) AS INTEGER) AS candidate
 FROM ranked r JOIN firsts f ON r.query_id = f.query_id AND r.fused_rank = f.fused_rank QUALIFY candidate <= 10)"""


@query("set_rrf_fusion", f"WITH {FUSION_SQL} SELECT query_id, doc_id, fused, fused_rank FROM ranked")
def set_rrf_fusion(t: Tables) -> DataFrame:
    return ret.rrf_fusion(lexical(t), semantic(t), "query_id", "doc_id")


def candidates(t: Tables) -> DataFrame:
    fused = ret.rrf_fusion(lexical(t), semantic(t), "query_id", "doc_id")
    return ret.hybrid_candidates(fused, t.documents, "query_id", "doc_id")


@query("hybrid_candidates", f"WITH {CANDIDATE_SQL} SELECT query_id, doc_id, fused, fused_rank, candidate FROM cand")
def hybrid_candidates(t: Tables) -> DataFrame:
    return candidates(t).drop("chunk")


RERANK_SQL = f"""
{CANDIDATE_SQL},
qterm AS (SELECT DISTINCT query_id, term FROM asked),
qidf AS (SELECT query_id, term, ln(1 + size.n::DOUBLE / freq.df) AS idf FROM qterm JOIN freq USING (term), size),
possible AS (SELECT query_id, sum(idf) AS total FROM qidf GROUP BY query_id),
gained AS (SELECT c.query_id, c.doc_id, sum(q.idf) AS got FROM cand c JOIN qidf q USING (query_id)
 JOIN tf ON tf.term = q.term AND tf.doc_id = c.doc_id GROUP BY ALL),
scored AS (SELECT c.query_id, c.doc_id, coalesce(round(g.got / p.total, 6), 0) AS rerank_score
 FROM cand c LEFT JOIN gained g ON g.query_id = c.query_id AND g.doc_id = c.doc_id LEFT JOIN possible p ON p.query_id = c.query_id),
top3 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS INTEGER) AS position FROM scored QUALIFY position <= 3)"""


def scorer(t: Tables):
    return ret.coverage_scorer(index_of(t).frequency, index_of(t).documents())


def reranked(t: Tables) -> DataFrame:
    pairs = candidates(t).join(questions(t), "query_id")
    return ret.rerank_topk(pairs, "query_id", "text", "chunk", "doc_id", scorer(t))


@query("rerank_topk", f"WITH {RERANK_SQL} SELECT query_id, doc_id, rerank_score, position FROM top3")
def rerank_topk(t: Tables) -> DataFrame:
    return reranked(t).select("query_id", "doc_id", "rerank_score", "position")


# Scores lie in 0..1 with the default scorer, so the guard gets its own scale here.
GUARD = {"threshold": 0.9, "step": 0.05, "most": 0.2}


@query("relevance_guard", f"""
WITH {RERANK_SQL}, g AS (SELECT query_id, max(rerank_score) AS top_score, avg(rerank_score) AS avg_score FROM top3 GROUP BY query_id)
SELECT query_id, top_score, round(avg_score, 6) AS avg_score, round(0.9 - least(0.2, greatest(0.0, (query_id % 5) * 0.05)), 6)::DOUBLE AS threshold,
 top_score < 0.9::DOUBLE - least(0.2::DOUBLE, (query_id % 5) * 0.05::DOUBLE) AND avg_score < 0.9::DOUBLE - least(0.2::DOUBLE, (query_id % 5) * 0.05::DOUBLE) AS not_found FROM g""")
def relevance_guard(t: Tables) -> DataFrame:
    out = ret.relevance_guard(reranked(t), "query_id", F.col("query_id") % 5 + 1, **GUARD)
    return out.withColumns({"avg_score": F.round("avg_score", 6), "threshold": F.round("threshold", 6)})


@query("answer_sources", f"""
WITH {RERANK_SQL} SELECT t.query_id, t.position, d.source, 'document' AS type, substring(d.text, 1, 150) || '...' AS preview,
 t.rerank_score AS relevance_score FROM top3 t JOIN documents d USING (doc_id)""")
def answer_sources(t: Tables) -> DataFrame:
    hits = reranked(t).join(t.documents.select("doc_id", "source"), "doc_id").withColumn("source_type", F.lit("document"))
    return ret.answer_sources(hits, "query_id", "chunk", "source", "source_type")


@query("answer_source_files", f"""
WITH {RERANK_SQL}, f AS (SELECT query_id, source, count(*) AS n FROM top3 JOIN documents USING (doc_id) GROUP BY ALL)
SELECT query_id, string_agg(source, ', ' ORDER BY source) AS files, sum(n)::BIGINT AS source_count FROM f GROUP BY query_id""")
def answer_source_files(t: Tables) -> DataFrame:
    hits = reranked(t).join(t.documents.select("doc_id", "source"), "doc_id").withColumn("source_type", F.lit("document"))
    return ret.source_files(ret.answer_sources(hits, "query_id", "chunk", "source", "source_type"), "query_id")


PAIRS_SQL = f"""
w AS (SELECT {TOKENS_SQL.format('text')} AS ws FROM documents),
p AS (SELECT ws[i] AS x, ws[i + d] AS y FROM (SELECT ws, unnest(range(1, len(ws) + 1)) AS i FROM w), range(1, 6) r(d) WHERE i + d <= len(ws)),
near AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM p WHERE x <> y GROUP BY ALL),
m AS (SELECT word, sum(n) AS m FROM (SELECT a AS word, n FROM near UNION ALL SELECT b, n FROM near) GROUP BY word)"""


@query("expansion_pairs", f"""
WITH {PAIRS_SQL} SELECT a, b, n, round(log2(n::DOUBLE * (2.0::DOUBLE * (SELECT sum(n) FROM near)) / (ma.m::DOUBLE * mb.m)), 6) AS pmi
FROM near JOIN m ma ON ma.word = a JOIN m mb ON mb.word = b WHERE n >= 3""")
def expansion_pairs(t: Tables) -> DataFrame:
    """Words near each other in the documents, with their mutual information."""
    return expansion.mutual_information(expansion.near_pairs(documents(t)))


@query("expand_low_score")
def expand_low_score(t: Tables) -> DataFrame:
    """Second retrieval for the questions that the first one covers poorly.

    A question gets the words that stand near its own most tellingly in the documents, and
    the abbreviation table's.
    """
    asked, docs, score = questions(t), documents(t), scorer(t)
    first = kept(candidates(t).select("query_id", "doc_id"), "first-candidates")
    with_text = lambda pairs: pairs.join(docs.withColumnRenamed("text", "chunk"), "doc_id").join(asked, "query_id")
    rerank = lambda pairs: ret.rerank_topk(with_text(pairs), "query_id", "text", "chunk", "doc_id", score).select(
        "query_id", "doc_id", "rerank_score", "position"
    )
    scored = expansion.mutual_information(expansion.near_pairs(docs))
    synonyms = kept(expansion.expansion_terms(scored).unionByName(ret.abbreviation_synonyms(t.spark)), "synonyms")
    return ret.expand_low_score(
        asked, kept(rerank(first), "reranked"), synonyms, lambda q: ret.bm25_topk(docs, q, index=index_of(t)), rerank,
        "query_id", "doc_id", "text", first, trigger=0.9, texts=docs,
    )


@query("session_retrieval")
def session_retrieval(t: Tables) -> DataFrame:
    """Search within a conversation, from splitting to the guard.

    Documents are split into chunks and stored with their vectors and posting blocks; a
    source is a conversation, and every question asks within one, of the store. BM25
    and vectors are fused, copies dropped and the rest reranked.
    """
    chunks = ret.split_recursive(spread_small(t.documents.select("doc_id", "source", "text"))).select(
        F.concat_ws("-", "doc_id", "chunk_no").alias("chunk_id"), F.col("source").alias("conversation"), F.col("chunk").alias("text")
    )
    asked = t.benchmark.select(
        F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("conversation"), "text"
    )
    store = SessionStore(t.spark, fresh_path(t.spark, "session"))
    store.add(chunks)
    return store.search(asked).select("query_id", "chunk_id", "rerank_score", "position")


@query("session_retrieval_known", """
SELECT 'src' || (s % 20) AS conversation, 'zq' || chr((97 + s % 20)::INTEGER) || 'xword' AS word, 'mark-' || (s % 20) AS chunk_id, 1 AS position, 1.0::DOUBLE AS score
FROM range(20) r(s) WHERE 'src' || (s % 20) IN (SELECT source FROM documents)""")
def session_retrieval_known(t: Tables) -> DataFrame:
    """A word that one added chunk of a conversation holds, and chunks of the others too, finds that chunk first."""
    docs = t.documents.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("conversation"), "text")
    named = docs.select("conversation").distinct().withColumn("s", F.regexp_extract("conversation", r"^src([0-9]+)$", 1).cast("int")).filter("s < 20")
    word = F.concat(F.lit("zq"), F.char(F.col("s") + 97), F.lit("xword"))
    marks = named.select(F.concat(F.lit("mark-"), "s").alias("chunk_id"), "conversation", F.concat(F.lit("a chunk about "), word).alias("text"))
    # The same words stand in another conversation, where nobody asks for them.
    strays = named.select(F.concat(F.lit("stray-"), "s").alias("chunk_id"), F.lit("elsewhere").alias("conversation"), word.alias("text"))
    store = SessionStore(t.spark, fresh_path(t.spark, "session"))
    store.add(docs.unionByName(marks).unionByName(strays))
    asked = named.select(F.col("s").alias("query_id"), "conversation", word.alias("text"))
    found = store.search(asked).filter("position = 1").withColumnRenamed("rerank_score", "score")
    return found.join(asked.select("query_id", "conversation", F.col("text").alias("word")), "query_id").select(
        "conversation", "word", "chunk_id", "position", "score"
    )


# --- Vocabulary hints -------------------------------------------------------

def turn_questions(t: Tables) -> DataFrame:
    """User turns and the names of parts, as questions with one id."""
    turns = t.conversations.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question")
    )
    parts = t.part.select((-F.col("p_partkey") - 1).alias("query_id"), F.concat_ws(" ", F.lit("show the total size of"), "p_name").alias("question"))
    return turns.unionByName(parts)


TURN_SQL = """turns AS (SELECT conv_id * 1000 + turn AS query_id, text AS question FROM conversations WHERE role = 'user'
 UNION ALL SELECT -p_partkey - 1, 'show the total size of ' || p_name FROM part)"""
HINT_SQL = f"""{TURN_SQL}, {VOCABULARY_SQL},
qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({WORDS_SQL.format('question')}) AS term FROM turns)
 WHERE NOT list_contains({sql_list(fv.INTENT_WORDS)}, term)),
hits AS (SELECT query_id, count(*) FILTER (vocabulary = 'csv') AS csv_hits, count(*) FILTER (vocabulary = 'document') AS doc_hits
 FROM qt JOIN vocab USING (term) GROUP BY query_id),
hint AS (SELECT t.query_id, coalesce(csv_hits, 0) AS csv_hits, coalesce(doc_hits, 0) AS doc_hits FROM turns t LEFT JOIN hits USING (query_id))"""


@query("source_hint", f"""
WITH {HINT_SQL} SELECT query_id, csv_hits, doc_hits, CASE WHEN csv_hits > doc_hits THEN 'csv' WHEN doc_hits > csv_hits THEN 'document' ELSE 'tie' END AS hint FROM hint""")
def source_hint(t: Tables) -> DataFrame:
    return routing.source_hint(turn_questions(t), ret.source_vocabulary(mixed_chunks(t), []), "query_id", "question")


@query("join_vocab_hits", f"WITH {HINT_SQL} SELECT query_id, csv_hits, doc_hits FROM hint")
def join_vocab_hits(t: Tables) -> DataFrame:
    return source_hint(t).drop("hint")


@query("source_dominance", f"""
WITH {VECTOR_SQL}, s AS (SELECT v.query_id, CASE WHEN e.label < 5 THEN 'csv' ELSE 'document' END AS source_type, v.rank
 FROM vec v JOIN embeddings e ON e.vec_id = v.doc_id WHERE v.rank <= 3),
c AS (SELECT query_id, source_type, count(*) AS n FROM s GROUP BY ALL)
SELECT query_id, arg_max(source_type, n) AS dominant FROM c GROUP BY query_id""")
def source_dominance(t: Tables) -> DataFrame:
    """Majority source of the three best chunks; the label stands for the source."""
    kinds = chunk_vectors(t).select("doc_id", F.when(F.col("label") < 5, "csv").otherwise("document").alias("source_type"))
    hits = ret.vector_topk(chunk_vectors(t), question_vectors(t), "doc_id", k=6).join(kinds, "doc_id")
    return routing.source_dominance(hits, "query_id", "source_type")

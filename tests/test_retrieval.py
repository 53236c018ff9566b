"""Retrieval against brute force on small inputs."""

import difflib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from insight_spark.functions import fixed_values as fv
from insight_spark.operators import postings, resolve, retrieval as ret

VOCABULARY = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "lambda", "zeta"]


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(VOCABULARY[: 3 + i % 8]) for _ in range(rng.randrange(1, 30)))) for i in range(n)]


def okapi(docs, queries, k):
    tokens = {i: [w for w in re.findall(r"[a-z]{3,}", t) if w not in fv.STOP_WORDS] for i, t in docs}
    n, avgdl = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = Counter(w for ws in tokens.values() for w in set(ws))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = {}
    for q, text in queries:
        scores = []
        for i, ws in tokens.items():
            tf = Counter(ws)
            s = sum(
                idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for w in text.split() if w in idf and tf[w]
            )
            if any(w in idf and tf[w] for w in text.split()):
                scores.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("shard_docs", [4096, 5])
def test_bm25_equals_brute_force(spark, monkeypatch, shard_docs):
    monkeypatch.setattr(postings, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(postings, "FIRST_SHARDS", 3)
    docs, queries = corpus(), [(1, "alpha beta beta"), (2, "zeta kappa unknownword"), (3, "sigma"), (4, "nothing here")]
    got = ret.bm25_topk(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame(queries, "query_id long, text string"), k=7,
    ).collect()
    expected = okapi(docs, queries, 7)
    for q, _ in queries:
        rows = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["doc_id"] for r in rows] == [i for i, _ in expected[q]]
        assert [r["score"] for r in rows] == pytest.approx([s for _, s in expected[q]], abs=2e-6)


def test_bm25_per_conversation(spark):
    docs = corpus()
    scoped = [(i, t, "a" if i < 30 else "b") for i, t in docs]
    queries = [(1, "alpha gamma", "a"), (2, "alpha gamma", "b")]
    got = ret.bm25_topk(
        spark.createDataFrame(scoped, "doc_id long, text string, conversation string"),
        spark.createDataFrame(queries, "query_id long, text string, conversation string"), k=5, scope="conversation",
    ).collect()
    for q, text, c in queries:
        expected = okapi([(i, t) for i, t, s in scoped if s == c], [(q, text)], 5)[q]
        assert [r["doc_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for i, _ in expected]


def test_vectors_equal_brute_force(spark):
    rng = random.Random(3)
    # Many equal vectors, so that ties must be broken by id.
    vectors = [(i, [float(rng.randrange(3)) for _ in range(4)], "s" if i % 3 else "t") for i in range(200)]
    queries = [(i, [rng.random() for _ in range(4)], "s" if i % 2 else "t") for i in range(12)]
    corpus_df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, scope string").repartition(6)
    query_df = spark.createDataFrame(queries, "query_id long, embedding array<double>, scope string")

    def brute(scoped):
        out = {}
        for q, v, s in queries:
            scores = [(-round(sum(a * b for a, b in zip(v, w)), 6), i) for i, w, t in vectors if not scoped or s == t]
            out[q] = [i for _, i in sorted(scores)[:9]]
        return out

    for scoped in (False, True):
        got = ret.vector_topk(corpus_df, query_df, k=9, scope="scope" if scoped else None).collect()
        for q, ids in brute(scoped).items():
            assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == ids


def test_split_sizes_and_content():
    text = "One two three. " * 200 + "\n\n" + "x" * 2500 + "\n" + "Last line."
    chunks = ret.split_text(text, 1000, 200, ret.PROSE_SEPARATORS)
    assert max(map(len, chunks)) <= 1000
    assert chunks[0].startswith("One two three. One") and chunks[-1].endswith("Last line.")
    assert "".join(c for chunk in chunks for c in chunk if c == "x").count("x") >= 2500
    # Neighbouring prose chunks share their border, at most 200 characters of it.
    first, second = chunks[0], chunks[1]
    shared = max(n for n in range(0, 201) if second.startswith(first[len(first) - n :].strip()) or n == 0)
    assert 100 < shared <= 200
    assert ret.split_text("short", 1000, 200, ret.PROSE_SEPARATORS) == ["short"]
    assert ret.split_text("  \n ", 1000, 200, ret.PROSE_SEPARATORS) == []
    assert ret.split_text("abcdef", 3, 1, [""]) == ["abc", "cde", "ef"]
    # The separator counts with the piece it opens: " cc" and " dd" do not fit together.
    assert ret.split_text("aa bb cc dd", 5, 2, [" ", ""]) == ["aa bb", "cc", "dd"]
    assert ret.split_text("y" * 12000, 10000, 50, ret.TABLE_SEPARATORS) == ["y" * 12000]


def test_fusion_by_hand(spark):
    lexical = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    vectors = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, doc_id int, rank int")
    rows = ret.rrf_fusion(lexical, vectors, "query_id", "doc_id").orderBy("fused_rank").collect()
    assert [r["doc_id"] for r in rows] == [11, 10, 12]
    assert rows[0]["fused"] == pytest.approx(0.5 / 62 + 0.5 / 61, abs=1e-8)


def test_guard_by_hand(spark):
    hits = spark.createDataFrame([(1, -11.0), (1, -12.0), (2, -9.0), (2, -15.0), (3, -11.0)], "q int, rerank_score double")
    one = {r["q"]: r["not_found"] for r in ret.relevance_guard(hits, "q", F.lit(1)).collect()}
    many = {r["q"]: (r["not_found"], r["threshold"]) for r in ret.relevance_guard(hits, "q", F.lit(9)).collect()}
    assert one == {1: True, 2: False, 3: True}
    assert many == {1: (False, -12.0), 2: (False, -12.0), 3: (False, -12.0)}


def test_dedupe_keeps_best_rank(spark):
    df = spark.createDataFrame([(1, 3, "same" * 40 + "a"), (1, 2, "same" * 40 + "b"), (1, 1, "other")], "q int, r int, t string")
    assert sorted(r["r"] for r in ret.dedupe_prefix(df, ["q"], "t", "r").collect()) == [1, 2]


def test_rerank_takes_any_scorer(spark):
    pairs = spark.createDataFrame([(1, "qq", "a", 1), (1, "qq", "aaa", 2), (1, "qq", "aa", 3)], "q int, question string, chunk string, d int")
    rows = ret.rerank_topk(pairs, "q", "question", "chunk", "d", lambda question, chunk: F.length(chunk).cast("double"), 2).collect()
    assert sorted(r["d"] for r in rows) == [2, 3]


def test_expansion_finds_other_words(spark):
    docs = spark.createDataFrame([(1, "quantity shipped weekly"), (2, "unrelated words only"), (3, "weekly notes")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "qty"), (8, "weekly notes")], "query_id long, text string")
    score = lambda pairs: ret.rerank_topk(
        pairs.join(docs.withColumnRenamed("text", "chunk"), "doc_id").join(asked, "query_id"), "query_id", "text", "chunk", "doc_id",
        lambda question, chunk: F.when(chunk.contains("quantity") & (question == "qty"), 1.0).otherwise(-9.0),
    ).select("query_id", "doc_id", "rerank_score", "position")
    seen = spark.createDataFrame([(7, 2), (8, 3)], "query_id long, doc_id long")
    out = ret.expand_low_score(
        asked, score(seen), ret.abbreviation_synonyms(spark), lambda q: ret.bm25_topk(docs, q), score, "query_id", "doc_id", "text", seen,
    )
    assert {(r["query_id"], r["doc_id"]) for r in out.collect()} >= {(7, 1), (7, 2), (8, 3)}


def test_fuzzy_equals_difflib(spark):
    rng = random.Random(5)
    values = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(3, 9))) for _ in range(150)})
    probes = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(3, 9))) for _ in range(40)} | {"zzz", ""})
    got = resolve.fuzzy_match(
        spark.createDataFrame([("t", p) for p in probes], "table string, probe string"),
        spark.createDataFrame([("t", v) for v in values], "table string, value string").repartition(5), 0.75,
    )
    found = {r["probe"]: r["value"] for r in got.collect()}
    for probe in probes:
        best = difflib.get_close_matches(probe, values, 1, 0.75)
        assert found.get(probe) == (best[0] if best else None)


def test_bm25_answers_from_tiny_corpora(spark):
    asked = spark.createDataFrame([(1, "apple river"), (2, "nothing known")], "query_id int, text string")
    for rows in ([(1, "apple tree")], [(1, "apple tree"), (2, "river bank apple")]):
        docs = spark.createDataFrame(rows, "doc_id int, text string")
        found = ret.bm25_topk(docs, asked).collect()
        assert {(r["query_id"], r["doc_id"]) for r in found} == {(1, d) for d, _ in rows}


def test_vectors_of_another_width_are_an_error(spark):
    import pytest

    one = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None)], "vec_id int, embedding array<double>")
    assert ret.vector_topk(mixed.filter("vec_id <> 2"), one).count() == 1
    with pytest.raises(Exception, match="other than 2 numbers"):
        ret.vector_topk(mixed, one).collect()
    with pytest.raises(ValueError):
        ret.vector_topk(mixed, mixed.withColumnRenamed("vec_id", "query_id"))


def test_expansion_leaves_near_copies_out(spark):
    asked = spark.createDataFrame([(1, "apple")], "query_id int, text string")
    texts = spark.createDataFrame([(1, "p" * 100 + "a"), (2, "p" * 100 + "b"), (3, "other"), (4, "other")], "doc_id int, text string")
    seen = spark.createDataFrame([(1, 1)], "query_id int, doc_id int")
    ranked = spark.createDataFrame([(1, 1, 0.1, 1)], "query_id int, doc_id int, rerank_score double, position int")
    synonyms = spark.createDataFrame([("apple", "pear")], "term string, expansion string")
    every = spark.createDataFrame([(1, d) for d in (1, 2, 3, 4)], "query_id int, doc_id int")
    score = lambda pairs: pairs.selectExpr("query_id", "doc_id", "0.5D AS rerank_score", "1 AS position")
    out = ret.expand_low_score(asked, ranked, synonyms, lambda q: every, score, "query_id", "doc_id", "text", seen, texts=texts)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_a_second_retrieval_is_made_once(spark):
    # The list was once made again for every use of it, and met the texts before its size was known.
    asked = spark.createDataFrame([(1, "apple")], "query_id int, text string")
    texts = spark.createDataFrame([(d, f"text {d}") for d in range(9)], "doc_id int, text string")
    seen = spark.createDataFrame([(1, 1)], "query_id int, doc_id int")
    ranked = spark.createDataFrame([(1, 1, 0.1, 1)], "query_id int, doc_id int, rerank_score double, position int")
    synonyms = spark.createDataFrame([("apple", "pear")], "term string, expansion string")
    made = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    every = spark.createDataFrame([(1, d) for d in range(9)], "query_id int, doc_id int").coalesce(1).mapInArrow(note, "query_id int, doc_id int")

    def score(pairs):
        count = pairs.count()  # as a scorer that looks at the questions first
        return pairs.selectExpr("query_id", "doc_id", f"{count}D AS rerank_score", "1 AS position")

    out = ret.expand_low_score(asked, ranked, synonyms, lambda q: every, score, "query_id", "doc_id", "text", seen, trigger=0.9, texts=texts)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(9)) and {r["rerank_score"] for r in out.collect()} == {9.0}
    assert made.value == 9


def test_an_index_gives_the_same_hits(spark):
    docs = spark.createDataFrame([(i, t, "a" if i % 2 else "b") for i, t in corpus()], "doc_id long, text string, conversation string")
    asked = spark.createDataFrame([(1, "alpha gamma", "a"), (2, "beta sigma", "b")], "query_id long, text string, conversation string")
    index = ret.lexical_index(docs, scope="conversation")
    for scope, given in (("conversation", index), (None, ret.lexical_index(docs))):
        plain = sorted(map(tuple, ret.bm25_topk(docs, asked, scope=scope).collect()))
        assert plain == sorted(map(tuple, ret.bm25_topk(docs, asked, scope=scope, index=given).collect()))
    counts = {r["term"]: r["df"] for r in index.frequency().collect()}
    assert counts == {r["term"]: r["df"] for r in ret.build_postings(docs, "doc_id")[1].collect()}
    assert index.documents() == docs.count()


def test_postings_of_repeated_and_missing_ids(spark):
    rows = [(1, "apple pear apple"), (1, "apple plum"), (2, "pear"), (3, "the 12"), (4, None), (None, "apple")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    postings, frequency, lengths = ret.build_postings(docs, "doc_id")
    assert {(r["term"], r["df"]) for r in frequency.collect()} == {("apple", 2), ("pear", 2), ("plum", 1)}
    assert sorted((r["doc_id"] or 0, r["dl"] or 0) for r in lengths.collect()) == [(0, 1), (1, 2), (1, 3), (2, 1), (3, 0), (4, 0)]
    found = sorted((r["doc_id"] or 0, r["term"], r["tf"], r["dl"]) for r in postings.collect())
    assert found == [(0, "apple", 1, 1), (1, "apple", 3, 2), (1, "apple", 3, 3), (1, "pear", 1, 2), (1, "pear", 1, 3), (1, "plum", 1, 2), (1, "plum", 1, 3), (2, "pear", 1, 1)]


def test_postings_read_the_texts_once(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    for table in ret.build_postings(docs, "doc_id"):
        assert "text" not in table._jdf.queryExecution().analyzed().toString()


def test_stored_words_serve_vectors_and_postings(spark):
    from insight_spark.operators.scale import kept
    from insight_spark.session import fresh_path

    docs = spark.createDataFrame([*corpus(), (99, "the 12"), (100, None)], "doc_id long, text string")
    stored = kept(ret.hashed_words(docs, "text", 32), "words")
    weights = ret.embedding_weights(docs, "text", 32)
    bare = stored.drop("text")  # whatever reads a text again fails
    assert ret.embedding_weights(bare, "text", 32) == weights
    vectors = lambda df: sorted((r["doc_id"], list(r["embedding"])) for r in ret.embed_with(df, weights).collect())
    assert vectors(bare) == vectors(docs)
    index = postings.PostingIndex(spark, fresh_path(spark, "postings"), "bigint")
    index.add(bare, stored="_words")
    plain = ret.lexical_index(docs)
    count = lambda found: {(r["term"], r["df"]) for r in found.frequency().collect()}
    assert count(index) == count(plain) and index.sizes().first() == plain.sizes().first()


def test_session_retrieval_stays_in_its_conversation(spark):
    from insight_spark.session import fresh_path
    from insight_spark.sources.session_store import SessionStore

    kind = "chunk_id string, conversation string, text string"
    chunks = spark.createDataFrame(
        [("1", "a", "river bank with willows"), ("2", "a", "stone wall in rain"), ("3", "b", "river bank with willows"), ("4", "b", "cold tea")], kind
    )
    path = fresh_path(spark, "session")
    SessionStore(spark, path).add(chunks)
    asked = spark.createDataFrame([(7, "a", "willows at the river"), (8, "b", "cold tea")], "query_id long, conversation string, text string")
    store = SessionStore(spark, path)  # another process: nothing but the folder
    best = lambda: {r["query_id"]: r["chunk_id"] for r in store.search(asked).filter("position = 1").collect()}
    assert best() == {7: "1", 8: "4"}
    # A conversation is replaced as a whole, or deleted; the others stay.
    store.add(spark.createDataFrame([("5", "a", "willows by the lake"), ("6", "a", "quiet evening")], kind))
    assert best() == {7: "5", 8: "4"}
    assert store.delete("b") and best() == {7: "5"} and store.chunks().count() == 2


def test_bounds_of_chunks_hold_per_row_and_no_text_is_joined(spark, tmp_path):
    """Repeated and missing ids, and white space that only ``str.strip`` takes off."""
    import duckdb

    import __spark_entry__ as entry

    texts = [(1, "a. b\n" * 900), (1, "other words " * 300), (None, "x"), (2, "\u00a0 opens" + " y" * 700 + " "), (3, " \n"), (4, None), (5, "z" * 2500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["split_recursive_bounds"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["split_recursive_bounds"]).fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want)) and len(want) == 5
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()

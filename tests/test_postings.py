"""Stored posting blocks: appended, deleted, bounded, and searched without texts."""

import random

import pytest
from pyspark.sql import functions as F
from test_retrieval import VOCABULARY, corpus, okapi

from insight_spark.operators import postings, retrieval as ret
from insight_spark.session import fresh_path

KIND = "doc_id long, text string, conversation string"


def hits(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


def same(got, want):
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)


def test_append_replace_and_delete(spark):
    index = postings.PostingIndex(spark, fresh_path(spark, "postings"), "bigint")
    first, second = corpus(40, 2), [(100 + i, t) for i, t in corpus(35, 3)]
    frame = lambda rows, c: spark.createDataFrame([(*r, c) for r in rows], KIND)
    index.add(frame(first, "a"), scope="conversation")
    index.add(frame(second, "a"), scope="conversation")
    index.add(frame(corpus(20, 4), "b/c"), scope="conversation")
    asked = spark.createDataFrame([(1, "alpha gamma zeta", "a"), (2, "beta omega", "a"), (3, "alpha", "b/c")], "query_id long, text string, conversation string")
    search = lambda: hits(index.search(asked, scope="conversation", k=6))
    found = search()
    for q, text in ((1, "alpha gamma zeta"), (2, "beta omega")):
        same(found[q], okapi(first + second, [(q, text)], 6)[q])
    same(found[3], okapi(corpus(20, 4), [(3, "alpha")], 6)[3])
    index.add(frame(second, "a"), scope="conversation", replace=True)
    found = search()
    same(found[1], okapi(second, [(1, "alpha gamma zeta")], 6)[1])
    same(found[3], okapi(corpus(20, 4), [(3, "alpha")], 6)[3])
    assert index.delete("b/c") and not index.delete("b/c")
    assert set(search()) == {1, 2} and index.documents() == 35


def test_two_questions_read_no_text(spark):
    """After the build the documents may be gone."""
    path = fresh_path(spark, "docs")
    spark.createDataFrame([(*r, "x") for r in corpus(50, 5)], KIND).write.parquet(path)
    docs = spark.read.parquet(path)
    index = ret.lexical_index(docs)
    for q, text in ((1, "alpha beta"), (2, "sigma kappa")):
        plan = index.search(spark.createDataFrame([(q, text)], "query_id long, text string"), k=4)
        assert path.rsplit("/", 1)[-1] not in plan._jdf.queryExecution().executedPlan().toString()
        same(hits(plan)[q], okapi(corpus(50, 5), [(q, text)], 4)[q])


def test_bounds_hold_and_skip_shards(spark, monkeypatch):
    """A rare word lies in few shards; the others' bounds do not reach its hits."""
    monkeypatch.setattr(postings, "SHARD_DOCS", 20)
    monkeypatch.setattr(postings, "FIRST_SHARDS", 2)
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(VOCABULARY[:4]) for _ in range(20)) + (" quartz quartz quartz onyx" if i % 100 == 7 else "")) for i in range(600)]
    frame = spark.createDataFrame([(*r, "x") for r in docs], KIND)
    index = ret.lexical_index(frame)
    queries = [(1, "quartz onyx alpha"), (2, "quartz onyx beta gamma")]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    weights = index.weights(asked, "query_id", "text", None, postings.tokenize_words)
    pairs = index.bounds(weights)
    shards = index.blocks().select("shard").distinct().count()
    assert shards >= 30 and pairs.count() == shards * len(queries)
    every = index._scores(weights, pairs.drop("bound"), "bigint", 1000)
    place = index.blocks().select("shard", F.explode("docs").alias("doc")).distinct()
    over = every.join(place, "doc").join(pairs, ["query", "shard"]).filter("score > bound + 1e-6")
    assert over.count() == 0
    met = postings.top_n_per_group(pairs, ["query"], [F.desc("bound"), F.col("shard")], 6).drop("rank", "bound")
    first = postings.top_n_per_group(index._scores(weights, met, "bigint", 4), ["query"], [F.desc("score"), F.col("doc")], 4)
    rest = postings.further_shards(pairs, met, first, 4)
    assert rest.count() < 0.5 * pairs.count()
    found = hits(index.search(asked, k=4))
    for q, text in queries:
        same(found[q], okapi(docs, [(q, text)], 4)[q])


def test_empty_texts_and_tables(spark):
    frame = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "alpha alpha", "x")], KIND)
    index = ret.lexical_index(frame)
    asked = spark.createDataFrame([(1, "alpha"), (2, ""), (3, None), (4, "unknown")], "query_id long, text string")
    assert {r["doc_id"] for r in index.search(asked).collect()} == {3} and index.documents() == 3
    assert ret.lexical_index(frame.limit(0)).search(asked).count() == 0
    assert index.search(asked.limit(0)).count() == 0


def test_the_index_is_read_once_and_for_the_words_asked(spark, monkeypatch):
    docs = [(i, t + f" only{'abcdefghij'[i % 10]}") for i, t in corpus(60, 6)]
    index = ret.lexical_index(spark.createDataFrame([(*r, "x") for r in docs], KIND))
    asked = [(1, "onlya onlyb"), (2, "onlyc unknown")]
    reads = []
    blocks = postings.PostingIndex.blocks
    monkeypatch.setattr(postings.PostingIndex, "blocks", lambda self: reads.append(1) or blocks(self))
    found = hits(index.search(spark.createDataFrame(asked, "query_id long, text string"), k=5))
    assert len(reads) == 1
    for q, text in asked:
        same(found[q], okapi(docs, [(q, text)], 5)[q])
    words = spark.createDataFrame([("onlya",), ("unknown",)], "term string")
    assert [tuple(r) for r in index.frequency(words).collect()] == [("onlya", 6)]


def test_words_with_blanks_of_another_tokeniser(spark):
    tokens = lambda text: F.split(text, ",")
    docs = spark.createDataFrame([(1, "new york,rain"), (2, "new,york"), (3, "snow"), (4, "fog"), (5, "sun")], "doc_id long, text string")
    index = ret.lexical_index(docs, tokens=tokens)
    asked = spark.createDataFrame([(7, "new york")], "query_id long, text string")
    assert [r["doc_id"] for r in index.search(asked, tokens=tokens).collect()] == [1]

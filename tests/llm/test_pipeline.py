import random

import numpy as np
import pytest
from test_decontaminate import words_of
from test_secret_scan import base_spans
from test_simhash import brute

import corpus_pipeline
from insight_spark.llm import simhash


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"
    ]


def test_near_duplicate_stage_keeps_the_smallest_of_each_group(spark, small, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted({c for *_, c in brute(rows)})
    kept = corpus_pipeline.near_duplicates(spark, docs, small)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == want


def test_keep_one_of_repeated_and_null_rows(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(999)}" for _ in range(300))
    rows = [(2, long, 5), (2, long, 3), (None, long, 1), (None, "null only", 2), (None, "null only", 2), (2, "other text here", 7), (9, None, 0), (8, "", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, first long")
    got = sorted(map(tuple, simhash.keep_one(frame).collect()), key=repr)
    assert got == sorted([(2, long, 3), (None, "null only", 2), (2, "other text here", 7), (8, "", 0)], key=repr)
    assert simhash.keep_one(frame.limit(0)).count() == 0


def test_secret_stage_replaces_every_base_span(spark, small, docs):
    planted = [(-1, "my password: hunter2222, bye", "en", "x", 28), (-2, "AKIA" + "Q" * 16 + " é " + "0f" * 15, "en", "x", None)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    before = {r["doc_id"]: r for r in docs.collect()}
    after = {r["doc_id"]: r for r in corpus_pipeline.secrets(spark, docs, small).collect()}
    assert before.keys() == after.keys()
    changed = 0
    for doc_id, row in after.items():
        spans = base_spans(before[doc_id]["text"])
        changed += bool(spans)
        assert not base_spans(row["text"])
        assert (row["text"] == before[doc_id]["text"]) == (not spans)
        assert row["n_chars"] == (len(row["text"]) if spans else before[doc_id]["n_chars"])
    assert changed


def test_whole_run_equals_stage_by_stage(spark, small, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    packed = corpus_pipeline.run(spark, small).collect()
    stage = docs
    for _, function in corpus_pipeline.STAGES[:-1]:
        nxt = function(spark, stage, small)
        assert nxt.columns == docs.columns
        ids = {r["doc_id"] for r in nxt.select("doc_id").collect()}
        if function is corpus_pipeline.quality:
            assert np.mean([i in ids for i, good in labels.items() if good]) > 0.99
            assert np.mean([i in ids for i, good in labels.items() if not good]) < 0.2
        stage = spark.createDataFrame(nxt.collect(), docs.schema)
    assert {r["doc_id"] for r in packed} == ids
    items = [words_of(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for row in stage.collect():
        body = f" {' '.join(words_of(row['text']))} "
        assert not any(f" {' '.join(item)} " in body for item in items)
    used = {}
    for r in packed:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 2048


def test_stages_leave_clashing_columns_alone(spark, small):
    long = " ".join(f"w{i}" for i in range(40))
    kind = "doc_id long, text string, _text_key string, _drop_id int, _flag_id int, _cut int, meta map<string,int>"
    rows = [(1, long, "mine", 1, 2, 3, {"a": 1}), (1, long, "mine", 1, 2, 3, {"a": 1}), (2, "secret: abcdefgh", "x", 4, 5, 6, None), (3, long, "y", 7, 8, 9, None)]
    frame = spark.createDataFrame(rows, kind)
    kept = corpus_pipeline.near_duplicates(spark, frame, small)
    assert kept.columns == frame.columns
    got = sorted(map(tuple, kept.collect()))
    assert got == [rows[0], rows[2]]
    clean = corpus_pipeline.decontamination(spark, frame, small)
    assert clean.columns == frame.columns and sorted(map(repr, clean.collect())) == sorted(map(repr, frame.collect()))
    cut = corpus_pipeline.secrets(spark, frame, small)
    assert cut.columns == frame.columns and [r["_cut"] for r in cut.collect()] == [3, 3, 6, 9]

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from insight_spark.llm import quality_model as model


def plain_score(fitted, text):
    """One text at a time, pair by pair."""
    buckets, _, _ = model.features(pa.array([text or ""]), fitted.bits)
    total = sum(float(fitted.weights[b]) for b in buckets) / math.sqrt(max(len(buckets), 1))
    return 1 / (1 + math.exp(-(float(fitted.weights[-1]) + total)))


def test_features_of_texts_together_are_those_of_each():
    texts = ["a b a", "", "one", "x!! y", "  ", "é é é", "a b\nc\td", "***"]
    together, counts, words = model.features(pa.array(texts), 12)
    assert counts.tolist() == [5, 0, 1, 5, 0, 5, 7, 1] and words.tolist() == [3, 0, 1, 3, 0, 3, 4, 1]
    apart = [model.features(pa.array([t]), 12)[0] for t in texts]
    assert together.tolist() == np.concatenate(apart).tolist()
    assert together[3:5].tolist() != together[0:2].tolist()


def test_ftrl_step_follows_the_published_update():
    learner = model.Ftrl(3)
    z, n = np.zeros(3), np.zeros(3)
    rng = np.random.default_rng(0)
    for _ in range(50):
        at, values, label = np.array([0, 2]), rng.random(2), int(rng.integers(2))
        w = np.array([
            0.0 if abs(z[i]) <= model.L1 else
            -(z[i] - math.copysign(model.L1, z[i])) / ((model.BETA + math.sqrt(n[i])) / model.ALPHA + model.L2)
            for i in at
        ])
        p = 1 / (1 + math.exp(-float(values @ w)))
        for i, x, w_i in zip(at, values, w):
            g = (p - label) * x
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / model.ALPHA
            z[i] += g - sigma * w_i
            n[i] += g * g
        learner.learn(at, values, label)
    assert np.allclose(learner.z, z) and np.allclose(learner.n, n)


def corpus(rng, n):
    good = ["river", "stone", "walks", "slowly", "the", "a", "morning", "paper"]
    rows, labels = [], []
    for i in range(n):
        ok = i % 4 != 0
        words = [rng.choice(good) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words) if ok else " ".join(w + "$$$" for w in words)))
        labels.append((i, int(ok)))
    return rows, labels


def test_held_out_accuracy_and_edge_cases(spark):
    rows, labels = corpus(random.Random(1), 600)
    frame = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, vals string")
    truth = spark.createDataFrame([*labels, *labels[:50], (3, 0), (None, 1), (9, None)], "doc_id long, quality int")
    from insight_spark.llm.common import crc_bucket

    fitted = model.train(frame, truth, crc_bucket("doc_id", 5) != 0, sample=300)
    odd = spark.createDataFrame([(None, "a river"), (7, None), (7, None), (8, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in model.score(frame, fitted).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(dict(labels)[i]) for i in held]) > 0.97
    assert all(got[i] == pytest.approx(plain_score(fitted, t), abs=1e-6) for i, t in rows[:60])
    scored = model.score(odd, fitted).collect()
    assert len(scored) == 4 and all(0 <= r["score"] <= 1 for r in scored)
    kept = model.keep_good(frame, fitted)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i] >= 0.3}
    assert model.score(frame.limit(0), fitted).count() == 0


def test_same_model_whatever_the_partitions(spark):
    rows, labels = corpus(random.Random(2), 200)
    truth = spark.createDataFrame(labels, "doc_id long, quality int")
    fits = [
        model.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), truth, sample=90).weights
        for n in (1, 5)
    ]
    assert (fits[0] == fits[1]).all()


def test_without_labels_every_score_is_a_half(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    fitted = model.train(frame, spark.createDataFrame([], "doc_id long, quality int"))
    assert model.score(frame, fitted).first()["score"] == 0.5

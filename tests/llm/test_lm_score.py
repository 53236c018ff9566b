import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from insight_spark.llm import lm_score


def words_of(text):
    return re.findall(r"[^\W_]+|(?:_|[^\w\s])+", (text or "").lower())


def brute(rows, targets, least):
    """Score of every text, one word at a time."""
    def counted(texts):
        pairs, single = Counter(), Counter()
        for t in texts:
            words = words_of(t)
            pairs.update(zip(["\0", *words], words))
            single.update(words)
        return pairs, single

    every, all_words = counted([t for _, t in rows])
    listed = {pair for pair, n in every.items() if n >= least}
    known = {w for w, n in all_words.items() if n >= least}

    def model(texts):
        pairs, single = counted(texts)
        after, total = Counter(), sum(single.values()) + lm_score.ADDED * (len(known) + 1)
        for pair in listed:
            after[pair[0]] += pairs[pair]
        rare = sum(n for w, n in single.items() if w not in known)
        own = lambda w: ((single[w] if w in known else rare) + lm_score.ADDED) / total
        return lambda v, w: -math.log((pairs[v, w] * ((v, w) in listed) + lm_score.PRIOR * own(w)) / (after[v] + lm_score.PRIOR))

    target, background = model([t for d, t in rows if d in targets]), model([t for _, t in rows])
    out = []
    for d, t in rows:
        words = words_of(t)
        a, b = (sum(m(v, w) for v, w in zip(["\0", *words], words)) / max(len(words), 1) for m in (target, background))
        out.append((d, len(words), a, b, a - b))
    return out


def texts():
    rng = random.Random(1)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) + rng.choice(["", ",", "!!"]) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, " \n "), (None, "a1 b1"), (3, rows[3][1])]


@pytest.mark.parametrize("least, most", [(3, 1 << 20), (3, 10), (1, 0), (2, 50)])
def test_equals_brute_force(spark, least, most):
    """Also where most pairs and words are judged in joins."""
    rows = texts()
    frame = spark.createDataFrame([(d, t, 1.0, 2) for d, t in rows], "doc_id long, text string, score double, _target_id int").repartition(3)
    ids = spark.createDataFrame([(i,) for i in range(1, 40, 2)] + [(5,), (None,)], "doc_id long")
    models = lm_score.train(lm_score.mark_target(frame, ids), F.col("_target"), least=least)
    got = sorted(map(tuple, lm_score.score(frame, models, most_pairs=most, most_words=most).collect()), key=repr)
    want = sorted(brute(rows, set(range(1, 40, 2)), least), key=repr)
    assert len(got) == len(want)
    for x, y in zip(got, want):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], abs=1e-4)
    by_id = {r[0]: r[4] for r in got}
    unseen = range(40, 60)
    assert sum(by_id[i] for i in unseen if i % 2) < sum(by_id[i] for i in unseen if i % 2 == 0)
    assert lm_score.score(frame.limit(0), models).count() == 0


def test_probabilities_sum_to_one(spark):
    """Over all words of the vocabulary, after a frequent and a rare word."""
    rows = [(i, t) for i, t in texts() if i is not None]
    models = lm_score.train(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 2 == 0, least=3)
    words = {r["word"]: r for r in models.words.collect()}
    pairs = {r["pair"]: r for r in models.pairs.collect()}
    single = [w for w in words if w != lm_score.START]
    for before in [lm_score.START, *single[:3]]:
        for side in ("target", "background"):
            total = 0.0
            for w in single:
                key = before << 32 | w
                key -= (key >> 63) << 64
                loss = pairs[key][side] if key in pairs else words[w][f"own_{side}"] + words[before][f"after_{side}"]
                total += math.exp(-loss)
            # And the class of all other words.
            i = 0 if side == "target" else 1
            total += math.exp(-models.others[i] - words[before][f"after_{side}"])
            assert total == pytest.approx(1, abs=1e-6)


def test_the_models_grow_with_the_corpus(spark):
    sizes = []
    for count in (200, 800):
        rows = [(i, f"word{i} comes after word{i // 2} again word{i} comes word{i} comes") for i in range(count)]
        models = lm_score.train(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), least=2)
        sizes.append((models.words.count(), models.pairs.count()))
    assert sizes[1][0] > 3 * sizes[0][0] and sizes[1][1] > 3 * sizes[0][1]


def test_texts_outside_the_corpus(spark):
    rows = [(i, "a b c a b c a b c") for i in range(5)]
    models = lm_score.train(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), least=3)
    other = spark.createDataFrame([(1, "a b c"), (2, "zzz a yyy")], "doc_id long, text string")
    losses = {r["doc_id"]: r["target_loss"] for r in lm_score.score(other, models).collect()}
    assert losses[1] < losses[2] < 50


def test_without_target_or_texts(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    models = lm_score.train(frame, F.lit(None).cast("boolean"))
    assert math.isfinite(lm_score.score(frame, models).first()["score"])
    nothing = lm_score.train(frame.limit(0), F.lit(True))
    assert nothing.words.count() == 0 and lm_score.score(frame, nothing).first()["score"] == pytest.approx(0)
    with pytest.raises(ValueError):
        lm_score.mark_target(frame.withColumn("_target", F.lit(1)), frame)

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from insight_spark.llm import language_id as lang

PIECES = ["▁", "a", "b", "c", "▁a", "ab", "abc", "▁ab", "bc", "ca", "▁cab", "é"]


def sum_over_segmentations(word, probability):
    """Every way to cut the word, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for size in range(1, len(word) + 1):
        head = word[:size]
        p = probability.get(head, lang.UNKNOWN if size == 1 else None)
        if p is not None:
            total += p * sum_over_segmentations(word[size:], probability)
    return total


def random_model(languages=2):
    rng = np.random.default_rng(5)
    table = rng.random((len(PIECES), languages))
    return lang.Model([f"l{i}" for i in range(languages)], table / table.sum(0))


WORDS = ["a", "abc", "cabcab", "xyz", "éa", "bbbbb", "cab" * 3, "ab", "中文abc"]


def test_forward_pass_sums_every_segmentation():
    model, trie = random_model(), lang.build_trie(PIECES)
    got = lang.word_logs(pa.array(WORDS), trie, model)
    for word, logs in zip(WORDS, got):
        for k in range(2):
            table = dict(zip(PIECES, model.probability[:, k]))
            assert logs[k] == pytest.approx(math.log(sum_over_segmentations("▁" + word, table)))


def log_sum(word, table):
    """log of the sum over all segmentations of a word of any length."""
    alpha = [0.0]
    for end in range(1, len(word) + 1):
        terms = []
        for size in range(1, min(end, 4) + 1):
            p = table.get(word[end - size : end], lang.UNKNOWN if size == 1 else None)
            if p is not None:
                terms.append(alpha[end - size] + math.log(p))
        top = max(terms)
        alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return alpha[-1]


@pytest.mark.parametrize("long_chars", [1 << 20, 150, 40])
def test_long_words_sum_every_segmentation(monkeypatch, long_chars):
    """Words over the arrays' width, several at once and in windows, among short ones."""
    monkeypatch.setattr(lang, "LONG_CHARS", long_chars)
    model, trie = random_model(), lang.build_trie(PIECES)
    words = ["abcab" * 20, "ab", "x" * 33, "abc" * 11 + "é", "cab" * 400, "", "中" + "ab" * 60]
    got = lang.word_logs(pa.array(words), trie, model)
    for word, logs in zip(words, got):
        for k in range(2):
            table = dict(zip(PIECES, model.probability[:, k]))
            assert logs[k] == pytest.approx(log_sum("▁" + word, table))


def test_models_of_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(lang, "MODEL_BYTES", 100)
    frame = spark.createDataFrame([(1, "ab", "l0")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        lang.predict(frame, random_model(), PIECES)
    with pytest.raises(ValueError, match="languages"):
        lang.train(frame, PIECES * 20)


def test_expected_counts_are_posterior_sums():
    model, trie = random_model(1), lang.build_trie(PIECES)
    table = dict(zip(PIECES, model.probability[:, 0]))
    words, counts = ["▁abc", "▁cab", "▁xa"], np.array([[2.0], [1.0], [3.0]])
    want = dict.fromkeys(PIECES, 0.0)

    def walk(rest, weight, used):
        if not rest:
            return [(weight, used)]
        found = []
        for size in range(1, len(rest) + 1):
            p = table.get(rest[:size], lang.UNKNOWN if size == 1 else None)
            if p is not None:
                found += walk(rest[size:], weight * p, [*used, rest[:size]])
        return found

    for word, (n,) in zip(words, counts):
        ways = walk(word, 1.0, [])
        total = sum(w for w, _ in ways)
        for w, used in ways:
            for piece in used:
                if piece in want:
                    want[piece] += n * w / total
    got = lang._Lattice(pa.array(words), trie).expected(lang._with_unknown(model.probability), counts)[:-1, 0]
    assert np.allclose(got, [want[p] for p in PIECES])


def test_long_runs_of_rare_pieces_stay_finite():
    kana = [chr(c) for c in range(0x3042, 0x3062)]
    trie = lang.build_trie(["▁", *kana])
    # Two languages: none of the letters was seen among 1e13 pieces, and one was seen a few times.
    total = np.full((len(kana) + 1, 2), lang.SMOOTHING)
    total[0] = 1e13
    total[1, 1] = 1e5
    model = lang.Model(["x", "y"], lang._shares(total))
    assert np.allclose(model.probability.sum(0), 1) and model.probability.min() > 0.99 * lang.FLOOR
    word = "".join(kana[:31])
    logs = lang.word_logs(pa.array([word, kana[0], word * 5]), trie, model)
    want = [sum(math.log(model.probability[1 + kana.index(c), k]) for c in word) + math.log(model.probability[0, k]) for k in range(2)]
    assert np.allclose(logs[0], want) and np.isfinite(logs).all()
    best, share = lang._judged(pa.array([f"{word} {kana[0]}", kana[0]]), trie, model)
    assert best.tolist() == [1, 1] and np.isfinite(share).all()
    counts = lang._Lattice(pa.array(["▁" + word]), trie).expected(lang._with_unknown(model.probability), np.array([[0.0, 1e12]]))
    assert np.allclose(counts.sum(0), [0, 32e12])


def test_split_words():
    words, codes, counts = lang.split_words(pa.array(["Ab ab, 12 C'd", "", "!!", "é"]))
    flat = [words[int(c)].as_py() for c in codes]
    assert counts.tolist() == [4, 1, 1, 1] and flat == ["ab", "ab", "c", "d", "", "", "é"]


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers

    return lang.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_held_out_documents(spark, small, pieces):
    from insight_spark.llm.common import crc_bucket

    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = lang.train(docs, pieces, crc_bucket("doc_id", 3) != 1)
    assert model.languages == sorted(model.languages) and np.allclose(model.probability.sum(0), 1)
    held = docs.filter(crc_bucket("doc_id", 3) == 1).filter("length(text) > 30")
    rows = lang.predict(held, model, pieces).join(held, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edge_cases(spark, pieces):
    text = {"en": "the house of the river and the stone", "de": "das haus und der fluss und der stein"}
    rng = random.Random(0)
    train = [(" ".join(rng.choices(t.split(), k=20)), k, 1) for k, t in text.items() for _ in range(10)]
    train += [(None, "en", 2), ("ohne sprache", None, 3), ("", "de", 4)]
    frame = spark.createDataFrame(train, "text string, lang string, n int")
    model = lang.train(frame, pieces)
    assert model.languages == ["de", "en"]
    odd = [(1, None), (2, ""), (3, "12 !! 中"), (4, "12 !!"), (None, "the stone"), (6, "der stein"), (6, "der stein")]
    found = lang.predict(spark.createDataFrame(odd, "doc_id long, text string"), model, pieces).collect()
    got = {(r["doc_id"], r["lang_pred"]) for r in found}
    assert len(found) == 7 and {(1, "und"), (2, "und"), (4, "und"), (None, "en"), (6, "de")} <= got
    nothing = lang.train(frame.limit(0), pieces)
    assert nothing.languages == []
    assert lang.predict(frame.selectExpr("n AS doc_id", "text"), nothing, pieces).filter("lang_pred <> 'und'").count() == 0
    assert lang.predict(frame.limit(0).selectExpr("n AS doc_id", "text"), model, pieces).count() == 0

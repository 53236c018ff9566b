import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from insight_spark.llm import queries, spelling


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def edits(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters)


def brute(counts):
    letters = sorted({c for w in counts for c in w})
    rows = {}
    for word, n in counts.items():
        near = {e for e in edits(word, letters) if e in counts and e != word}
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        rows[word] = (form, n, len(near), counts.get(form))

    def root(word):
        while rows[word][0] is not None:
            word = rows[word][0]
        return word

    return sorted((w, f, root(w), n, k, fn) for w, (f, n, k, fn) in rows.items())


def made(seed, count, letters="abé", longest=9):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))): 2 ** rng.randrange(12) + rng.randrange(3) for _ in range(count)}


def found(spark, counts, parts=3):
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(parts)
    return sorted(tuple(r) for r in spelling.variants(frame).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_equals_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.QUERIES["op11_spelling"](spark, small)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute(brute_words(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_vocabulary_of_few_letters(spark, seed):
    counts = made(seed, 700)
    got = found(spark, counts)
    assert got == brute(counts) and any(r[1] and r[2] != r[1] for r in got)


def test_blocks_cut_into_parts_and_small_indexes(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART", 7)
    monkeypatch.setattr(spelling, "INDEX_WORDS", 20)
    counts = made(3, 400, "ab", 8)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    groups = {}
    for r in spelling._blocks(words).collect():
        groups.setdefault((r["shorter"], r["block"], r["part"], r["other"]), []).append(tuple(r[c] for c in ("shorter", "block", "part", "other", "ahead", "role", "word", "n")))
    assert max(r[2] for r in groups) > 0
    near = Counter()
    for group in groups.values():
        for word, n in zip(*spelling._match([group])[:2]):
            near[word] += n
    assert {w: near[w] for w in counts} == {w: k for w, _, _, _, k, _ in brute(counts)}
    assert found(spark, counts) == brute(counts)


def test_long_words_ties_and_chains(spark):
    long = "abcde" * 20_000
    counts = {long: 9, long + "x": 2, long[:500] + long[501:]: 3, "house": 8, "mouse": 8, "louse": 3, "lousey": 1, "Ünder".lower(): 5, "Ünder": 2, "aaaaa": 1, "aaaa": 1, "aaaaaa": 1}
    rows = {r[0]: r[1:] for r in found(spark, counts)}
    assert rows[long + "x"] == (long, long, 2, 1, 9) and rows[long][3] == 2
    assert rows["louse"][:2] == ("house", "house") and rows["lousey"][:2] == ("louse", "house")
    assert rows["aaaaa"][3] == 2 and rows["aaaaa"][0] is None


def test_near_sets_are_the_edit_distance():
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(4, 6))) for _ in range(150)]
    index = spelling.PositionIndex(words)
    for query in words[:40]:
        letters = np.frombuffer(query.encode(), np.uint8).astype(np.int64)[None]
        for shorter in (len(query), len(query) - 1):
            near, _ = spelling.near_sets(index, letters, shorter, shorter // 2)
            bits = np.unpackbits(near.view(np.uint8), bitorder="little")[: len(words)]
            one = set(edits(query, "abc"))
            want = [w in one and w != query and min(len(w), len(query)) == shorter for w in words]
            assert bits.astype(bool).tolist() == want


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(None, "Straße straße straße", "a"), (1, None, "b"), (2, "", "c"), (3, "12 ×÷ _ abcd", "d")] + [(9, "grosse GROSSE grosse grosse", "e")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, word string")
    words = spelling.vocabulary(spelling.runs(frame, "text", "doc_id").select(spelling.misspell("doc_id").alias("run")))
    got = sorted(tuple(r) for r in spelling.variants(words.withColumn("block", F.lit(1)).withColumn("root", F.lit("x"))).collect())
    assert got == brute(brute_words([r[:2] for r in rows])) and got
    empty = spelling.variants(words.limit(0))
    assert empty.count() == 0

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from insight_spark.llm import pattern_packing as packing
from insight_spark.llm import simple8b, tokens


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


ODD = [
    "", " ", "a", "Hello, world.\nThe end.", "a  b", "a \n b", "\n\nx\n\ny ", "it's don't 's", "1 23  x1", "İstanbul İ.", "é́!",
    "a\x00b c", "<|endoftext|> x", "tab\there", "中文 字，", "　 x  y", "x́ ≠ y", "🙂🙂 ok", "a  b", "\x85\n \x1c z",
    "J\u030c j\u030c H\u0331 T\u0308", "ÀÉ SHOUT Mixed.Case,Word\nNext.\nLine", "I\u0307 K\u212a", "dž Dž DŽ ẞ ΑΣ Σ",
    "Plain WORDS beside e\u0301", "CAPS.\u0301 And SoOn, A B",
]


def test_ids_equal_the_library(paths):
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 8))) for _ in range(2000)]
    for path in paths:
        memory = tokens.Tokens(path)
        for part in (texts[:500], texts[500:], texts[:100]):
            ids, counts = memory.encode(pa.array(part, pa.string()))
            want = [memory.tokenizer.encode(t, add_special_tokens=False).ids for t in part]
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_added_tokens_are_the_librarys(paths):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", " <|endoftext|> ", "\n", "end.", "Next", "a  b"]
    texts = ["end.<|endoftext|>Next", *["".join(rng.choice(marks) for _ in range(rng.randint(1, 6))) for _ in range(500)]]
    for path, wanted in zip(paths, ([437, 13, 50256, 10019], [806, 269, 49407, 1131])):
        library = Tokenizer.from_file(path)
        ids, counts = tokens.Tokens(path).encode(pa.array(texts, pa.string()))
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got[0] == wanted and got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_memory_starts_anew(paths, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    memory = tokens.Tokens(paths[0])
    for _ in range(3):
        ids, counts = memory.encode(pa.array(ODD))
        assert ids.tolist() == [i for t in ODD for i in memory.tokenizer.encode(t, add_special_tokens=False).ids]


def test_least_squares_meets_the_optimality_conditions():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12) * 3 - 0.5
        x = packing.nonnegative_least_squares(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient <= 1e-6).all() and np.allclose(gradient[x > 0], 0, atol=1e-6)


def test_patterns_fill_a_sequence():
    patterns = packing.full_patterns(24)
    assert len(set(patterns)) == len(patterns) and all(sum(p) == 24 and list(p) == sorted(p, reverse=True) for p in patterns)
    brute = {tuple(sorted((i, j, 24 - i - j), reverse=True)) for i in range(1, 24) for j in range(1, 24 - i)}
    assert brute <= set(patterns)


def check_plan(histogram, limit):
    plan = packing.make_plan(histogram, limit)
    used = defaultdict(list)
    for length, count in histogram.items():
        sequence, offset = packing.place(plan, np.full(count, length), np.arange(count))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            used[s].append((o, length))
    assert sorted(used) == list(range(plan.sequences))
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= limit
    return plan.sequences


def test_plans_are_gapless_and_short():
    rng = random.Random(9)
    for limit in (16, 100, 2048):
        for _ in range(15):
            kinds = rng.randint(1, 30)
            histogram = {rng.randint(1, limit): rng.randint(1, 60) for _ in range(kinds)}
            total = -(-sum(k * v for k, v in histogram.items()) // limit)
            made = check_plan(histogram, limit)
            greedy = sum(packing._best_fit(dict(histogram), {}, limit).values())
            assert total <= made <= 1.1 * greedy + 2
    assert check_plan({2048: 1000}, 2048) == 1000
    assert check_plan({1: 5000}, 2048) == 3
    assert packing.make_plan({}, 2048).sequences == 0


def test_many_documents_cost_no_more(paths):
    rng = random.Random(1)
    histogram = {k: rng.randint(1, 10**9) for k in range(1, 2049)}
    plan = packing.make_plan(histogram)
    total = sum(k * v for k, v in histogram.items())
    assert plan.sequences <= 1.02 * total / 2048
    for length in (1, 777, 2048):
        ranks = np.array([0, histogram[length] - 1])
        sequence, offset = packing.place(plan, np.full(2, length), ranks)
        assert (sequence < plan.sequences).all() and (offset + length <= 2048).all()


def corpus():
    rng = random.Random(8)
    words = [f"word{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 200, 900, 3000])))) for i in range(60)]
    return [*rows, rows[3], (None, "null id"), (None, "null id"), (70, None), (71, ""), *[(100 + i, "same text") for i in range(50)]]


def frame_of(spark, rows, parts=5):
    return spark.createDataFrame([(d, t, 0, 9) for d, t in rows], "doc_id long, text string, piece int, length long").repartition(parts)


def test_packing_documents(spark, paths):
    rows = corpus()
    got = packing.pack_documents(frame_of(spark, rows), paths[0]).collect()
    library = tokens.Tokens(paths[0]).tokenizer
    want, total = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 2048
    assert len(used) <= -(-total // 2048) + 3
    assert packing.pack_documents(frame_of(spark, rows).limit(0), paths[0]).count() == 0


def blocks():
    rng = np.random.default_rng(1)
    yield rng.integers(0, 1 << 16, (20, simple8b.BLOCK))
    yield rng.integers(0, 1 << 32, (10, simple8b.BLOCK))
    yield np.zeros((3, simple8b.BLOCK))
    yield np.full((2, simple8b.BLOCK), (1 << 32) - 1)
    yield rng.integers(0, 1 << 32, (30, simple8b.BLOCK)) >> rng.integers(0, 32, (30, simple8b.BLOCK))
    yield rng.choice([0, 1, 2, 14, 15, 16, 254, 255, 4095, 32766, 32767, (1 << 20) - 1, (1 << 30) - 1, 1 << 30], (40, simple8b.BLOCK))
    yield np.zeros((0, simple8b.BLOCK))


def test_words_round_trip():
    for ids in blocks():
        ids = ids.astype(np.uint32)
        coded = simple8b.encode(ids)
        assert (simple8b.decode(coded) == ids).all()
        assert coded.words_per_block.sum() == len(coded.words) and coded.escapes_per_block.sum() == len(coded.escapes)
        # A block is decoded from its own words alone.
        if len(ids) > 3:
            w, e = np.cumsum(coded.words_per_block), np.cumsum(coded.escapes_per_block)
            one = simple8b.Coded(coded.words[w[1] : w[2]], coded.words_per_block[2:3], coded.escapes[e[1] : e[2]], coded.escapes_per_block[2:3])
            assert (simple8b.decode(one)[0] == ids[2]).all()


def test_a_word_holds_what_its_selector_says():
    ids = np.zeros((1, simple8b.BLOCK), np.uint32)
    ids[0, :4] = [1, 2, 3, 40_000]
    coded = simple8b.encode(ids)
    first = int(coded.words[0])
    selector = first >> 60
    width = int(simple8b.WIDTHS[selector])
    values = [first >> k * width & (1 << width) - 1 for k in range(int(simple8b.COUNTS[selector]))]
    assert values[:3] == [1, 2, 3]


def test_files_round_trip(spark, paths):
    rows = corpus() + [(5000, "long " * 60_000)]
    rows.append((5001, "before<|endoftext|>After <|STARTOFTEXT|>"))
    got = simple8b.round_trip(frame_of(spark, rows, 7), paths[1]).collect()
    library = tokens.Tokens(paths[1]).tokenizer
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows}
    by_id = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_id] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in by_id] == [0, *np.cumsum([r["n_tokens"] for r in by_id])[:-1]]
    want = sorted((repr(d), zlib.crc32(np.array(ids[t], "<u4").tobytes()), len(ids[t])) for d, t in rows)
    assert sorted((repr(r["doc_id"]), zlib.crc32(r["ids"]), r["n_tokens"]) for r in got) == want
    assert simple8b.round_trip(frame_of(spark, rows).limit(0), paths[1]).count() == 0

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from insight_spark.llm import decontaminate as dec


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_overlap(doc, item):
    """Longest stretch over every alignment and every pair of ends."""
    best = 0
    for shift in range(-len(item) + 1, len(doc)):
        low, high = max(0, -shift), min(len(item), len(doc) - shift)
        equal = [doc[i + shift] == item[i] for i in range(low, high)]
        for a in range(len(equal)):
            for b in range(a, len(equal)):
                if equal[a] and equal[b] and 100 * sum(equal[a : b + 1]) >= dec.MIN_EQUAL * (b - a + 1):
                    best = max(best, b - a + 1)
    return best


def test_overlap_is_the_longest_stretch():
    rng = random.Random(1)
    for _ in range(300):
        doc = np.array([rng.randrange(3) for _ in range(rng.randint(0, 25))], np.uint64)
        item = np.array([rng.randrange(3) for _ in range(rng.randint(1, 12))], np.uint64)
        got = max((dec.overlap(doc, item, s) for s in range(-len(item) + 1, max(len(doc), 1))), default=0)
        assert got == brute_overlap(doc.tolist(), item.tolist())


def test_split_gives_the_words():
    texts = ["Ab, c-d 1x", "", " ", "é!É", "_a_"]
    words = dec.split(pa.array(texts))
    assert words.counts.tolist() == [4, 0, 0, 2, 1]
    assert words.hashes[4] == words.hashes[5] and len(words.hashes) == 7


def test_masks_and_filter():
    assert all(mask[0] == mask[-1] == "1" and mask.count("1") == 6 for mask in dec.MASKS)
    words = dec.split(pa.array(["a b c d e f g h i j k l", "a b"]))
    sown = list(dec.seeds(words))
    assert [len(place) for _, place in sown] == [5, 3, 1]
    bits = np.zeros(1 << (dec.FILTER_BITS - 6), np.uint64)
    assert not len(dec._passes(sown[0][0], bits))
    for bit in np.concatenate(list(dec._probes(sown[0][0][:2]))):
        bits[int(bit) >> 6] |= np.uint64(1) << (bit & np.uint64(63))
    assert dec._passes(sown[0][0], bits).tolist() == [0, 1]


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, draw(rng.randint(15, 50))) for i in range(20)]
    docs = []
    for i in range(60):
        body = draw(rng.randint(0, 300))
        if i % 3 == 0:
            item = list(items[i % 20][1])
            if i % 2:  # one word in seven is replaced
                item = ["other" if k % 7 == 3 else w for k, w in enumerate(item)]
            at = rng.randint(0, len(body))
            body = [*body[:at], *item, *body[at:]]
        if i % 10 == 1:  # too short a part to count
            body += items[0][1][:9]
        docs.append((i, ", ".join(w.title() if rng.random() < 0.2 else w for w in body)))
    return [(i, " ".join(w)) for i, w in items], docs


def test_equals_brute_force(spark, made):
    items, docs = made
    docs = [*docs, docs[0], (None, docs[3][1]), (900, None), (901, "")]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, items int, region string")
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "too short"), (3, "a b c d e f g h")], "item_id long, text string")
    got = sorted(map(tuple, dec.report(frame, bench).collect()), key=repr)
    want = []
    for doc_id, text in docs:
        doc, hit = words_of(text), {}
        for item_id, item in items:
            item = words_of(item)
            best = brute_near(doc, item)
            if best >= min(dec.MIN_OVERLAP, len(item)):
                hit[item_id] = best
        want.append((doc_id, bool(hit), sorted(hit), max(hit.values(), default=0)))
    assert got == sorted(want, key=repr)
    clean = dec.drop_contaminated(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, bad, *_ in want if not bad)


def brute_near(doc, item):
    """As ``brute_overlap``, only on alignments with six equal words, to save time."""
    best, d, t = 0, np.array(doc), np.array(item)
    for shift in range(-len(item) + 1, len(doc)):
        low, high = max(0, -shift), min(len(item), len(doc) - shift)
        if (d[low + shift : high + shift] == t[low:high]).sum() >= 6:
            best = max(best, dec.overlap(d, t, shift))
    return best


def test_empty_tables(spark, made):
    items, docs = made
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert dec.report(frame.limit(0), bench).count() == 0
    assert dec.report(frame, bench.limit(0)).filter("contaminated").count() == 0


def test_planted_passages(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {r["doc_id"]: words_of(r["text"]) for r in docs.collect()}
    items = [words_of(r["text"]) for r in bench.collect()]
    holds = {
        d for d, w in texts.items()
        if any(f" {' '.join(item)} " in f" {' '.join(w)} " for item in items)
    }
    flagged = {r["doc_id"] for r in dec.report(docs, bench).filter("contaminated").collect()}
    assert flagged == holds


def planted(rng, length, replaced):
    """An item and a text that holds it with so many inner words replaced."""
    item = [f"w{rng.randrange(400)}" for _ in range(length)]
    copy = list(item)
    for place in rng.sample(range(1, length - 1), replaced) if replaced else []:
        copy[place] = f"x{rng.randrange(400)}"
    before, after = ([f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 30))] for _ in range(2))
    return item, before + copy + after


def test_recall_by_item_length_and_replaced_words(spark):
    """Copies of every length are caught; with replaced words at least nine of ten, and all up to 13 words."""
    rng = random.Random(12)
    items, docs, kinds = [], [], {}
    for length in range(1, 31):
        for replaced in range(length // 5 + 1) if length > 4 else (0,):
            for _ in range(12):
                item, text = planted(rng, length, replaced)
                if length < 4:
                    item = [f"only{len(items)}{w}" for w in item]
                    text = [*text[: len(text) // 2], *item, *text[len(text) // 2 :]]
                kinds[len(items)] = (length, replaced)
                docs.append((len(items), " ".join(text)))
                items.append((len(items), " ".join(item)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    found = {r["doc_id"] for r in dec.report(frame, bench).collect() if r["doc_id"] in r["items"]}
    recall = {}
    for i, kind in kinds.items():
        recall.setdefault(kind, []).append(i in found)
    low = {kind: sum(hit) / len(hit) for kind, hit in recall.items() if sum(hit) < 0.9 * len(hit)}
    assert not low, low
    assert all(all(hit) for (length, replaced), hit in recall.items() if length <= dec.SHORT or not replaced)


def test_short_masks_meet_every_accepted_match():
    import itertools

    for length in range(1, dec.SHORT + 1):
        masks = dec.short_masks(length)
        assert all(len(mask) == length for mask in masks)
        for equal in itertools.product((0, 1), repeat=length):
            if equal[0] and equal[-1] and 100 * sum(equal) >= dec.MIN_EQUAL * length:
                assert any(all(e for e, sign in zip(equal, mask) if sign == "1") for mask in masks)


def test_other_texts_do_not_match_short_items(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(5, 12)))) for i in range(30)]
    docs = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(200))) for i in range(100)]
    got = {r["doc_id"]: sorted(r["items"]) for r in dec.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for doc_id, text in docs:
        words = words_of(text)
        want = [i for i, item in items if (n := len(words_of(item))) and any(
            words[s] == words_of(item)[0] and words[s + n - 1] == words_of(item)[-1]
            and 100 * sum(a == b for a, b in zip(words[s : s + n], words_of(item))) >= dec.MIN_EQUAL * n
            for s in range(len(words) - n + 1)
        )]
        assert got[doc_id] == want

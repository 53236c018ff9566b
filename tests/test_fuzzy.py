"""The letter index against difflib over all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from insight_spark.operators import fuzzy


def words(seed, count, letters="abcdefgh ", longest=14):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(count)})


def changed(text, rng, letters="abcdefgh "):
    out = list(text)
    for _ in range(rng.randint(0, max(1, len(text) // 4))):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
    return "".join(out)


def brute(probes, values, cutoff):
    out = {}
    for scope, probe in probes:
        scored = [(difflib.SequenceMatcher(None, v, probe).ratio(), v) for s, v in values if s == scope]
        best = max((r for r in scored if r[0] >= cutoff), default=None)
        if best:
            out[scope, probe] = (best[1], pytest.approx(best[0]))
    return out


def run(spark, probes, values, cutoff):
    left = spark.createDataFrame(probes, "scope string, probe string").repartition(3)
    right = spark.createDataFrame(values, "scope string, value string").repartition(3)
    return {(r["scope"], r["probe"]): (r["value"], r["ratio"]) for r in fuzzy.closest(left, right, cutoff).collect()}


@pytest.mark.parametrize("cutoff", [0.7, 0.75, 0.9, 1.0])
def test_any_two_strings_of_the_ratio_share_a_key(cutoff):
    rng = random.Random(int(cutoff * 100))
    order = {item: rng.randrange(50) for text in words(9, 40) for part in fuzzy._items(text) for item in part}
    checked = 0
    for text in words(1, 500, longest=30) + words(2, 200, "ab", 8) + words(3, 60, "abcdefghijklmnop", 80):
        other = changed(text, rng)
        if difflib.SequenceMatcher(None, other, text).ratio() >= cutoff:
            checked += 1
            assert set(fuzzy.keys(text, cutoff, order)) & set(fuzzy.keys(other, cutoff, order)), (text, other)
    assert checked > 50
    short = words(4, 300, "abc", 5)
    for a in short:
        found = set(fuzzy.keys(a, cutoff, order))
        for b in short:
            if difflib.SequenceMatcher(None, a, b).ratio() >= cutoff:
                assert found & set(fuzzy.keys(b, cutoff, order)), (a, b)


@pytest.mark.parametrize("few", [fuzzy.FEW_PAIRS, 0])
def test_equals_difflib(spark, monkeypatch, few):
    monkeypatch.setattr(fuzzy, "FEW_PAIRS", few)
    rng = random.Random(6)
    values = [(s, v) for s in "xy" for v in words(ord(s), 160, longest=24)] + [("x", "long " * 60 + "tail"), ("y", "")]
    probes = sorted({(s, changed(v, rng)) for s, v in values[::2]} | {("x", "zzzz"), ("x", ""), ("y", ""), ("z", "abc"), ("x", "long " * 59 + "tale")})
    assert run(spark, probes, values, 0.75) == brute(probes, values, 0.75)


def test_hot_keys_are_cut(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "KEY_PAIRS", 500)
    values = [("t", f"commonname{i:03d}") for i in range(150)]
    probes = [("t", f"commonname{i:03d}x") for i in range(0, 150, 5)]
    assert run(spark, probes, values, 0.75) == brute(probes, values, 0.75)
    left = spark.createDataFrame(probes, "scope string, probe string")
    right = spark.createDataFrame(values, "scope string, value string")
    pairs = fuzzy.candidates(left, right, 0.75, fuzzy._order(right))
    assert pairs.distinct().count() == len(probes) * len(values)


def test_candidates_grow_with_matches_and_not_with_pairs(spark):
    """Twice as many unlike strings on both sides: candidates of close matches stay a small share of the pairs."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(9, 16))) for _ in range(2000)]
    shares = []
    for count in (1000, 2000):
        right = spark.createDataFrame([("t", v) for v in made[:count]], "scope string, value string")
        left = right.select("scope", F.concat(F.substring("value", 1, 3), F.substring("value", 5, 99)).alias("probe"))
        pairs = fuzzy.candidates(left, right, fuzzy.CLOSE, fuzzy._order(right)).distinct().count()
        assert pairs >= count
        shares.append(pairs / count)
    assert shares[1] < 0.01 * 2000 and shares[1] < 2.5 * shares[0]


def test_nulls_repeats_and_empty_tables(spark):
    probes = [("t", "apple"), ("t", "apple"), (None, "apple"), ("t", None)]
    values = [("t", "apples"), ("t", "apples"), (None, "apple"), ("t", None)]
    assert run(spark, probes, values, 0.75) == {("t", "apple"): ("apples", pytest.approx(10 / 11))}
    empty = spark.createDataFrame([], "scope string, value string")
    asked = spark.createDataFrame(probes, "scope string, probe string")
    assert fuzzy.closest(asked, empty, 0.75).count() == 0
    assert fuzzy.closest(asked.limit(0), spark.createDataFrame(values, "scope string, value string"), 0.75).count() == 0

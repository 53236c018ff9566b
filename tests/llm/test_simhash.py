import random

import pytest

from insight_spark.llm import simhash
from insight_spark.llm.components import connected_components


def brute(rows, bits=3):
    """Fingerprints and components by comparing every pair."""
    prints = [simhash.fingerprint(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(
        ((d, f"{prints[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr
    )


def naive_fingerprint(text):
    import re

    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize(
    "text", [None, "", " \t\n", "One", "one Two", "Ärger im  Büro\x0bhier und da", "a b c " * 50]
)
def test_fingerprint_is_the_plain_majority(text):
    assert simhash.fingerprint(text) == naive_fingerprint(text)


def test_long_text_takes_the_same_majority():
    text = " ".join(random.Random(1).choice("abcdefgh") * 3 for _ in range(80_000))
    assert simhash.fingerprint(text) == naive_fingerprint(text)


def test_links_are_all_pairs_within_the_distance(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1]
    values = set(base)
    for value in base:
        for _ in range(15):
            flipped = value
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                flipped ^= 1 << bit
            values.add(flipped)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    for bits in (0, 1, 3, 5):
        got = {tuple(sorted(r)) for r in simhash.links(frame, bits).collect()}
        want = {
            tuple(sorted((a, b)))
            for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= bits
        }
        assert got == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    frame = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in connected_components(frame).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert got == want


def test_operator_matches_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, "null id " * 3), (5, None), (4, ""), (9, " \n"), (9, " \n"), (77, "one"), (78, "ONE")]
    for i in range(100, 130):
        text = [rng.choice(words) for _ in range(rng.randint(2, 400))]
        rows.append((i, " ".join(text)))
        text[rng.randrange(len(text))] = "changed"
        rows.append((i + 100, " ".join(text)))
        if i % 5 == 0:
            rows.append((i + 300, rows[-1][1]))
    frame = spark.createDataFrame(
        [(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, fp string, seg int, label int"
    )
    got = sorted(map(tuple, simhash.near_duplicates(frame).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0

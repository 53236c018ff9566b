"""Near words and their mutual information against plain counting."""

import math
import random
import re
import uuid
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from insight_spark.functions import fixed_values as fv
from insight_spark.operators import expansion


def tokens_of(text):
    return [w for w in re.findall("[a-z]{3,}", (text or "").lower()) if w not in fv.STOP_WORDS]


def brute(texts, window):
    pairs = Counter()
    for text in texts:
        words = tokens_of(text)
        for i, x in enumerate(words):
            for y in words[i + 1 : i + 1 + window]:
                if x != y:
                    pairs[min(x, y), max(x, y)] += 1
    return pairs


@pytest.mark.parametrize("tokens", [4_000_000, 40])
def test_pairs_and_information(spark, monkeypatch, tokens):
    monkeypatch.setattr(expansion, "TOKENS", tokens)
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "zeta"]
    texts = [" ".join(rng.choice(words[: 2 + i % 5]) for _ in range(rng.randrange(0, 25))) for i in range(60)] + ["", None, "alpha"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    want = brute(texts, 3)
    pairs = expansion.near_pairs(frame, window=3)
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == want
    total, sums = sum(want.values()), Counter()
    for (a, b), n in want.items():
        sums[a] += n
        sums[b] += n
    got = {(r["a"], r["b"]): r["pmi"] for r in expansion.mutual_information(pairs, 4).collect()}
    assert got.keys() == {p for p, n in want.items() if n >= 4}
    for (a, b), pmi in got.items():
        assert pmi == pytest.approx(math.log2(want[a, b] * 2 * total / (sums[a] * sums[b])), abs=1e-5)


def test_terms_that_belong_together(spark):
    rng = random.Random(3)
    filler = [f"{a}{b}word" for a in "abcdefgh" for b in "xyz"]
    texts = [" ".join([*rng.sample(filler, 8), *(["harbour", "vessel"] if i % 3 == 0 else ["meadow", "cattle"]), *rng.sample(filler, 8)]) for i in range(90)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    terms = expansion.expansion_terms(expansion.mutual_information(expansion.near_pairs(frame)), 1)
    found = {r["term"]: r["expansion"] for r in terms.collect()}
    assert found["harbour"] == "vessel" and found["cattle"] == "meadow"
    assert expansion.expansion_terms(expansion.mutual_information(expansion.near_pairs(frame.limit(0)))).count() == 0


def test_small_batches_are_counted_together(spark):
    # Forty batches of one document once gave forty partial counts of the pair.
    docs = spark.range(40).coalesce(1).selectExpr("'left right' AS text")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        pairs = expansion.near_pairs(docs)
        assert [tuple(r) for r in pairs.collect()] == [("left", "right", 40)]
        partial = expansion._partial_pairs(docs)
        assert [tuple(r) for r in partial.collect()] == [("left", "right", 40)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_cells_are_counted_in_passes_and_merged_in_parts(spark, monkeypatch):
    monkeypatch.setattr(expansion, "PAIRS", 300)
    monkeypatch.setattr(expansion, "BATCH", 7)
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in "abcdef" for b in "ghijk" for c in "lmn"]
    texts = [[rng.choice(words) for _ in range(rng.randrange(0, 90))] for _ in range(40)]
    batches = [b for half in (texts[:25], texts[25:]) for b in expansion._counted([pa.array(half, pa.list_(pa.string()))], 5, 4)]
    table = pa.Table.from_batches(batches)
    cells = [expansion._merged(table.filter(pc.equal(table["cell"], c))) for c in table["cell"].unique()]
    assert 1 < len(cells) <= 10
    rows = [r for cell in cells for b in expansion._rows(cell.to_batches()) for r in b.to_pylist()]
    want = brute([" ".join(t) for t in texts], 5)
    assert len(rows) == len(want) and {(r["a"], r["b"]): r["n"] for r in rows} == want
    assert sum(cell["n"][0].as_py() for cell in cells) == sum(want.values())


def test_pairs_from_elsewhere_are_packed_first(spark):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "abcdef" for b in "ghijk" for c in "lmn"]
    frame = spark.createDataFrame([(" ".join(rng.choices(words, k=60)),) for _ in range(50)], "text string")
    pairs = expansion.near_pairs(frame)
    want = {tuple(r) for r in expansion.mutual_information(pairs).collect()}
    assert want and {tuple(r) for r in expansion.mutual_information(pairs.repartition(3)).collect()} == want


def test_no_task_hands_on_its_pairs_at_once(spark, monkeypatch, tmp_path):
    # All pairs of four million words once left Python in one batch, each as two words and a number.
    frame = type(spark.range(0))
    plain = frame.mapInArrow

    def noted(self, run, kind):
        def noting(batches):
            for batch in run(batches):
                (tmp_path / uuid.uuid4().hex).write_text(str(batch.nbytes))
                yield batch

        return plain(self, noting, kind)

    monkeypatch.setattr(frame, "mapInArrow", noted)
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(40_000)]
    texts = [("harbour vessel " + " ".join(rng.choices(words, k=300)),) for _ in range(1200)]
    pairs = expansion.near_pairs(spark.createDataFrame(texts, "text string").coalesce(1))
    scored = expansion.mutual_information(pairs)
    assert {("harbour", "vessel", 1200)} <= {tuple(r)[:3] for r in scored.collect()}
    assert pairs.count() > 1_500_000
    assert max(int(note.read_text()) for note in tmp_path.iterdir()) < 16 << 20

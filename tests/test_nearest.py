"""Pivot search against brute force, and what its bounds leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from insight_spark.operators import nearest

KIND = "id long, scope string, embedding array<double>"


def brute(known, asked, k, scoped=False):
    ids = np.array([i for i, _, _ in known])
    matrix = np.array([v for _, _, v in known])
    out = {}
    for query, scope, vector in asked:
        scores = np.round(matrix @ np.array(vector), 6)
        order = [j for j in np.lexsort((ids, -scores)) if not scoped or known[j][1] == scope][:k]
        out[query] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def clustered(rows, clusters, seed=0, spread=0.05, width=8, scopes=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return [(i, f"s{i % scopes}", (centres[rng.integers(clusters)] + spread * rng.normal(size=width)).tolist()) for i in range(rows)]


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


def frames(spark, known, asked):
    left = spark.createDataFrame(known, KIND).repartition(4)
    right = spark.createDataFrame(asked, KIND).withColumnRenamed("id", "query_id").repartition(3)
    return left, right


@pytest.mark.parametrize("pivots", [None, 12])
def test_equals_brute_force_on_clusters(spark, pivots):
    known, asked = clustered(900, 10), clustered(70, 10, seed=1)
    left, right = frames(spark, known, asked)
    got = found(nearest.top_k(left, right, "id", "query_id", "embedding", 7, pivots=pivots, part_rows=40, query_rows=25))
    want = brute(known, asked, 7)
    assert got.keys() == want.keys()
    for query, hits in want.items():
        assert [i for i, _ in got[query]] == [i for i, _ in hits]
        assert [s for _, s in got[query]] == pytest.approx([s for _, s in hits], abs=2e-6)


def test_equals_brute_force_without_structure(spark):
    rng = np.random.default_rng(5)
    # Whole numbers, so that many scores tie; norms differ widely, and some vectors are zero.
    known = [(i, "s", (rng.integers(-2, 3, 5) * rng.choice([0, 1, 1, 30])).astype(float).tolist()) for i in range(500)]
    asked = [(i, "s", rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(40)]
    left, right = frames(spark, known, asked)
    got = found(nearest.top_k(left, right, "id", "query_id", "embedding", 9, pivots=15, part_rows=30, query_rows=10))
    assert got == brute(known, asked, 9)


def test_scopes_few_vectors_and_nulls(spark):
    known = clustered(300, 6, scopes=4) + [(900, "lone", [1.0] * 8)]
    asked = clustered(20, 6, seed=2, scopes=4) + [(500, "lone", [0.5] * 8), (501, "empty", [1.0] * 8)]
    left, right = frames(spark, known, asked)
    left = left.unionByName(spark.createDataFrame([(901, "s0", None)], KIND))
    for pivots in (None, 5):
        got = found(nearest.top_k(left, right, "id", "query_id", "embedding", 100, "scope", pivots=pivots, part_rows=30))
        want = {q: hits for q, hits in brute(known, asked, 100, True).items() if hits}
        assert {q: [i for i, _ in hits] for q, hits in got.items()} == {q: [i for i, _ in hits] for q, hits in want.items()}
    assert nearest.top_k(left.limit(0), right, "id", "query_id", "embedding", 3).count() == 0
    assert nearest.top_k(left, right.limit(0), "id", "query_id", "embedding", 3).count() == 0


def test_bounds_leave_out_most_cells_of_clustered_data(spark):
    known, asked = clustered(3000, 30), clustered(200, 30, seed=0)
    left, right = frames(spark, known, asked)
    search = nearest.Search(left, right, "id", "query_id", "embedding", 5, None, 50, 50, 40)
    first = search.first_cells()
    hits = search.scores(first)
    met = first.count() + search.further_cells(hits.groupBy("query").agg(F.slice(F.sort_array(F.collect_list("score"), False), 1, 5).alias("s")).select("query", F.explode("s").alias("score"))).count()
    assert met < 0.5 * search.cells.count() * len(asked)


def test_a_hot_cell_is_cut_into_parts_and_slices(spark):
    known = [(i, "s", [1.0, i / 1e6, 0.0]) for i in range(1500)] + [(5000 + i, "s", [0.0, 0.0, -50.0 - i]) for i in range(30)]
    asked = [(i, "s", [1.0, 0.1, 0.0]) for i in range(300)] + [(900, "s", [0.0, 0.0, -1.0])]
    left, right = frames(spark, known, asked)
    search = nearest.Search(left, right, "id", "query_id", "embedding", 3, None, 100, 60, 2)
    assert search.cells.agg(F.max("rows")).first()[0] == 1500
    vectors, queries = search.sides(search.first_cells())
    for side, most in ((vectors, 150), (queries, 90)):
        sizes = [r["count"] for r in side.groupBy(*nearest.GROUP).count().collect()]
        assert max(sizes) <= most and len(sizes) > 60
    got = found(nearest.top_k(left, right, "id", "query_id", "embedding", 3, pivots=2, part_rows=100, query_rows=60))
    assert got == brute(known, asked, 3)


def test_nothing_goes_through_the_driver():
    import inspect

    for module in (nearest,):
        assert "toPandas" not in inspect.getsource(module)

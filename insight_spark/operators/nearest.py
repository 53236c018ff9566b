"""Exact nearest vectors by dot product: pivots, bounds, and block products.

Vectors are assigned to the nearest of a few pivots, fitted on a bounded sample. A
cell (scope and pivot) is cut into parts of a few thousand vectors. A query first
meets the cells nearest to it, which gives it a score that its k-th hit cannot fall
below; of the other cells it meets only those whose bound
``min(q.p + |q| * radius, |q| * greatest norm)`` reaches that score. Where they meet,
one task multiplies a part with a bounded number of queries and keeps the best k.
Neither side passes through the driver, and no pair is written.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.operators.scale import BLOCK_CELLS, best_of_block, kept, top_n_per_group

# Vectors of a part, and queries that meet it in one task, at most (about).
PART_ROWS = 4096
QUERY_ROWS = 16_384
# Vectors the pivots are fitted on: at most so many and so many bytes.
SAMPLE_ROWS = 8192
SAMPLE_BYTES = 32 << 20
PIVOTS = 1024
# Cells whose bounds are sent to the executors (40 bytes each); with more scopes than that a scope is one cell.
CELLS = 200_000
# Scores are rounded to six digits before they are compared.
DIGITS = 6
SLACK = 1e-6


GROUP = ["scope", "cell", "part", "slice"]


class Cells(NamedTuple):
    """Bounds of the cells of one scope, by pivot number."""

    pivot: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    norm: np.ndarray


def top_k(
    corpus: DataFrame, queries: DataFrame, vector_id: str, query_id: str, vector: str, k: int,
    scope: str | None = None, part_rows: int = PART_ROWS, query_rows: int = QUERY_ROWS, pivots: int | None = None,
) -> DataFrame:
    """(query, vector id, score, rank): the ``k`` greatest dot products per query, ties to the smaller id.

    Null vectors neither ask nor answer; vectors of different widths are an error. With a
    ``scope`` a query meets only vectors of its scope.
    """
    search = Search(corpus, queries, vector_id, query_id, vector, k, scope, part_rows, query_rows, pivots)
    found = search.scores(search.first_cells())
    if search.pivots is not None:
        first = kept(top_n_per_group(found, ["query"], [F.desc("score"), F.col("id")], k), "first-hits")
        found = first.drop("rank").unionByName(search.scores(search.further_cells(first)))
    ranked = top_n_per_group(found, ["query"], [F.desc("score"), F.col("id")], k)
    return ranked.select(F.col("query").alias(query_id), F.col("id").alias(vector_id), "score", "rank")


class Search:
    """One search; ``first_cells`` and ``further_cells`` give the (query, scope, cell) that meet."""

    def __init__(self, corpus, queries, vector_id, query_id, vector, k, scope, part_rows, query_rows, pivots):
        self.spark, self.k, self.query_rows = corpus.sparkSession, k, query_rows
        self.id_type = corpus.schema[vector_id].dataType.simpleString()
        self.query_type = queries.schema[query_id].dataType.simpleString()
        asked = _rows(queries, query_id, vector, scope)
        widths = asked.select(F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if widths[0] != widths[1]:
            raise ValueError(f"query vectors of {widths[0]} and {widths[1]} numbers")
        self.width = widths[0] or 1
        known = _rows(corpus, vector_id, vector, scope, widths[0])
        total, scopes = known.agg(F.count("*"), F.approx_count_distinct("scope")).first()
        wanted = pivots if pivots is not None else min(PIVOTS, total // (2 * part_rows), CELLS // (2 * max(1, scopes)))
        self.pivots = fit_pivots(known, total, self.width, wanted) if wanted > 1 else None
        # All cores take part in a small search, too.
        self.part_rows = max(256, min(part_rows, total // self.spark.sparkContext.defaultParallelism))
        if pivots is not None:
            self.part_rows = part_rows
        self.known = kept(self._assigned(known, self.id_type), "vectors")
        self.asked = kept(self._assigned(asked, self.query_type), "queries") if self.pivots is not None else asked.withColumn("cell", F.lit(0))
        self.cells = kept(
            self.known.groupBy("scope", "cell").agg(
                F.count("*").alias("rows"), F.max("distance").alias("radius"), F.max("norm").alias("norm")
            ),
            "cells",
        )
        self.bounds = self._bounds() if self.pivots is not None else None

    def _assigned(self, rows: DataFrame, id_type: str) -> DataFrame:
        """With the nearest pivot as ``cell``, the distance to it and the norm."""
        pivots = self.pivots
        if pivots is None:
            return rows.withColumns({"cell": F.lit(0), "distance": F.lit(0.0), "norm": F.lit(0.0)})
        shared = self.spark.sparkContext.broadcast(pivots)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    matrix = _matrix(batch.column(2), shared.value.shape[1])
                    cell, distance = nearest_pivot(matrix, shared.value)
                    norm = np.sqrt((matrix**2).sum(1))
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(cell, pa.int32()), pa.array(distance), pa.array(norm)],
                        names=["id", "scope", "vector", "cell", "distance", "norm"],
                    )

        return rows.mapInArrow(run, f"id {id_type}, scope string, vector array<double>, cell int, distance double, norm double")

    def _bounds(self):
        found: dict[str, list] = {}
        for row in self.cells.orderBy("scope", "cell").toArrow().to_pylist():  # at most CELLS, see PIVOTS
            found.setdefault(row["scope"], []).append((row["cell"], row["rows"], row["radius"], row["norm"]))
        return self.spark.sparkContext.broadcast(
            {s: Cells(*(np.array(column) for column in zip(*rows))) for s, rows in found.items()}
        )

    def first_cells(self) -> DataFrame:
        """The nearest cells that together hold at least ``k`` vectors."""
        if self.pivots is None:
            return self.asked.select(F.col("id").alias("query"), "scope", "cell")
        return self._chosen(self.asked.withColumn("least", F.lit(None).cast("double")))

    def further_cells(self, hits: DataFrame) -> DataFrame:
        """All other cells that can hold a hit; ``hits`` are the first ones (query, score)."""
        least = hits.groupBy("query").agg(F.count("*").alias("hits"), F.min("score").alias("score")).select(
            F.col("query").alias("id"), F.when(F.col("hits") >= self.k, F.col("score")).otherwise(F.lit(-np.inf)).alias("least")
        )
        # A query whose scope holds no vector has no hits and nothing further to meet.
        return self._chosen(self.asked.join(least, "id"))

    def _chosen(self, asked: DataFrame) -> DataFrame:
        pivots, bounds, k = self.spark.sparkContext.broadcast(self.pivots), self.bounds, self.k

        def run(batches):
            for batch in batches:
                scopes = batch.column(1).to_pylist()
                least = batch.column(3).to_numpy(zero_copy_only=False)
                matrix = _matrix(batch.column(2), pivots.value.shape[1])
                for name in set(scopes) & set(bounds.value):
                    cells = bounds.value[name]
                    rows = np.flatnonzero([s == name for s in scopes])
                    for start in range(0, len(rows), max(1, BLOCK_CELLS // len(cells.pivot))):
                        some = rows[start : start + max(1, BLOCK_CELLS // len(cells.pivot))]
                        meets = cells_met(matrix[some], pivots.value, cells, k, least[some])
                        at, cell = np.nonzero(meets)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(some[at])), pa.array([name] * len(at), pa.string()), pa.array(cells.pivot[cell], pa.int32())],
                            names=["query", "scope", "cell"],
                        )

        return asked.select("id", "scope", "vector", "least").mapInArrow(run, f"query {self.query_type}, scope string, cell int")

    def sides(self, meeting: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The vectors and the queries of every GROUP: a part of a cell and a slice of the queries that meet it.

        A cell is cut by its own size and by the number of its queries, so no group outgrows a task.
        """
        met = kept(meeting, "meeting") if self.pivots is not None else meeting
        parts = F.ceil(F.col("rows") / self.part_rows).cast("int")
        slices = F.ceil(F.col("asking") / self.query_rows).cast("int")
        shape = kept(
            met.groupBy("scope", "cell").agg(F.count("*").alias("asking")).join(self.cells, ["scope", "cell"])
            .select("scope", "cell", parts.alias("parts"), slices.alias("slices")),
            "shape",
        )
        own_part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        own_slice = F.pmod(F.xxhash64("query", F.lit(1)), F.col("slices")).cast("int")
        left = self.known.join(shape, ["scope", "cell"]).select(
            "scope", "cell", own_part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "id", "vector"
        )
        vectors = self.asked.select(F.col("id").alias("query"), "vector")
        if self.pivots is None:
            placed = self.asked.select(F.col("id").alias("query"), "scope", "cell", "vector")
        else:
            placed = met.join(vectors, "query")
        right = placed.join(shape, ["scope", "cell"]).select(
            "scope", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), own_slice.alias("slice"), "query", "vector"
        )
        return left, right

    def scores(self, meeting: DataFrame) -> DataFrame:
        """(query, id, score): the best ``k`` of every part for each query that meets its cell."""
        left, right = self.sides(meeting)
        width, k = self.width, self.k

        def multiply(known: pa.Table, asked: pa.Table) -> pa.Table:
            best = None
            if known.num_rows and asked.num_rows:
                matrix, wanted = _matrix(known["vector"], width), _matrix(asked["vector"], width)
                ids = np.array(known["id"].to_pylist())
                step = max(1, BLOCK_CELLS // len(matrix))
                for start in range(0, len(wanted), step):
                    some = np.arange(start, min(len(wanted), start + step))
                    block = np.round(wanted[some] @ matrix.T, DIGITS)
                    part = best_of_block(block, some, ids, k, -np.inf)
                    best = part if best is None else tuple(np.concatenate(pair) for pair in zip(best, part))
            probe, hit, score = best if best is not None else (np.empty(0, np.int64), np.empty(0, object), np.empty(0))
            return pa.table({
                "query": asked["query"].take(pa.array(probe)), "id": pa.array(hit.tolist(), known["id"].type), "score": pa.array(score, pa.float64()),
            })

        return left.groupBy(*GROUP).cogroup(right.groupBy(*GROUP)).applyInArrow(
            multiply, f"query {self.query_type}, id {self.id_type}, score double"
        )


def _rows(df: DataFrame, key: str, vector: str, scope: str | None, width: int | None = None) -> DataFrame:
    in_scope: Column = F.col(scope).cast("string") if scope else F.lit("")
    values = F.col(vector).cast("array<double>")
    if width:  # a vector of another width is an error and not a silent miss
        values = F.when(F.size(vector) == width, values).otherwise(
            F.raise_error(F.concat(F.lit(f"a vector of other than {width} numbers: "), F.size(vector).cast("string")))
        )
    return df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), in_scope.alias("scope"), values.alias("vector"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = pc.list_flatten(column)
    return flat.to_numpy().reshape(-1, width) if isinstance(flat, pa.ChunkedArray) else flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def fit_pivots(rows: DataFrame, total: int, width: int, count: int) -> np.ndarray:
    """At most ``count`` centres by a few rounds of k-means on a sample of at most SAMPLE_ROWS vectors."""
    size = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    share = min(1.0, 1.1 * size / max(1, total))
    chosen = F.pmod(F.xxhash64("id", "scope"), F.lit(1_000_000)) < int(share * 1_000_000) + 1
    sample = _matrix(rows.filter(chosen).limit(size).select("vector").toArrow()["vector"], width)
    sample = np.unique(sample[np.isfinite(sample).all(1)], axis=0)
    if not len(sample):
        return np.zeros((1, width))
    centres = sample[np.random.default_rng(0).permutation(len(sample))[:count]]
    for _ in range(8):
        cell, _ = nearest_pivot(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        sizes = np.bincount(cell, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def nearest_pivot(matrix: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest pivot and the distance to it; a vector that is not finite has the distance NaN."""
    cell = np.empty(len(matrix), np.int64)
    step = max(1, BLOCK_CELLS // len(pivots))
    for start in range(0, len(matrix), step):
        some = matrix[start : start + step]
        cell[start : start + step] = ((pivots**2).sum(1) - 2 * some @ pivots.T).argmin(1)
    return cell, np.sqrt(((matrix - pivots[cell]) ** 2).sum(1))


def cells_met(queries: np.ndarray, pivots: np.ndarray, cells: Cells, k: int, least: np.ndarray) -> np.ndarray:
    """Which query meets which cell: where ``least`` is null the first ones, else those beside them that reach ``least``."""
    centres = pivots[cells.pivot]
    norms = np.sqrt((queries**2).sum(1))
    products = queries @ centres.T
    away = (centres**2).sum(1) - 2 * products
    order = np.argsort(away, axis=1, kind="stable")
    before = np.cumsum(cells.rows[order], axis=1) - cells.rows[order]
    first = np.zeros(away.shape, bool)
    np.put_along_axis(first, order, before < k, axis=1)
    bound = np.minimum(products + norms[:, None] * cells.radius, norms[:, None] * cells.norm)
    bound += SLACK * (1 + np.abs(bound))
    further = ~(bound < least[:, None]) & ~first
    return np.where(np.isnan(least)[:, None], first, further)

"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from insight_spark.llm.common import kept_table


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long); the label is the component's smallest node.

    Alternates large-star and small-star steps until the edges no longer change.
    Every round is written to the shared folder, so the lineage stays short and
    survives lost executors. An edge with a null end and a loop are no edges; an
    empty list gives no rows.
    """
    current = kept_table(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(),
        "edges",
    )
    before = _state(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        current = kept_table(_small_star(_large_star(current)), "edges")
        after = _state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (
        current.select(F.col("a").alias("node"), F.col("b").alias("label"))
        .unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("label")))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the smallest one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

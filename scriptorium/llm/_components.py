"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import hot_join, materialize


def _pointed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end."""
    return (
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _fingerprint(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is its component's
    smallest node.

    Alternates large-star and small-star rounds until nothing changes; the number
    of rounds is logarithmic in practice.  Each round is written to the shared
    folder.  Per-node state is a minimum, so a node with very many neighbours is
    pre-aggregated before it is shuffled; its edges are not gathered by the join.
    """
    now = materialize(_pointed(edges), "edges")
    mark = _fingerprint(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n")), "edges")
        large = hot_join(both, least, ["a"], "inner").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _pointed(large)
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select("b", "m", "a")
        after = materialize(
            _pointed(
                small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                    small.select("a", F.col("m").alias("b"))
                )
            ),
            "edges",
        )
        new = _fingerprint(after)
        if new == mark:
            break
        now, mark = after, new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def with_least(nodes: DataFrame, name: str, roots: DataFrame) -> DataFrame:
    """``nodes(name, least, n)`` with the smallest ``least`` of each component in ``roots``."""
    roots = roots.withColumnRenamed("node", name)
    owned = materialize(nodes.join(roots, name, "left").withColumn("root", F.coalesce("root", name)), "owned")
    of_all = owned.groupBy("root").agg(F.min("least").alias("of_all"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    found = hot_join(owned.withColumnRenamed("n", "rows"), materialize(of_all, "of_all"), ["root"])
    return materialize(found.select(name, F.when(F.col("of_all").isNull(), F.col("least")).otherwise(F.col("of_all")).alias("least"), F.col("rows").alias("n")), "owners")

"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapescreen.sources.store import stage


#: Parts of a key's rows in a join on names that many rows may share.
SALTS = 16


def salted_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a key that any number of rows of ``many`` may share; ``few`` has each key once.

    A merge join, as the copies of ``few`` are larger in memory than their shuffle files tell.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return (
        many.withColumn("salt", (F.rand(7) * SALTS).cast("int"))
        .join(few.withColumn("salt", salts).hint("merge"), [key, "salt"], how)
        .drop("salt")
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; nodes of one component share a root.

    In each round every node hooks onto the smallest of itself and its neighbours, and edges
    between hooked nodes remain.  With numbers that are in no order along paths, such as hashes, the
    nodes that still have edges become fewer by a constant share each round.
    """
    edges = stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stage(both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("node"), F.least("a", "low").alias("low")
        ), "hooks")
        if labels is None:
            labels = hooks.withColumnRenamed("low", "root")
        else:
            moved = salted_join(labels, hooks.withColumnRenamed("node", "root"), "root", "left")
            labels = stage(moved.select("node", F.coalesce("low", "root").alias("root")), "labels")
        at_a = salted_join(edges, hooks.select(F.col("node").alias("a"), F.col("low").alias("x")), "a")
        at_b = salted_join(at_a, hooks.select(F.col("node").alias("b"), F.col("low").alias("y")), "b")
        edges = stage(
            at_b.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels

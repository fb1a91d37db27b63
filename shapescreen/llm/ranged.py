"""Rows in a global order, and what lies before each range of them, without a global window.

A range shuffle puts rows in order; each row keeps the number of its partition in a stored table, so
a later recomputation can't deal rows anew.  Totals per partition and group, one row each, give every
partition what lies before it.  A group that fills many partitions is no hot key: rows and totals
meet on (partition, group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapescreen.sources.store import stage


def in_ranges(rows: DataFrame, order: list, name: str) -> DataFrame:
    """The rows with ``part``, the number of their range in the given order, stored."""
    return stage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)


def before_parts(rows: DataFrame, group: str, sums: dict[str, Column]) -> DataFrame:
    """``part, group`` and for each sum ``<name>_before``, the sum over the group's earlier parts,
    and ``<name>_all``, the sum over the group: one row per part and group."""
    totals = rows.groupBy("part", group).agg(*(F.sum(c).cast("long").alias(n) for n, c in sums.items()))
    own = Window.partitionBy(group)
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "part",
        group,
        *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in sums),
        *(F.sum(n).over(own).alias(f"{n}_all") for n in sums),
    )


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """The rows with ``nth``, counted from 0 in the given order over the whole table."""
    parts = in_ranges(rows, order, name).withColumn("whole", F.lit(0))
    starts = before_parts(parts, "whole", {"rows": F.lit(1)})
    running = Window.partitionBy("part").orderBy(*order)
    return (
        parts.withColumn("own", F.row_number().over(running) - 1)
        .join(starts, "part")
        .withColumn("nth", F.col("rows_before") + F.col("own"))
        .select(*rows.columns, "nth")
    )

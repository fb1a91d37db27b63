"""Exact ranks and running counts without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapescreen.functions import bands
from shapescreen.functions.bands import clean_score, with_bands
from shapescreen.sources.store import stage

_BEFORE = (Window.unboundedPreceding, -1)


def _running(column: Column, window) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(*_BEFORE)), F.lit(0))


def banded(hist: DataFrame, group: list[str]) -> DataFrame:
    """A histogram, stored, with the ``band`` and ``fine`` part of each score.

    Beyond one band it is dealt by group and band to one task for about BAND_ROWS rows, which all later
    windows and sums keep to, so that what a task sorts at once does not grow with the histogram.
    """
    hist = stage(hist, "histogram")
    rows = hist.count()
    placed = with_bands(hist, rows)
    if rows <= bands.BAND_ROWS:
        return placed
    tasks = max(int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // bands.BAND_ROWS))
    return placed.repartition(tasks, *group, "band")


def score_histogram(
    scores: DataFrame, group: list[str], score: str = "score", truth: str = "truth"
) -> DataFrame:
    """Rows and positives per distinct score of a group, with the score's band.

    Equal scores are combined before the shuffle, so a score shared by very
    many rows costs one row per task.
    """
    value = clean_score(F.col(score))
    return banded(
        scores.select(*group, value.alias("score"), F.col(truth).cast("bigint").alias("truth"))
        .groupBy(*group, "score")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("truth").alias("pos")),
        group,
    )


def prefix_counts(hist: DataFrame, group: list[str]) -> DataFrame:
    """Add counts of all rows with a lower score, and the totals of the group.

    Adds ``n_before``, ``pos_before``, ``n_total`` and ``pos_total``.
    """
    over_bands = Window.partitionBy(*group).orderBy("band")
    whole = Window.partitionBy(*group)
    offsets = (
        hist.groupBy(*group, "band")
        .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        .select(
            *group,
            "band",
            _running(F.col("n"), over_bands).alias("n_offset"),
            _running(F.col("pos"), over_bands).alias("pos_offset"),
            F.sum("n").over(whole).alias("n_total"),
            F.sum("pos").over(whole).alias("pos_total"),
        )
    )
    in_band = Window.partitionBy(*group, "band").orderBy("score")
    local = hist.select(
        *group,
        "band",
        "fine",
        "score",
        "n",
        "pos",
        _running(F.col("n"), in_band).alias("n_local"),
        _running(F.col("pos"), in_band).alias("pos_local"),
    )
    # Both sides are partitioned by group and band already.  A merge join keeps it so; sizes
    # estimated from the source files say nothing about the number of scores.
    return local.join(offsets.hint("merge"), [*group, "band"]).select(
        *group,
        "band",
        "fine",
        "score",
        "n",
        "pos",
        (F.col("n_offset") + F.col("n_local")).alias("n_before"),
        (F.col("pos_offset") + F.col("pos_local")).alias("pos_before"),
        "n_total",
        "pos_total",
    )


def numbered(
    rows: DataFrame,
    group: list[str],
    cell: str,
    order: list,
    name: str = "rn",
    carry: DataFrame | None = None,
    carry_on: list[str] | None = None,
) -> DataFrame:
    """``row_number`` (from 1) within a group, computed cell by cell.

    ``cell`` must not decrease along ``order``.  Each window holds one cell, or
    one number per cell of a group, never a whole group.  ``carry`` adds columns
    of a per-group table; they travel with the cells, so that rows of a large
    group are not joined on the group key alone.
    """
    over_cells = Window.partitionBy(*group).orderBy(cell)
    offsets = (
        rows.groupBy(*group, cell)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, cell, _running(F.col("_n"), over_cells).alias("_offset"))
    )
    if carry is not None:
        offsets = offsets.join(carry, carry_on or group)
    in_cell = Window.partitionBy(*group, cell).orderBy(*order)
    return (
        rows.withColumn("_local", F.row_number().over(in_cell))
        .join(offsets.hint("merge"), [*group, cell])
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_local", "_offset")
    )


def from_above(counted: DataFrame) -> DataFrame:
    """Turn counts of lower scores into counts of higher scores."""
    return counted.withColumns(
        {
            "n_before": F.col("n_total") - F.col("n_before") - F.col("n"),
            "pos_before": F.col("pos_total") - F.col("pos_before") - F.col("pos"),
        }
    )


def average_ranks(counted: DataFrame, group: list[str]) -> DataFrame:
    """Mean rank from below of each distinct score of a group, ties sharing one rank."""
    return counted.select(
        *group,
        "score",
        "n",
        "pos",
        (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias("avg_rank"),
    )


def top_k(scores: DataFrame, group: list[str], k: int, identifier: str = "mol_id") -> DataFrame:
    """The k best rows of each group.  Spark trims to k per task before the shuffle."""
    window = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc(identifier))
    return scores.withColumn("position", F.row_number().over(window)).filter(
        F.col("position") <= k
    )

"""Views and reports over packed molecule rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CELL = 1 << 16


def conformers(molecules: DataFrame) -> DataFrame:
    """One row per conformer.  The packed order is the energy order, so ranking needs no shuffle."""
    return molecules.select(
        *[c for c in molecules.columns if c != "conformers"],
        F.posexplode("conformers").alias("_pos", "_c"),
    ).select(
        *[c for c in molecules.columns if c != "conformers"],
        "_c.conf_id",
        "_c.energy",
        "_c.features",
        (F.col("_pos") + 1).cast("int").alias("conf_rank"),
    )


def lowest_energy(molecules: DataFrame) -> DataFrame:
    """Keep only the lowest-energy conformer of each molecule."""
    return molecules.withColumn("conformers", F.slice("conformers", 1, 1))


def targets(molecules: DataFrame) -> DataFrame:
    return molecules.select("target").distinct()


def label_counts(molecules: DataFrame, keys=("target",)) -> DataFrame:
    """Actives and decoys of each group.  A molecule counts once, in however many rows it appears,
    as it does with several descriptor types in one table."""
    return count_labels(molecules.select(*keys, "mol_id", "active").distinct(), keys)


def count_labels(rows: DataFrame, keys=("target",)) -> DataFrame:
    """Actives and decoys of each group in a table with one row per molecule."""
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("active")).alias("num_actives"),
        F.count_if(~F.col("active")).alias("num_decoys"),
    )


def union_frames(*frames: DataFrame) -> DataFrame:
    """All rows of several tables of one shape."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def numbering_gaps(molecules: DataFrame) -> DataFrame:
    """Missing molecule numbers: actives count from 0, decoys on from the last active.

    With a ``dtype`` column each descriptor type is a numbering of its own; a number
    counts once, however often it appears.  Numbers are counted per cell of 65,536;
    only cells that are not full are written out and compared with the numbers present.
    """
    keys = [c for c in ("target", "dtype") if c in molecules.columns]
    present = (
        molecules.filter(F.col("mol_no").isNotNull())
        .select(*keys, "active", F.col("mol_no").cast("bigint").alias("mol_no"))
        .distinct()
    )
    last = present.groupBy(*keys).agg(
        F.max(F.when(F.col("active"), F.col("mol_no"))).alias("last_active"),
        F.max(F.when(~F.col("active"), F.col("mol_no"))).alias("last_decoy"),
    )
    after_actives = F.coalesce(F.col("last_active") + 1, F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    ranges = (
        last.select(
            *keys,
            F.explode(
                F.array(
                    F.struct(F.lit(True).alias("active"), zero.alias("lo"), F.col("last_active").alias("hi")),
                    F.struct(F.lit(False).alias("active"), after_actives.alias("lo"), F.col("last_decoy").alias("hi")),
                )
            ).alias("r"),
        )
        .select(*keys, "r.*")
        .filter(F.col("lo") <= F.col("hi"))
    )
    cell = lambda c: F.floor(c / _CELL).cast("bigint")
    expected = (
        ranges.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
        .withColumn("first", F.greatest(F.col("lo"), F.col("cell") * _CELL))
        .withColumn("last", F.least(F.col("hi"), F.col("cell") * _CELL + (_CELL - 1)))
        .select(*keys, "active", "cell", "first", "last")
    )
    counted = present.groupBy(*keys, "active", cell(F.col("mol_no")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    # Decoys numbered below the last active lie outside the range, so the count of a cell that
    # begins within the range's first cell says nothing: it is compared number by number.
    open_cells = expected.join(counted, [*keys, "active", "cell"], "left").filter(
        (F.coalesce(F.col("n"), F.lit(0)) < F.col("last") - F.col("first") + 1)
        | (F.col("first") > F.col("cell") * _CELL)
    )
    return (
        open_cells.select(*keys, "active", F.explode(F.sequence("first", "last")).alias("mol_no"))
        .join(present, [*keys, "active", "mol_no"], "left_anti")
        .select(*keys, "active", "mol_no")
    )

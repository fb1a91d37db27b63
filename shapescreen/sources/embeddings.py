"""Stand-in library: molecules built from a table of labelled vectors.

Vectors of one label within a run of 40 ids form one molecule, so the molecule
of a vector follows from its own row.  Each of the ten labels is a target: its
own molecules are the actives, all others the decoys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = 40
TARGETS = 10
# Features per descriptor type.
WIDTHS = {"usr": 12, "esh": 15, "es5": 18}
_ENERGY_AT = 63


def library(spark: SparkSession, sf_dir: str, dtype: str = "es5") -> DataFrame:
    """One packed row per molecule: at most 40 conformers, lowest energy first."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vec = F.col("embedding").cast("array<double>")
    conformer = F.struct(
        F.get(vec, F.lit(_ENERGY_AT)).alias("energy"),
        (F.col("vec_id") % RUN).cast("int").alias("conf_id"),
        F.slice(vec, 1, WIDTHS[dtype]).alias("features"),
    )
    run = F.floor(F.col("vec_id") / RUN).cast("bigint")
    # Scoring costs far more per byte than scanning, so the number of tasks is the session's,
    # not one derived from the size; grouping then needs no further shuffle.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        vectors.select(
            (run * TARGETS + F.col("label")).alias("mol_id"),
            F.col("label").cast("bigint").alias("label"),
            conformer.alias("conformer"),
        )
        .repartition(tasks, "mol_id", "label")
        .groupBy("mol_id", "label")
        .agg(F.array_sort(F.collect_list("conformer")).alias("conformers"))
        .withColumn("dtype", F.lit(dtype))
        .withColumn("n_rot", (F.col("mol_id") % 4).cast("int"))
    )


def molecules(spark: SparkSession, sf_dir: str, dtype: str = "es5") -> DataFrame:
    """The library as candidates of each target."""
    targets = F.sequence(F.lit(0).cast("bigint"), F.lit(TARGETS - 1).cast("bigint"))
    return (
        library(spark, sf_dir, dtype)
        .withColumn("target", F.explode(targets))
        .select(
            "target",
            "dtype",
            "mol_id",
            (F.col("label") == F.col("target")).alias("active"),
            "n_rot",
            "conformers",
        )
    )

"""Samples, hold-out splits and folds of molecules.

Only keys and labels are sampled; descriptors are joined afterwards.  Draws are
seeded: the random order is a hash of seed and identifier, so the same rows come
back on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapescreen.functions.bands import shuffle_key
from shapescreen.operators.molecules import conformers, count_labels
from shapescreen.operators.ranking import numbered
from shapescreen.sources.store import stage

# The learning curve and the hold-out shares.
PORTIONS = (1.0, 0.8, 0.6, 0.5, 0.3, 0.1, 0.05, 10.0)
TEST_SHARE = 0.2
TRAIN_SHARE = 0.8

# Leading hex digits of a random key.
_HASH_CELL = 4


def file_name() -> Column:
    """Name of a numbered molecule's file."""
    label = F.when(F.col("active"), F.lit("active_mol_")).otherwise(F.lit("decoy_mol_"))
    return F.concat(label, F.col("mol_id").cast("string"))


def _ordered(rows: DataFrame, policy: str, seed: int, name: Column | None) -> DataFrame:
    """Add the selection order ``key`` and its ``cell``."""
    if policy == "RANDOM":
        rows = rows.withColumn("key", shuffle_key(F.col("mol_id"), seed))
        return rows.withColumn("cell", F.substring("key", 1, _HASH_CELL))
    if policy == "SEQUENTIAL":
        if name is None:
            # The reader's identifiers are the files' names already.
            named = isinstance(rows.schema["mol_id"].dataType, T.StringType)
            name = F.col("mol_id") if named else file_name()
        # Cells are ranges of the names that are there, so a common stem makes no hot cell.  They
        # are stored: dealing them anew could draw other borders.
        ranged = rows.withColumn("key", name).repartitionByRange("key")
        return stage(ranged.withColumn("cell", F.spark_partition_id()), "name-order")
    raise ValueError("policy is 'RANDOM' or 'SEQUENTIAL'")


def draw(
    molecules: DataFrame,
    portions=(1.0,),
    share: float = 1.0,
    ratio: float = 1.0,
    policy: str = "SEQUENTIAL",
    seed: int = 0,
    exclude: DataFrame | None = None,
    totals: DataFrame | None = None,
    name: Column | None = None,
) -> DataFrame:
    """Sample molecules per target: rows (target, portion, mol_id, active).

    The actives wanted are ``portion * share``: a fraction of all actives up to
    1, a count above.  ``ratio`` gives decoys per active; below 0 it is that of
    the target, 0 takes no decoys.  Targets short of actives are topped up with
    decoys.  ``exclude(target, portion, mol_id)`` is never drawn.  ``totals``
    are the label counts of all files, by default those of ``molecules``; pass those of the
    listing where some files were rejected, so that rejects don't change the sample sizes.
    """
    group = ["target", "portion", "active"]
    wanted = F.array(
        *[F.struct(F.lit(float(p)).alias("portion"), F.lit(float(p * share)).alias("x")) for p in portions]
    )
    keys = molecules.select("target", "mol_id", "active")
    totals = count_labels(keys) if totals is None else totals
    rows = keys.withColumn("portion", F.explode(F.transform(wanted, lambda w: w["portion"])))
    if exclude is not None:
        rows = rows.join(
            exclude.select("target", "portion", "mol_id"), ["target", "portion", "mol_id"], "left_anti"
        )
    rows = _ordered(rows, policy, seed, name)

    actives, decoys = F.col("num_actives"), F.col("num_decoys")
    a = F.when(F.col("x") <= 1, actives * F.col("x")).otherwise(F.col("x"))
    per_active = (
        F.try_divide(decoys.cast("double"), actives.cast("double")) if ratio < 0 else F.lit(float(ratio))
    )
    available = rows.filter(F.col("active")).groupBy("target", "portion").agg(
        F.count(F.lit(1)).alias("available")
    )
    quotas = (
        totals.withColumn("w", F.explode(wanted))
        .select("target", "num_actives", "num_decoys", "w.portion", "w.x")
        .withColumn("a", a)
        .withColumn("d", F.coalesce(F.col("a") * per_active, F.lit(0.0)))
        .withColumn("load_a", F.least(F.col("a"), actives.cast("double")))
        .withColumn("load_all", F.col("load_a") + F.least(F.col("d"), decoys.cast("double")))
        .join(available, ["target", "portion"], "left")
        .withColumn("taken", F.least(F.ceil("load_a"), F.coalesce(F.col("available"), F.lit(0))))
        .select(
            "target",
            "portion",
            F.explode(
                F.array(
                    F.struct(F.lit(True).alias("active"), F.col("taken").alias("quota")),
                    F.struct(
                        F.lit(False).alias("active"),
                        F.greatest(F.ceil("load_all") - F.col("taken"), F.lit(0)).alias("quota"),
                    ),
                )
            ).alias("q"),
        )
        .select("target", "portion", "q.active", "q.quota")
    )
    return (
        numbered(rows, group, "cell", ["key", "mol_id"], carry=quotas)
        .filter(F.col("rn") <= F.col("quota"))
        .select("target", "portion", "mol_id", "active")
    )


def with_descriptors(sample: DataFrame, molecules: DataFrame, return_type: str = "SEPARATE") -> DataFrame:
    """Descriptors of sampled molecules: packed molecules, or with "LUMPED" one row per conformer."""
    rows = sample.join(molecules.drop("active"), ["target", "mol_id"])
    return conformers(rows) if return_type == "LUMPED" else rows


def take_portion(
    records: DataFrame,
    amount: float,
    group: list[str],
    policy: str = "RANDOM",
    seed: int = 0,
    exclude: DataFrame | None = None,
    name: Column | None = None,
) -> DataFrame:
    """``amount`` records per group without replacement: a fraction up to 1, a count above."""
    size = records.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    if amount <= 1:
        size = size.withColumn("_size", F.floor(F.col("_size") * F.lit(float(amount))))
    else:
        size = size.withColumn("_size", F.lit(int(amount)))
    left = records
    if exclude is not None:
        keys = [*group, "mol_id"]
        left = records.join(exclude.select(*keys), keys, "left_anti")
    return (
        numbered(_ordered(left, policy, seed, name), group, "cell", ["key", "mol_id"], carry=size)
        .filter(F.col("rn") <= F.col("_size"))
        .select(*records.columns)
    )


def kfold(
    records: DataFrame,
    folds: int,
    group: list[str],
    policy: str = "RANDOM",
    seed: int = 0,
    name: Column | None = None,
) -> DataFrame:
    """Add ``fold``: disjoint folds of ``floor(n / folds)`` molecules; the remainder is dropped.

    Groups with fewer records than folds yield no rows.
    """
    size = (
        records.groupBy(*group)
        .agg(F.floor(F.count(F.lit(1)) / F.lit(folds)).alias("_size"))
        .filter(F.col("_size") >= 1)
    )
    fold = F.floor((F.col("rn") - 1) / F.col("_size")).cast("int")
    return (
        numbered(_ordered(records, policy, seed, name), group, "cell", ["key", "mol_id"], carry=size)
        .withColumn("fold", fold)
        .filter(F.col("fold") < folds)
        .select(*records.columns, "fold")
    )


def holdout(molecules: DataFrame, portions=PORTIONS, seed: int = 0, **kw) -> tuple[DataFrame, DataFrame]:
    """Random test and training samples of disjoint molecules, at the label ratio of the target."""
    test = draw(molecules, portions, TEST_SHARE, -1, "RANDOM", seed, **kw)
    train = draw(molecules, portions, TRAIN_SHARE, -1, "RANDOM", seed + 1, exclude=test, **kw)
    return test, train


def training_redraw(molecules: DataFrame, test: DataFrame, portions=PORTIONS, seed: int = 0, **kw) -> DataFrame:
    """A new random draw of actives only, without the test molecules."""
    return draw(molecules, portions, TRAIN_SHARE, 0, "RANDOM", seed + 2, exclude=test, **kw)

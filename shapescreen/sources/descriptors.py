"""Reader of descriptor files: ``<home>/<target>/<active|decoy>_<name>.<type>``.

Line 1 is the number of rotatable bonds.  Each further line is one conformer:
index, features, energy and one unused field.  One file is one molecule, so the
scan already yields packed molecule rows and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels in file names and descriptor types.
DESCRIPTOR_TYPES = ("usr", "esh", "es5")
_NAME = r"([^/]+)/(active|decoy)_([^/]*)\.([^./]+)$"
_MISSING = ("", "NaN", "nan", "NA", "N/A", "NULL", "null", "None", "n/a", "#N/A")


def list_files(spark: SparkSession, home: str, extension: str) -> DataFrame:
    """Labelled files of one type: target, active, name, path.  File contents are not read."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*.{extension}")
        .option("recursiveFileLookup", "true")
        .load(home)
        .select("path")
    )
    return _named(found).select("target", "active", "mol_id", "mol_no", "path")


def _named(files: DataFrame) -> DataFrame:
    part = lambda i: F.regexp_extract("path", _NAME, i)
    return (
        files.filter(F.col("path").rlike(_NAME))
        .withColumn("target", part(1))
        .withColumn("active", part(2) == "active")
        .withColumn("mol_id", F.concat_ws("_", part(2), part(3)))
        .withColumn("mol_no", F.regexp_extract("path", r"_mol_(0|[1-9]\d*)\.[^./]+$", 1).try_cast("int"))
    )


def _number(text: Column) -> Column:
    """Empty and missing-value cells are 0; text that is no number gives NULL."""
    value = F.nanvl(text.try_cast("double"), F.lit(0.0))
    return F.coalesce(value, F.when(F.trim(text).isin(*_MISSING), F.lit(0.0)))


def read_descriptors(spark: SparkSession, home: str, dtype: str) -> DataFrame:
    """All files of a descriptor type below ``home``, parsed."""
    texts = (
        spark.read.text(
            home, wholetext=True, pathGlobFilter=f"*.{dtype}", recursiveFileLookup=True
        )
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    return parse_descriptors(texts, dtype)


def parse_descriptors(files: DataFrame, dtype: str) -> DataFrame:
    """Packed molecules from ``files(path, value)``; ``reason`` is set on unusable files.

    The feature count comes from the first conformer line; shorter lines are
    filled with 0, a longer line, a bad number or a missing body rejects the file.
    """
    texts = _named(files)
    lines = F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")
    n = F.col("width") - 3
    # Short lines are filled up with empty cells.
    filled = lambda line: F.concat(
        F.split(line, ","),
        F.array_repeat(F.lit(""), F.greatest(F.col("width") - F.size(F.split(line, ",")), F.lit(0))),
    )
    conformer = lambda numbers, i: F.struct(
        F.get(numbers, n).alias("energy"), i.cast("int").alias("conf_id"), F.slice(numbers, 1, n).alias("features")
    )
    body = F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1)))
    parsed = (
        texts.withColumn("lines", lines)
        .withColumn("n_rot", F.trim(F.get("lines", F.lit(0))).try_cast("int"))
        .withColumn("body", body)
        .withColumn("width", F.coalesce(F.size(F.split(F.get("body", F.lit(0)), ",")), F.lit(0)))
        .withColumn("widest", F.array_max(F.transform("body", lambda s: F.size(F.split(s, ",")))))
        .withColumn(
            "numbers",
            F.when(
                F.col("n_rot").isNotNull() & (n >= 1) & (F.col("widest") <= F.col("width")),
                F.transform("body", lambda s: F.transform(F.slice(filled(s), 2, n + 1), _number)),
            ),
        )
    )
    bad_number = lambda row: F.exists(row, lambda v: v.isNull())
    reason = (
        F.when(F.col("n_rot").isNull(), "bad first line")
        .when(F.size("body") == 0, "no conformers")
        .when(n < 1, "too few fields")
        .when(F.col("widest") > F.col("width"), "ragged row")
        .when(F.exists("numbers", bad_number), "not a number")
    )
    return parsed.select(
        "target",
        F.lit(dtype).alias("dtype"),
        "mol_id",
        "mol_no",
        "active",
        "n_rot",
        "path",
        F.array_sort(F.transform("numbers", conformer)).alias("conformers"),
        reason.alias("reason"),
    )


def molecules(files: DataFrame) -> DataFrame:
    return files.filter(F.col("reason").isNull()).drop("reason")


def rejects(files: DataFrame) -> DataFrame:
    return files.filter(F.col("reason").isNotNull()).select("path", "target", "active", "reason")


def compact(files: DataFrame, path: str) -> None:
    """Store usable molecules as Parquet, split by type and target, so small files are read once."""
    molecules(files).write.mode("append").partitionBy("dtype", "target").parquet(path)

"""Stored tables: stages of a job, results, models, and resuming after a stop."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Folders made for local sessions that name none, by application.
_local_folders: dict[str, str] = {}
# Names of the tables that this process has staged.
_staged: set[str] = set()


def stage_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_folders[context.applicationId]


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: later passes read columns from files, and a lost executor
    costs a re-read, not a recomputation.  A filter on column ``by`` reads its own folder only.
    """
    spark = df.sparkSession
    name = f"{name}-{uuid.uuid4().hex}"
    path = f"{stage_folder(spark)}/{name}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _staged.add(name)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that no later plan reads, so that they don't lie beside their successors."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName() in _staged:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class StagedTable:
    """A staged table that is appended to in several steps."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.schema = None

    def append(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def append_results(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append result rows, one folder per target, as Parquet or JSON."""
    results.write.mode("append").partitionBy("target").format(fmt).save(path)


def save_models(models: DataFrame, path: str) -> None:
    """Append trained models, one folder per target."""
    models.write.mode("append").partitionBy("target").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None where nothing was stored yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def pending_targets(targets: DataFrame, done: DataFrame) -> DataFrame:
    """Targets without a result row yet."""
    return targets.select("target").distinct().join(
        done.select("target").distinct(), "target", "left_anti"
    )


class RunLog:
    """Results and models of runs, which become visible together, target by target.

    A run writes both under its own name and then commits its targets with one small file.  Readers
    take committed targets only, each from the first run that committed it: what a stopped run left
    behind is never read, and a target that two runs finished is there once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def start(self) -> str:
        """Name of a new run; names sort by time."""
        return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, kind: str, run: str, rows: DataFrame) -> None:
        """Rows of one kind, such as ``results`` or ``models``, with a ``target``; not visible yet."""
        rows.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{self.folder}/{kind}")

    def commit(self, run: str, targets: DataFrame) -> None:
        done = targets.select("target").distinct().withColumn("run", F.lit(run))
        done.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def committed(self) -> DataFrame | None:
        """``target, run`` of all finished targets, or None before the first."""
        done = stored(self.spark, f"{self.folder}/commits")
        return None if done is None else done.groupBy("target").agg(F.min("run").alias("run"))

    def pending(self, targets: DataFrame) -> DataFrame:
        done = self.committed()
        return targets.select("target").distinct() if done is None else pending_targets(targets, done)

    def read(self, kind: str) -> DataFrame | None:
        """Committed rows of one kind, or None where there are none."""
        done, rows = self.committed(), stored(self.spark, f"{self.folder}/{kind}")
        if done is None or rows is None:
            return None
        return rows.withColumn("run", F.col("run").cast("string")).join(done, ["target", "run"], "left_semi")


def with_status(results: DataFrame, metric: str = "auc") -> DataFrame:
    """Mark rows whose model could not be trained or evaluated; their metrics stay NULL."""
    return results.withColumn(
        "status", F.when(F.col(metric).isNull(), F.lit("skipped")).otherwise(F.lit("ok"))
    )

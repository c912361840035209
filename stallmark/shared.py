"""Helpers that several stages share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; on one machine, where it is unset (as in tests), a new folder."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="stallmark-")


def send_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if not getattr(sc, "_stallmark_modules", False):
        root = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp(prefix="stallmark-")) / "stallmark_modules.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(out))
        sc._stallmark_modules = True


def cut(df: DataFrame) -> DataFrame:
    """df, written to the cluster's shared checkpoint folder (one of our own only where none is set, as in tests)."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
    """``cut`` and, from the same run, the number of the rows for which ``which`` holds (of all without it)."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(F.lit(True) if which is None else which).alias("n")))
    return out, seen.get["n"]


def numbered(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """df with the place, from 1, of each row in its group, as a window's row_number gives it.

    Counted in ranges of the sorted rows and from range to range by their sums, so that no
    task has a whole group. Rows with a null group are one group.
    """
    keys = [F.col(group), *order]
    ranged = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_part")) - F.col("_n")
    offsets = sizes.select("_group", "_part", (F.col("_first") - before - 1).alias("_zero"))
    placed = ranged.join(offsets, (F.col("_range") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return placed.withColumn(name, F.col("_at") - F.col("_zero")).select(*df.columns, name)

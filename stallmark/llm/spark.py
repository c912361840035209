"""Small Spark helpers that the operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 8 << 20
#: Rows of a few numbers each that are broadcast at most (about 10 MB).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only where it is unset (tests) a folder of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stallmark-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder, so that no lost executor makes it be computed again."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_seen(df: DataFrame, *measures: Column) -> tuple[DataFrame, dict]:
    """``cut`` and, from the same run, the number of rows (``n``) and other aggregates."""
    seen = Observation()
    return cut(df.observe(seen, F.count(F.lit(1)).alias("n"), *measures)), seen.get


def small(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if its rows, counted before, are at most ``BROADCAST_ROWS``; else joined as Spark decides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sha256_of(items: Column) -> Column:
    """Lower-case hex SHA-256 of the items, comma-joined."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def with_text(df: DataFrame, text: str) -> tuple[DataFrame, list[str], str]:
    """df with positional column names (so that none clashes), these names, and the name of its text column.

    A text that is no string is cast in a column of its own, behind the others.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    out, own = df.toDF(*names), names[df.columns.index(text)]
    if dict(out.dtypes)[own] == "string":
        return out, names, own
    return out.withColumn("_text", F.col(own).cast("string")), names, "_text"


def _bytes(size: str) -> int:
    """A size as Spark's settings write it: a number, with a unit (b, k, kb, m, ...) or without."""
    digits = size.strip().lower().rstrip("kmgtpb")
    unit = size.strip().lower()[len(digits) :].removesuffix("b")
    return int(digits) << 10 * ("kmgtp".index(unit) + 1 if unit else 0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow, after sending this package to the executors (once for each Spark context).

    Batches are held to ``BATCH_BYTES``: both the JVM and the Python worker hold
    one at a time for each task, whatever the length of the texts.
    """
    sc, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(conf.get(name)) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    if not getattr(sc, "_stallmark_sent", False):
        root = Path(__file__).resolve().parents[1]
        out = Path(tempfile.mkdtemp(prefix="stallmark-")) / "stallmark_package.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(out))
        sc._stallmark_sent = True
    return df.mapInArrow(run, schema)

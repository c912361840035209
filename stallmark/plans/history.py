"""History of runs as Parquet: opportunities first, the run's row last, as its commit mark."""

from __future__ import annotations

import sqlite3
import time
import uuid
from datetime import UTC, datetime
from types import TracebackType

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..schemas import OPPORTUNITY, RUN
from ..shared import shared_folder
from .pipeline import Result

SCHEMA_VERSION = 1


class History:
    """Runs under a folder that Spark can write; without one, in a new folder
    beside the checkpoints (of our own only where no shared folder is set, as in tests).

    The folder holds the version of its layout, and one of another version is refused. An id is
    claimed by creating a file with its name, which one of several writers can. A run
    whose row is missing was not finished and is not shown, nor are its opportunities. A deleted run has a file in the folder
    ``deleted``, from whose creation on no reader sees its row or its opportunities. Usable in a ``with`` statement; nothing is held open.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
        root = self._path()
        known = [s.getPath().getName() for s in root[1].listStatus(root[0])] if root[1].exists(root[0]) else []
        if other := [n for n in known if n.startswith("version-") and n != f"version-{SCHEMA_VERSION}"]:
            raise ValueError(f"history {self.path} has layout {other[0]}, not version-{SCHEMA_VERSION}")

    def __enter__(self) -> History:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        return None

    def _path(self, *names: str) -> tuple:
        """A path below the folder and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _claim(self, n: int) -> list[int]:
        """The next n free ids, now taken."""
        for parts in ((f"version-{SCHEMA_VERSION}",), ("ids",)):
            path, fs = self._path(*parts)
            fs.mkdirs(path)
        used = [self._read("runs", RUN).agg(F.max("run_id")).first()[0] or 0, *self._listed("ids")]
        out, candidate = [], max(used)
        while len(out) < n:
            candidate += 1
            path, fs = self._path("ids", str(candidate))
            if fs.createNewFile(path):
                out.append(candidate)
        return out

    def _read(self, name: str, schema) -> DataFrame:
        path, fs = self._path(name)
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _listed(self, name: str) -> dict[int, float]:
        """The ids that have a file in a folder, and when it was made (seconds since 1970)."""
        path, fs = self._path(name)
        return {int(s.getPath().getName()): s.getModificationTime() / 1000 for s in fs.listStatus(path)} if fs.exists(path) else {}

    def _runs(self) -> DataFrame:
        """The rows of finished runs that are not deleted."""
        runs, gone = self._read("runs", RUN), self._listed("deleted")
        return runs.where(~F.col("run_id").isin(list(gone))) if gone else runs

    def _bury(self, ids: list[int]) -> None:
        """Hide runs at once, then delete their opportunities."""
        folder, fs = self._path("deleted")
        fs.mkdirs(folder)
        for i in ids:
            fs.createNewFile(self._path("deleted", str(i))[0])
        for i in ids:
            fs.delete(self._path("opportunities", f"run_id={i}")[0], True)

    def _refuse_deleted(self, ids: list[int]) -> None:
        if gone := sorted(set(ids) & set(self._listed("deleted"))):
            raise RuntimeError(f"runs {gone} were deleted while they were saved")

    def delete_run(self, run_id: int) -> bool:
        """Delete a run and its opportunities; False if there is no such run."""
        if self.get_run(run_id) is None:
            return False
        self._bury([run_id])
        return True

    def clean_up(self, older_than: float = 86_400.0) -> list[int]:
        """Delete what is left of runs that were begun over ``older_than`` seconds ago and never finished; their ids.

        Safe beside writers: one that is at work for longer than that fails, and its run stays hidden. Temporary files
        of writers that were killed go when no younger run is unfinished. What such a writer adds to a deleted run goes the next time.
        """
        begun, gone = self._listed("ids"), self._listed("deleted")
        finished = {r.run_id for r in self._read("runs", RUN).select("run_id").collect()}
        open_ids = [i for i in begun if i not in finished and i not in gone]
        left = sorted(i for i in open_ids if begun[i] <= time.time() - older_than)
        self._bury(left + sorted(gone))
        if len(left) == len(open_ids):
            for name in ("opportunities", "runs"):
                path, fs = self._path(name, "_temporary")
                fs.delete(path, True)
        return left

    def _append(self, items: DataFrame, runs: DataFrame, ids: list[int]) -> None:
        """Write the items, then the rows of the runs; an error if one of them was deleted meanwhile."""
        items.select(*(F.col(f.name).cast(f.dataType) for f in OPPORTUNITY)).write.mode("append").partitionBy("run_id").parquet(f"{self.path}/opportunities")
        self._refuse_deleted(ids)
        runs.select(*(F.col(f.name).cast(f.dataType) for f in RUN)).coalesce(1).write.mode("append").parquet(f"{self.path}/runs")
        self._refuse_deleted(ids)

    def save(self, result: Result, *, config_summary: str = "defaults", created_at: str | None = None) -> int:
        """Append a run and its ranked items (all of them, whatever is shown); the new id."""
        query = F.lit(result.query)
        return self.save_all(result.items.withColumn("query", query), result.listings.withColumn("query", query), [result.query], config_summary=config_summary, created_at=created_at)[result.query]

    def save_all(self, items: DataFrame, listings: DataFrame, queries: list[str], *, config_summary: str = "defaults", created_at: str | None = None) -> dict[str, int]:
        """Append a run for each of the queries, in one write of items and listings with a column ``query``; the new ids."""
        ids = dict(zip(queries, self._claim(len(queries)), strict=True))
        if not ids:
            return ids
        stamp = created_at or datetime.now(UTC).replace(microsecond=0).isoformat()
        known = F.broadcast(self.spark.createDataFrame(list(ids.items()), "query string, run_id long"))
        count = lambda df, name: df.groupBy("query").agg(F.count("*").alias(name))
        totals = known.join(count(listings, "total_listings_scanned"), "query", "left").join(count(items, "total_groups"), "query", "left").na.fill(0)
        runs = totals.withColumns({"created_at": F.lit(stamp), "config_summary": F.lit(config_summary), "total_opportunities": F.col("total_groups")})
        self._append(items.drop("run_id").join(known, "query"), runs, list(ids.values()))
        return ids

    def saved_as(self, config_summary: str) -> DataFrame:
        """The finished runs with this summary."""
        return self._runs().where(F.col("config_summary") == config_summary)

    def import_sqlite(self, file: str, rows: int = 100_000) -> int:
        """Append all runs of an SQLite history (on the driver's disk, as only one process writes it) under new ids; how many.

        Opportunities go through the driver so many ``rows`` at a time to the shared folder, and from there to the history; of runs that are not listed none.
        """
        with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
            if (version := db.execute("PRAGMA user_version").fetchone()[0]) != SCHEMA_VERSION:
                raise ValueError(f"{file} has version {version}, not {SCHEMA_VERSION}")
            names = {t: ", ".join(f.name for f in kind) for t, kind in (("runs", RUN), ("opportunities", OPPORTUNITY))}
            runs = db.execute(f"SELECT {names['runs'].replace('run_id', 'id', 1)} FROM runs ORDER BY id").fetchall()
            if not runs:
                return 0
            new = dict(zip((r[0] for r in runs), self._claim(len(runs)), strict=True))
            moved = lambda part: [(new[r[0]], *r[1:]) for r in part if r[0] in new]
            staged = f"{shared_folder(self.spark)}/import-{uuid.uuid4().hex}"
            items = db.execute(f"SELECT {names['opportunities']} FROM opportunities")
            self.spark.createDataFrame([], OPPORTUNITY).write.parquet(staged)
            while part := items.fetchmany(rows):
                self.spark.createDataFrame(moved(part), OPPORTUNITY).write.mode("append").parquet(staged)
        self._append(self.spark.read.schema(OPPORTUNITY).parquet(staged), self.spark.createDataFrame(moved(runs), RUN), list(new.values()))
        return len(runs)

    def list_runs(self, limit: int | None = None) -> DataFrame:
        """Newest first."""
        runs = self._runs().orderBy(F.col("run_id").desc())
        return runs if limit is None else runs.limit(limit)

    def get_run(self, run_id: int) -> Row | None:
        return self._runs().where(F.col("run_id") == run_id).first()

    def list_opportunities(self, run_id: int) -> DataFrame:
        """In order of rank; only the run's folder is read. Of an unfinished or deleted run there are none."""
        if self.get_run(run_id) is None:
            return self.spark.createDataFrame([], OPPORTUNITY)
        return self._read("opportunities", OPPORTUNITY).where(F.col("run_id") == run_id).orderBy("rank")

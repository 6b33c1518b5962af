"""Sinks: tie-out result tables, build-aside-and-swap tables, snapshot content.

Results are recreated each run. What belongs together appears together: a run
writes its tables aside and commits one pointer (:mod:`ledgerline.sources.commits`),
so a run that fails leaves the former results in force, and of two writers that
started from the same state one is refused. Paths live under a shared folder the
caller names — on a cluster the folder behind ``spark.checkpoint.dir`` or a
warehouse path, never a machine-local temp directory.
"""

from __future__ import annotations

import os
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.operators import snapshot
from ledgerline.operators.tieout import Tieout
from ledgerline.sources.commits import Commit, CommitLog, Folder
from ledgerline.sources.datasets import new_version

TIEOUT_OUTPUTS = ("1_OVERVIEW", "2_COLUMNS_SUMMARY", "3_COLUMNS_DETAIL", "4_COLUMNS_SKIPPED")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), stamp: bool = False) -> str:
    """K1-K5: overwrite ``path`` with ``df``; ``stamp`` adds ``tieout_dt`` (K8)."""
    if stamp:
        df = df.withColumn("tieout_dt", F.current_timestamp())
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_and_read(df: DataFrame, path: str, partition_by: Sequence[str] = (), stamp: bool = False) -> DataFrame:
    """Write as :func:`write_table` does and read back under the written schema: an
    empty result reads back empty and partition values keep their type (a
    validation named ``01`` stays text)."""
    if stamp:
        df = df.withColumn("tieout_dt", F.current_timestamp())
    write_table(df, path, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_tieouts(spark: SparkSession, tieouts: Sequence[Tieout], base: str) -> dict[str, str]:
    """Write the four tie-out outputs for all validations of one target; the paths."""
    return {k: os.path.join(base, k) for k in write_tieout_frames(spark, tieouts, base)}


def write_tieout_frames(spark: SparkSession, tieouts: Sequence[Tieout], base: str) -> dict[str, DataFrame]:
    """Write the four outputs and return them as read back.

    Keys are counted first and stored (0_KEYS, a table per validation) for all outputs.
    Detail (K3) is written next, once, partitioned by validation and column;
    the per-column summary (K2) is then derived from the written detail, so
    the compared tables are joined once, not once per output.
    """
    def union(frames) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), frames)

    def write(df: DataFrame, k: str, partition_by: Sequence[str] = ()) -> DataFrame:
        return write_and_read(df, os.path.join(base, k), partition_by, stamp=True)

    tieouts = [t.store_keys(os.path.join(base, "0_KEYS", str(i))) for i, t in enumerate(tieouts)]
    detail = write(union(t.detail() for t in tieouts), "3_COLUMNS_DETAIL", ("name", "col_nm"))
    return {
        "1_OVERVIEW": write(union(t.overview for t in tieouts), "1_OVERVIEW"),
        "2_COLUMNS_SUMMARY": write(union(t.summary_from_detail(detail.filter(F.col("name") == t.name)) for t in tieouts),
                                   "2_COLUMNS_SUMMARY"),
        "3_COLUMNS_DETAIL": detail,
        "4_COLUMNS_SKIPPED": write(union(t.skipped(spark) for t in tieouts), "4_COLUMNS_SKIPPED"),
    }


class OutputSet:
    """K5: outputs of a run that replace those of the run before together, or not at all.

    ``folder()`` is where the run writes; ``publish`` names its outputs the current
    ones and removes the runs before the last ``keep``. :class:`~ledgerline.sources.commits.Conflict`
    if another run published since this one began; its outputs then stay in force.
    """

    def __init__(self, spark: SparkSession, base: str, keep: int = 2):
        self.spark, self.keep = spark, keep
        self._files, self._log = Folder(spark, base), CommitLog(spark, os.path.join(base, "commits"))
        self._began = self._log.current().number
        self.run = new_version()

    def folder(self) -> str:
        return self._files.child("runs", self.run)

    def publish(self, frames: dict[str, DataFrame]) -> dict[str, str]:
        """``frames``: the outputs by name, as read back from ``folder()``. Their paths."""
        schemas = {k: df.schema.jsonValue() for k, df in frames.items()}
        self._log.commit({"run": self.run, "schemas": schemas}, after=self._began)
        kept = self._log.last(self.keep)
        live = {c.state["run"] for c in kept}
        for old in self._log.last(1_000)[:-self.keep]:
            self._log.forget(old.number)
        for run in Folder(self.spark, self._files.child("runs")).names():
            if run not in live and run < min(live):  # a later one is being written
                self._files.remove("runs", run)
        return {k: os.path.join(self.folder(), k) for k in frames}


def current_outputs(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The outputs of the run that was published last, all of the same run."""
    now = CommitLog(spark, os.path.join(base, "commits")).current()
    if not now.number:
        raise FileNotFoundError(f"nothing published under {base}")
    return {k: spark.read.schema(StructType.fromJson(schema)).parquet(os.path.join(base, "runs", now.state["run"], k))
            for k, schema in now.state["schemas"].items()}


class Swap:
    """K6: a named table whose versions are built aside and swapped in.

    ``begin()`` notes the version in force; ``finish`` builds the new one as a table
    of its own, commits it on top of that version and repoints the view ``name``. If
    another writer committed in between, :class:`~ledgerline.sources.commits.Conflict`
    is raised, the built version is dropped and the view keeps the other's. The last
    ``keep`` versions stay.
    """

    def __init__(self, spark: SparkSession, name: str, keep: int = 2):
        self.spark, self.name, self.keep = spark, name, keep
        self._log = CommitLog(spark, os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_swaps", name))

    def begin(self) -> Commit:
        return self._log.current()

    def finish(self, df: DataFrame, began: Commit | None = None) -> str:
        began = began or self.begin()
        version = f"{self.name}__{new_version()}"
        df.write.saveAsTable(version)
        try:
            self._log.commit({"table": version}, after=began.number)
        except Exception:
            self.spark.sql(f"DROP TABLE {version}")
            raise
        self._show()
        for old in self._log.last(1_000)[:-self.keep]:
            self.spark.sql(f"DROP TABLE IF EXISTS {old.state['table']}")
            self._log.forget(old.number)
        return version

    def _show(self) -> None:
        """Point the view at the committed version, also if it moves meanwhile."""
        shown = None
        while shown != (now := self._log.current()):
            self.spark.sql(f"CREATE OR REPLACE VIEW {self.name} AS SELECT * FROM {now.state['table']}")
            shown = now

    def versions(self) -> list[str]:
        """The versions that are kept, oldest first."""
        return [c.state["table"] for c in self._log.last(1_000)]


def swap_in(spark: SparkSession, df: DataFrame, name: str, keep: int = 2) -> str:
    """K6 in one step: build a new version of ``name`` aside, then swap it in."""
    return Swap(spark, name, keep).finish(df)


PARTS = "db_nm string, sc_nm string, file_nm string, part string, content string, version string"


def write_snapshot(parts: DataFrame, path: str, version: str) -> DataFrame:
    """K7: add the parts of this version beside those of earlier ones; what is
    stored already is not touched. A folder per version, which is named here:
    ``partitionBy`` would sort all text by a constant."""
    stored = parts.select("db_nm", "sc_nm", "file_nm", "part", "content")
    stored.write.mode("append").parquet(os.path.join(path, f"version={version}"))
    return read_snapshot(parts.sparkSession, path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTS).parquet(path)


def snapshot_usage(parts: DataFrame, listed: DataFrame) -> DataFrame:
    """A row per stored version: version, n_parts, n_live (those of files that
    ``listed`` says this version holds), n_chars."""
    names = [*snapshot.KEYS, "version"]
    stored = parts.groupBy("version").agg(F.count(F.lit(1)).alias("n_parts"), F.sum(F.length("content")).alias("n_chars"))
    live = (snapshot.of_files(parts.select(*names), listed, names).groupBy("version").agg(F.count(F.lit(1)).alias("n_live")))
    return (stored.join(live, "version", "left")
            .select("version", "n_parts", F.coalesce("n_live", F.lit(0)).alias("n_live"), "n_chars"))

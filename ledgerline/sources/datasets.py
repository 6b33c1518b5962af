"""Many tables in one folder, each in the version that last wrote it.

Rows of all tables share one set of columns, two of which name the table
(schema and name). A version is a folder of rows, partitioned by schema; the
manifest, a table itself, says for every table which version holds its rows. A
change writes the rows of the changed tables as a new version, a manifest that
names it for them, and commits the manifest (:mod:`ledgerline.sources.commits`):
bytes of other tables are neither read nor written, dropping a table writes no
rows at all, and two writers cannot undo each other's change. A table listed in
a version that holds no row of it is empty; one that is not listed is absent.

Reading joins rows with the manifest on schema, name and version, so versions
without a live table are pruned and dead rows dropped. ``vacuum`` removes them.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerline.sources.commits import Commit, CommitLog, Conflict, Folder

VERSION = "__version"


def new_version() -> str:
    return f"v{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"


class Dataset:
    """The tables under ``path``; nothing is cached, every call sees the last commit."""

    def __init__(self, spark: SparkSession, path: str, db_sc_col: str = "db_sc", table_col: str = "table_name"):
        self.spark, self.name_cols = spark, [db_sc_col, table_col]
        self._files = Folder(spark, path)
        self._log = CommitLog(spark, self._files.child("commits"))

    def _manifest(self, commit: Commit) -> DataFrame:
        listed = StructType([StructField(n, StringType()) for n in (*self.name_cols, VERSION)])
        if not commit.number:
            return self.spark.createDataFrame([], listed)
        return self.spark.read.schema(listed).parquet(self._files.child("manifest", commit.state["manifest"]))

    def tables(self) -> DataFrame:
        """(schema, name, __version) of every table."""
        return self._manifest(self._log.current())

    def read(self, wanted: DataFrame | None = None) -> DataFrame:
        """The rows of all tables, or of those ``wanted`` names (schema, name)."""
        return self._read(self._log.current(), wanted)

    def _read(self, now: Commit, wanted: DataFrame | None = None) -> DataFrame:
        if not now.number:
            raise FileNotFoundError(f"no dataset under {self._files.path}")
        schema = StructType.fromJson(now.state["schema"])
        stored = self.spark.read.schema(StructType([*schema.fields, StructField(VERSION, StringType())])).parquet(
            self._files.child("rows"))
        listed = self._manifest(now)
        if wanted is not None:
            listed = listed.join(wanted.select(*self.name_cols).distinct(), self.name_cols, "left_semi")
        return stored.join(listed, [*self.name_cols, VERSION], "left_semi").select(*[F.col(f"`{n}`") for n in schema.names])

    def replace(self, rows, tables: DataFrame | None, drop: bool = False) -> str:
        """Let ``tables`` (schema, name) hold exactly ``rows``, a frame or a function
        that makes one, given a reader of the dataset as it is (of all tables or
        those a frame names); all other tables stay as they are. Without
        ``tables`` those of the rows are listed, as read back from what was written. With
        ``drop`` they go instead and ``rows`` is not used. The version written.
        :class:`Conflict` if another writer committed meanwhile; then nothing changed."""
        now, version = self._log.current(), new_version()
        schema = now.state.get("schema")
        if not drop:
            rows = rows(lambda wanted=None: self._read(now, wanted)) if callable(rows) else rows
            schema = schema or rows.schema.jsonValue()
            names = [f"`{f['name']}`" for f in schema["fields"]]
            rows.select(*names, F.lit(version).alias(VERSION)).write.mode("append").partitionBy(
                VERSION, self.name_cols[0]).parquet(self._files.child("rows"))
        if tables is None:
            stored = StructType([*StructType.fromJson(schema).fields, StructField(VERSION, StringType())])
            tables = self.spark.read.schema(stored).parquet(self._files.child("rows")).where(F.col(VERSION) == version)
        named = tables.select(*self.name_cols).distinct()
        listed = named.withColumn(VERSION, F.lit(version))
        if now.number or drop:  # else nothing is listed yet
            others = self._manifest(now).join(named, self.name_cols, "left_anti")
            listed = others if drop else others.unionByName(listed)
        listed.write.parquet(self._files.child("manifest", version))
        try:
            self._log.commit({"manifest": version, "schema": schema}, after=now.number)
        except Conflict:
            self._remove(version)
            raise
        return version

    def create(self, data: DataFrame) -> str:
        """All tables of ``data`` as the first or a new version of each."""
        return self.replace(data, None)

    def _remove(self, version: str) -> None:
        self._files.remove("rows", f"{VERSION}={version}")
        self._files.remove("manifest", version)

    def versions(self) -> list[str]:
        """The versions whose rows are stored, live or not."""
        found = Folder(self.spark, self._files.child("rows")).names()
        return [n.removeprefix(f"{VERSION}=") for n in found if n.startswith(VERSION)]

    def bytes_of(self, version: str) -> int:
        return Folder(self.spark, self._files.child("rows", f"{VERSION}={version}")).bytes()

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove versions that none of the last ``keep`` manifests lists, and older
        manifests; the versions removed. Versions that are only partly live stay.
        A version newer than the last commit belongs to a writer at work and stays."""
        kept = self._log.last(keep)
        live = {r[0] for c in kept for r in self._manifest(c).select(VERSION).distinct().collect()}  # one per change
        newest = kept[-1].state["manifest"] if kept else ""
        gone = [v for v in self.versions() if v not in live and v < newest]
        for version in gone:
            self._files.remove("rows", f"{VERSION}={version}")
        for old in self._log.last(1_000)[:-keep]:
            self._files.remove("manifest", old.state["manifest"])
            self._log.forget(old.number)
        return gone

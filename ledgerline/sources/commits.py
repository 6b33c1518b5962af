"""A commit log: one pointer that moves from state to state, or not at all.

A folder holds one small JSON document per commit, named by its number. A writer
builds its tables aside, then commits a state that names them, on top of the
number it started from. The document is written aside and renamed into place
without replacing: a writer whose number is taken in the meantime gets
:class:`Conflict` and the former state stays in force. Readers take the highest
number, so they see a whole state or the one before it.

Renaming without replacing is atomic on HDFS and the like. A store that has no
such rename needs a lock around ``commit``.

A state is a dictionary of a few short values (paths, names, a schema), never
rows: whatever grows with the data is a table the state points to.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed first."""


class Commit(NamedTuple):
    number: int  # 0: nothing committed yet
    state: dict


class Folder:
    """A few file operations where Spark's tables live, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._jvm = spark, spark._jvm
        self._rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        self.path = path
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def child(self, *names: str) -> str:
        return posixpath.join(self.path, *names)

    def names(self) -> list[str]:
        if not self._fs.exists(self._at(self.path)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(self.path)))

    def bytes(self) -> int:
        """Bytes of all files below."""
        root = self._at(self.path)
        return int(self._fs.getContentSummary(root).getLength()) if self._fs.exists(root) else 0

    def remove(self, *names: str) -> None:
        self._fs.delete(self._at(self.child(*names)), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(self.child(name)))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Whole file or nothing; False if the name is taken."""
        aside = self._at(self.child(f".{name}.{uuid.uuid4().hex}"))
        stream = self._fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        no_replacing = self._spark.sparkContext._gateway.new_array(self._rename, 1)
        no_replacing[0] = self._rename.NONE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._fs.getConf())
        try:
            files.rename(aside, self._at(self.child(name)), no_replacing)
        except Py4JJavaError as error:
            self._fs.delete(aside, False)
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True


class CommitLog:
    """The commits of one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self._folder = Folder(spark, path)

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._folder.names() if n.endswith(".json") and n[0] != "."]

    def at(self, number: int) -> Commit:
        return Commit(number, json.loads(self._folder.read(f"{number:020d}.json")))

    def current(self) -> Commit:
        numbers = self._numbers()
        return self.at(max(numbers)) if numbers else Commit(0, {})

    def last(self, most: int) -> list[Commit]:
        """The newest commits, at most so many, oldest first."""
        return [self.at(n) for n in sorted(self._numbers())[-most:]]

    def commit(self, state: dict, after: int) -> Commit:
        """Commit ``state`` on top of number ``after``; :class:`Conflict` if that is
        not the current number (any more)."""
        number = after + 1
        if self.current().number != after or not self._folder.write_new(f"{number:020d}.json", json.dumps(state)):
            raise Conflict(f"{self._folder.path}: another writer committed after number {after}")
        return Commit(number, state)

    def forget(self, number: int) -> None:
        """Drop the document of an old commit; the current one stays."""
        if number < self.current().number:
            self._folder.remove(f"{number:020d}.json")

"""A log of small numbered JSON files in a shared folder: the only thing that is ever switched."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class ManifestLog:
    """Entry n is one file that must not exist when it gets its name, so of two writers one fails; readers take the last."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self) -> list[str]:
        folder = self._path(self.folder)
        if not self._fs.exists(folder):
            return []
        return sorted(n for s in self._fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json"))

    def folders(self, prefix: str) -> list[str]:
        """What follows ``prefix`` in the names of the folders here."""
        return sorted(n[len(prefix) :] for s in self._fs.listStatus(self._path(self.folder)) if (n := s.getPath().getName()).startswith(prefix))

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def all(self) -> list[dict]:
        return [self._read(n) for n in self._names()]

    def last(self) -> tuple[int, dict | None]:
        """(number of entries, last entry)."""
        names = self._names()
        return len(names), self._read(names[-1]) if names else None

    def append(self, n: int, entry: dict) -> None:
        """Creates entry ``n``; raises if it is there already.

        The entry is written aside and then given its name in one step that does not overwrite (a hard link on a local
        disk, the file system's rename elsewhere), so a writer that dies leaves no cut entry and of two writers one fails.
        The folder must lie in a file system whose rename is atomic.
        """
        target, aside = (f"{self.folder}/{x}" for x in (f"{n:012d}.json", f"_{uuid.uuid4().hex}"))
        stream = self._fs.create(self._path(aside), False)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        try:
            if self._fs.getScheme() == "file":
                local = lambda p: self._path(p).toUri().getPath()
                os.link(local(aside), local(target))
            else:
                option = self._jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(option, 1)
                options[0] = option.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf()).rename(self._path(aside), self._path(target), options)
        finally:
            self._fs.delete(self._path(aside), False)

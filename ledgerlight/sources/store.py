"""Tables in a folder that change from one version to the next by a single atomic step.

A version is a small JSON file that lists the folders which make up the table. Data are staged in folders of their own, and
nothing that a reader may have open is overwritten; a version is published by renaming its file into place, which fails if
another writer has published that version meanwhile. Works on any file system that Hadoop reaches.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has published meanwhile; nothing was changed."""


class Versions:
    """The versions of a table under `path`; version 0 is the empty one, before any is published."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def latest(self) -> int:
        folder = self._at("versions")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def read(self, version: int | None = None) -> dict[str, Any]:
        version = self.latest() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._at(f"versions/{version:010d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def stage(self, df: DataFrame, *partitions: str) -> str:
        """df as Parquet in a new folder, whose name is returned; no version refers to it yet."""
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{self.path}/{folder}")
        return folder

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def drop(self, *folders: str) -> None:
        for folder in folders:
            self._fs.delete(self._at(folder), True)

    def publish(self, content: dict[str, Any], after: int) -> int:
        """Make content the version after `after`, or raise Conflict."""
        name = f"versions/{after + 1:010d}.json"
        draft = self._at(f"drafts/{uuid.uuid4().hex}.json")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            stream.close()
        self._fs.mkdirs(self._at("versions"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._at(name)), none)  # fails if it is there
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(self._at(name)):
                raise Conflict(f"version {after + 1} has been published meanwhile") from e
            raise
        return after + 1

    def vacuum(self, referred, keep: int = 2) -> None:
        """Drop versions but the last `keep`, and folders that none of these refers to. referred(content) gives the names of
        a version's folders. Not to be run while another writer stages."""
        last = self.latest()
        kept = [v for v in range(max(1, last - keep + 1), last + 1)]
        used = {f for v in kept for f in referred(self.read(v))}
        for f in self._fs.listStatus(self._at("data")) if self._fs.exists(self._at("data")) else []:
            if f"data/{f.getPath().getName()}" not in used:
                self._fs.delete(f.getPath(), True)
        for v in range(1, last + 1):
            if v not in kept:
                self._fs.delete(self._at(f"versions/{v:010d}.json"), False)

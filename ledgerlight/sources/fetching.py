"""Connectors as a data source of Spark's: what a connector lists becomes partitions, what it fetches becomes rows.

    spark.dataSource.register(ConnectorSource)
    spark.read.format("connector").option("source_id", ...).option("transport", "package.module:function").load()

Options: source_id names a registered connector; transport is a function that takes the options and gives the connector's
`get` (it is looked up by name on every executor); since is handed to the listing; tasks_per_partition (20) bounds what one
task fetches, pages_per_batch (10) what a stream lists at once. A row is a task's outcome: its key, the artifact, or why there is
none. One task that fails stops no other.

As a stream the offset is the connector's cursor, so a restarted stream goes on where its checkpoint says: pages are listed
again from there, and fetched once. After the last page a stream asks for it again until there is a next.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ledgerlight.sources.connectors import CONNECTORS, FetchTask

ARTIFACT = "key string, params string, url string, media_type string, payload binary, error string"


def connected(options: dict[str, str]) -> Any:
    """The connector that options name."""
    source_id, transport = options.get("source_id", ""), options.get("transport", "")
    if source_id not in CONNECTORS:
        raise ValueError(f"no connector {source_id!r}; there are {sorted(CONNECTORS)}")
    module, _, name = transport.partition(":")
    if not name:
        raise ValueError("option transport is to name a function as package.module:function")
    return CONNECTORS[source_id](getattr(import_module(module), name)(options))


@dataclass
class Tasks(InputPartition):
    """What one partition fetches: (key, parameters) each."""

    tasks: tuple[tuple[str, dict], ...]


def dealt(tasks: list[FetchTask], size: int) -> list[Tasks]:
    pairs = [(t.key, t.params) for t in tasks]
    return [Tasks(tuple(pairs[i: i + size])) for i in range(0, len(pairs), size)]


def outcomes(options: dict[str, str], partition: Tasks) -> Iterator[tuple]:
    """ARTIFACT rows of a partition's tasks."""
    source = connected(options)
    for key, params in partition.tasks:
        shown, n = json.dumps(params, sort_keys=True), 0
        try:
            for a in source.fetch(FetchTask(key, params)):
                n += 1
                yield key, shown, a.url, a.media_type, a.payload, None
        except Exception as e:  # an outcome like any other
            yield key, shown, None, None, None, f"{type(e).__name__}: {e}"
        else:
            if not n:
                yield key, shown, None, None, None, "not there"


class ConnectorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        tasks = list(connected(self.options).discover(self.options.get("since")))
        return dealt(tasks, int(self.options.get("tasks_per_partition", 20))) or [Tasks(())]

    def read(self, partition: Tasks) -> Iterator[tuple]:
        return outcomes(self.options, partition)


#: Pages up to which the batches of a run that catches up grow.
MOST_PAGES = 1024


class ConnectorStream(DataSourceStreamReader):
    """Offsets: {"cursor": of a page, "read": whether that page is behind}. An empty cursor is the first page.

    A batch has pages_per_batch pages. While a run catches up, each of its batches has `catch_up` times those of the one
    before, up to MOST_PAGES: many pages then take few batches, and a new run begins small again."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.at: dict[str, Any] | None = None
        self.pages = int(options.get("pages_per_batch", 10))

    def initialOffset(self) -> dict:
        return {"cursor": "", "read": False}

    def latestOffset(self) -> dict:
        self.at = self._walk(self.at or self.initialOffset(), self.pages)[1]
        self.pages = max(self.pages, min(MOST_PAGES, self.pages * int(self.options.get("catch_up", 1))))
        return self.at

    def _walk(self, start: dict, most: int, end: dict | None = None) -> tuple[list[FetchTask], dict]:
        """The tasks from an offset on, of `most` pages or up to an end; and the offset behind them."""
        source, since = connected(self.options), self.options.get("since")
        at, found, pages = dict(start), [], 0
        while at != end and pages < most:
            tasks, following = source.page(at["cursor"] or None, since)
            if not at["read"]:
                found += tasks
                pages += 1
            if following is None:
                return found, {"cursor": at["cursor"], "read": True}
            at = {"cursor": following, "read": False}
        return found, at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # a restarted stream is asked for a batch before it is asked for an offset
        self.at = self.at or end
        tasks = self._walk(start, 1 << 62, end)[0] if start != end else []
        return dealt(tasks, int(self.options.get("tasks_per_partition", 20))) or [Tasks(())]

    def read(self, partition: Tasks) -> Iterator[tuple]:
        return outcomes(self.options, partition)


class ConnectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "connector"

    def schema(self) -> str:
        return ARTIFACT

    def reader(self, schema) -> DataSourceReader:
        return ConnectorReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ConnectorStream(dict(self.options))


def from_folder(options: dict[str, str]):
    """A transport from pages that lie in a folder: option `path`, in it a folder cursor=<cursor> for each page with one text
    file. The first page has the cursor "first". A page that isn't there is an empty one."""
    from pyarrow import fs

    path = options["path"]
    files, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def get(url: str, params: dict) -> tuple[int, bytes, Any]:
        cursor = params.get("cursor") or params.get("offset") or params.get("$offset") or "first"
        found = files.get_file_info(fs.FileSelector(f"{root}/cursor={cursor}", allow_not_found=True))
        text = b"".join(files.open_input_stream(f.path).read() for f in sorted(found, key=lambda f: f.path) if f.base_name.startswith("part-"))
        return (200, text, json.loads(text)) if text.strip() else (404, b"", {})

    return get

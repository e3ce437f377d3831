"""Connectors: plug-ins that list what there is to fetch and fetch it. They parse nothing, and need no base class.

What a paged connector lists goes on from a cursor: page(cursor) gives the tasks of one page and the cursor of the next. So a
listing can be resumed, and is a source of Spark's (ledgerlight.sources.fetching).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class FetchTask:
    key: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Artifact:
    payload: bytes
    url: str
    media_type: str


CONNECTORS: dict[str, Any] = {}


def connector(cls):
    """Register a connector class under its source_id."""
    CONNECTORS[cls.source_id] = cls
    return cls


def load_plugins(group: str = "ledgerlight.connectors") -> list[str]:
    """Register the connectors of installed packages, which name their classes as entry points of the group. Returns their
    ids; one that is registered already is refused."""
    from importlib.metadata import entry_points

    found = []
    for point in entry_points(group=group):
        cls = point.load()
        if CONNECTORS.get(cls.source_id, cls) is not cls:
            raise ValueError(f"{point.name}: {cls.source_id} is registered already")
        found.append(connector(cls).source_id)
    return sorted(found)


def problems(conn: Any, sources: set[str]) -> list[str]:
    """What keeps a connector from being used."""
    found = []
    if not getattr(conn, "source_id", ""):
        found.append("no source_id")
    elif conn.source_id not in sources:
        found.append(f"{conn.source_id} has no register entry")
    if not getattr(conn, "jurisdictions", None):
        found.append("no jurisdictions")
    return found + [f"no {m}()" for m in ("discover", "fetch") if not callable(getattr(conn, m, None))]


class Paged:
    """Shared by the three sources below: pages through `get`, a function from a URL and parameters to (status, body, JSON)."""

    jurisdictions: tuple[str, ...] = ()

    def __init__(self, get: Callable[[str, dict], tuple[int, bytes, Any]]):
        self.get = get

    def page(self, cursor: str | None, since: str | None = None) -> tuple[list[FetchTask], str | None]:
        """The tasks of the page at a cursor (None: the first), and the next cursor (None: this is the last for now)."""
        raise NotImplementedError

    def discover(self, since: str | None = None) -> Iterator[FetchTask]:
        cursor: str | None = None
        while True:
            tasks, cursor = self.page(cursor, since)
            yield from tasks
            if cursor is None:
                return

    def fetch(self, task: FetchTask) -> Iterator[Artifact]:
        status, body, _ = self.get(task.key, task.params)
        if status == 200:
            yield Artifact(body, task.key, "application/json")


@connector
class ProZorro(Paged):
    """Ids by an offset cursor, then a document each; a document that is not there is passed over."""

    source_id, jurisdictions, base = "ua_prozorro", ("UA",), "https://public-api.prozorro.gov.ua/api/2.5/tenders"

    def page(self, cursor, since=None):
        offset = cursor or since
        _, _, page = self.get(self.base, {"offset": offset} if offset else {})
        rows, following = page.get("data") or [], (page.get("next_page") or {}).get("offset")
        return [FetchTask(f"{self.base}/{row['id']}") for row in rows], following if rows and following != offset else None


@connector
class ContractsFinder(Paged):
    """Release pages; the cursor is in next_page, else in the link to the next."""

    source_id, jurisdictions, base = "uk_contracts_finder", ("GB",), "https://www.contractsfinder.service.gov.uk/Published/Notices/OCDS/Search"

    def page(self, cursor, since=None):
        params = {k: v for k, v in (("publishedFrom", since), ("cursor", cursor)) if v}
        _, _, page = self.get(self.base, params)
        link = (page.get("links") or {}).get("next")
        following = (page.get("next_page") or {}).get("cursor") or (link.get("cursor") if isinstance(link, dict) else None)
        return [FetchTask(self.base, params)], following if page.get("releases") and following != cursor else None


@connector
class Secop(Paged):
    """Pages of 1000 rows; a short one is the last."""

    source_id, jurisdictions, base, size = "co_secop_ii", ("CO",), "https://www.datos.gov.co/resource/p6dx-8zbt.json", 1000

    def page(self, cursor, since=None):
        offset = int(cursor or 0)
        params = {"$limit": self.size, "$offset": offset} | ({"$where": f"fecha_de_publicacion_del > '{since}'"} if since else {})
        _, _, rows = self.get(self.base, params)
        return [FetchTask(self.base, params)], str(offset + self.size) if len(rows) >= self.size else None

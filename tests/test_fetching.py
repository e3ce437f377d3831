"""Connectors as Spark's source, batch and stream."""

import json

import pytest

from ledgerlight.sources import connectors
from ledgerlight.sources.fetching import ConnectorSource, ConnectorStream, Tasks, connected, outcomes


def page(folder, cursor, n, following=None):
    at = folder / f"cursor={cursor}"
    at.mkdir(parents=True)
    body = {"releases": [{"ocid": f"{cursor}-{i}"} for i in range(n)]} | ({"next_page": {"cursor": following}} if following else {})
    (at / "part-0.txt").write_text(json.dumps(body))


@pytest.fixture
def pages(tmp_path):
    folder = tmp_path / "pages"
    for cursor, following in (("first", "b"), ("b", "c"), ("c", None)):
        page(folder, cursor, 2, following)
    return folder


def options(folder, **more):
    return {"source_id": "uk_contracts_finder", "transport": "ledgerlight.sources.fetching:from_folder", "path": str(folder), **more}


def load(spark, folder, **more):
    spark.dataSource.register(ConnectorSource)
    return spark.read.format("connector").options(**options(folder, **more)).load()


def test_each_page_is_a_row(spark, pages):
    rows = load(spark, pages, tasks_per_partition="1").collect()
    assert sorted(json.loads(r.params).get("cursor", "") for r in rows) == ["", "b", "c"]
    assert all(r.error is None and json.loads(r.payload)["releases"] for r in rows)
    assert load(spark, pages, tasks_per_partition="2").rdd.getNumPartitions() == 2


def test_an_empty_listing_and_a_failing_fetch(spark, tmp_path):
    rows = load(spark, tmp_path / "nothing").collect()
    assert [(r.payload, r.error) for r in rows] == [(None, "not there")]
    folder = tmp_path / "pages"
    page(folder, "first", 1, "b")
    page(folder, "b", 1)
    rows = list(outcomes(options(folder, transport="test_fetching:failing"), Tasks((("u", {"cursor": "b"}), ("u", {})))))
    assert [(r[0], r[-1]) for r in rows] == [("u", "OSError: gone"), ("u", None)]  # one of two fails; the other is read


def failing(options):
    """A transport that fails for one page."""
    from ledgerlight.sources.fetching import from_folder

    def get(url, params):
        if params.get("cursor") == "b":
            raise OSError("gone")
        return from_folder(options)(url, params)

    return get


def test_options_are_checked(pages):
    for wrong in ({"source_id": "no one"}, {"transport": "json"}):
        with pytest.raises(ValueError):
            connected(options(pages, **wrong))


def tasks(partitions):
    return [p.get("cursor", "first") for t in partitions for _, p in t.tasks]


def test_offsets_go_on_from_the_cursor(pages):
    stream = ConnectorStream(options(pages, pages_per_batch="2"))
    start = stream.initialOffset()
    one = stream.latestOffset()
    two = stream.latestOffset()
    assert tasks(stream.partitions(start, one)) == ["first", "b"] and tasks(stream.partitions(one, two)) == ["c"]
    assert stream.latestOffset() == two and tasks(stream.partitions(two, two)) == []
    (pages / "cursor=c" / "part-0.txt").write_text(json.dumps({"releases": [1], "next_page": {"cursor": "d"}}))
    page(pages, "d", 1)
    three = stream.latestOffset()  # the last page has a next by now; it isn't fetched again itself
    assert tasks(stream.partitions(two, three)) == ["d"]
    again = ConnectorStream(options(pages, pages_per_batch="2"))  # restarted: its checkpoint names the batch
    assert tasks(again.partitions(two, three)) == ["d"] and again.latestOffset() == three


def test_a_stream_takes_each_page_once(spark, pages, tmp_path):
    spark.dataSource.register(ConnectorSource)
    out = str(tmp_path / "out")

    def run():
        query = spark.readStream.format("connector").options(**options(pages, pages_per_batch="1")).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        query.processAllAvailable()
        query.stop()
        return sorted(json.loads(r.params).get("cursor", "first") for r in spark.read.parquet(out).collect())

    assert run() == ["b", "c", "first"]
    assert run() == ["b", "c", "first"]
    (pages / "cursor=c" / "part-0.txt").write_text(json.dumps({"releases": [1], "next_page": {"cursor": "d"}}))
    page(pages, "d", 1)
    assert run() == ["b", "c", "d", "first"]


def test_conformance():
    everything = {cls.source_id for cls in connectors.CONNECTORS.values()}
    assert everything == {"ua_prozorro", "uk_contracts_finder", "co_secop_ii"}
    assert all(connectors.problems(cls(None), everything) == [] for cls in connectors.CONNECTORS.values())
    assert connectors.problems(connectors.Secop(None), set()) == ["co_secop_ii has no register entry"]


def test_listings_of_the_three():
    books = {None: {"releases": [1], "links": {"next": {"cursor": "2"}}}, "2": {"releases": [1], "links": {"next": "text"}}}
    finder = connectors.ContractsFinder(lambda u, p: (200, b"", books[p.get("cursor")]))
    assert [t.params for t in finder.discover("2020-01-01")] == [{"publishedFrom": "2020-01-01"}, {"publishedFrom": "2020-01-01", "cursor": "2"}]
    loop = connectors.ProZorro(lambda u, p: (200, b"", {"data": [{"id": "a"}], "next_page": {"offset": "1"}}))
    assert len(list(loop.discover())) == 2  # a page that names itself as the next is the last
    secop = connectors.Secop(lambda u, p: (200, b"", [{}] * (1000 if p["$offset"] < 2000 else 0)))
    assert [t.params["$offset"] for t in secop.discover("2020")] == [0, 1000, 2000]
    assert "2020" in next(iter(secop.discover("2020"))).params["$where"]


def test_plugins_of_installed_packages(monkeypatch):
    import importlib.metadata

    class Mine:
        source_id, jurisdictions = "mine", ("XX",)

    class Other:
        source_id = "co_secop_ii"

    point = lambda cls: type("Point", (), {"name": "p", "load": staticmethod(lambda: cls)})
    monkeypatch.setattr(connectors, "CONNECTORS", dict(connectors.CONNECTORS))
    monkeypatch.setattr(importlib.metadata, "entry_points", lambda group: [point(Mine)])
    assert connectors.load_plugins() == ["mine"] == connectors.load_plugins() and connectors.CONNECTORS["mine"] is Mine
    monkeypatch.setattr(importlib.metadata, "entry_points", lambda group: [point(Other)])
    with pytest.raises(ValueError):
        connectors.load_plugins()


def test_a_run_that_catches_up_takes_few_batches(tmp_path):
    """Of 100 pages the first batches have 2, 4, 8 and more; none is left out, and a new run begins small."""
    from ledgerlight.sources import fetching

    for k in range(100):
        page(tmp_path / "pages", f"c{k}" if k else "first", 1, f"c{k + 1}" if k < 99 else None)
    walk = lambda more: fetching.ConnectorStream({k: str(v) for k, v in (options(tmp_path / "pages") | {"pages_per_batch": "2"} | more).items()})
    stream, at, sizes = walk({"catch_up": "2"}), {"cursor": "", "read": False}, []
    while (end := stream.latestOffset()) != at:
        sizes.append(sum(len(p.tasks) for p in stream.partitions(at, end)))
        at = end
    assert sizes == [2, 4, 8, 16, 32, 38]
    assert len(walk({}).partitions({"cursor": "", "read": False}, walk({}).latestOffset())[0].tasks) == 2

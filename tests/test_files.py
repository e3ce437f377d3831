"""Document scan: one outcome a file."""

from ledgerlight.sources.files import document_scan

PROSE = "Plain words of a report that was written for people to read. " * 3


def outcomes(spark, folder, *more):
    return {r.path.rsplit("/", 1)[1]: (r.kind, r.status, r.chars, r.pages, r.method, r.error) for r in document_scan(spark, str(folder), *more).collect()}


def test_outcomes(spark, tmp_path):
    def layer(data):
        import re

        if not data.startswith(b"%PDF"):
            raise ValueError("no header")
        return re.split("\f", data[4:].decode())

    class Recogniser:
        name = "stub"

        def __init__(self, text, pages=1, there=True):
            self.text, self.pages, self.there = text, pages, there

        def is_available(self):
            return self.there

        def unavailable_reason(self):
            return "switched off"

        def extract(self, data):
            if self.text is None:
                raise OSError("blurred")
            return self.text, self.pages

    (tmp_path / "in").mkdir()
    files = {"a.pdf": b"%PDF" + PROSE.encode(), "in/b.PDF": b"%PDF# $", "c.pdf": b"broken", "d.htm": b"<p>caf\xc3\xa9</p><style>x</style>\xff", "e.html": b"", "f.txt": b"text", "g.pdf": b"", "h": b"x", "i.pdf": b"%PDF" + PROSE.encode() + b"\f" * 9}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    n = len(PROSE)
    found = outcomes(spark, tmp_path, layer, Recogniser(PROSE, 2))
    assert found["a.pdf"] == ("pdf", "TEXT_LAYER", n, 1, "text layer", None)
    assert found["b.PDF"] == ("pdf", "OCR", n, 2, "stub", None)
    assert found["c.pdf"] == ("pdf", "FAILED", 0, None, None, "could not be parsed: no header")
    assert found["d.htm"] == ("html", "TEXT_LAYER", 6, None, None, None)  # a stray byte is shown as such
    assert found["f.txt"][:3] == ("unknown", "FAILED", 0) and found["h"][1] == "FAILED"
    assert found["i.pdf"][1] == "OCR"  # too few characters a page
    assert outcomes(spark, tmp_path, layer, Recogniser("# $"))["b.PDF"][1:3] == ("EXTRACTION_UNRELIABLE", 3)
    assert outcomes(spark, tmp_path, layer, Recogniser(None))["b.PDF"][1:] == ("FAILED", 0, 1, "stub", "stub raised: blurred")
    assert outcomes(spark, tmp_path, layer, Recogniser("", there=False))["b.PDF"][1:] == ("BACKEND_UNAVAILABLE", 0, 1, None, "switched off")
    plain = outcomes(spark, tmp_path)
    assert plain["a.pdf"][1] == "BACKEND_UNAVAILABLE" and plain["d.htm"][1] == "TEXT_LAYER"
    assert set(plain) == {name.rsplit("/", 1)[-1] for name, data in files.items() if data}
    named = spark.createDataFrame([(f"file:{tmp_path}/{name}",) for name in [*files, "gone.pdf"]], "path string")
    every = outcomes(spark, tmp_path, layer, None, named)
    assert set(every) == {name.rsplit("/", 1)[-1] for name in files} | {"gone.pdf"}
    assert every["g.pdf"] == every["gone.pdf"] == ("pdf", "FAILED", 0, None, None, "missing or empty")


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i}.html").write_text(f"<p>{i}</p>")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1m")  # less than what a file counts as at least: each is a partition of the scan
    try:
        found = document_scan(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism < 60
        assert sorted(int(r.text) for r in found.collect()) == list(range(60))
    finally:
        spark.conf.set(key, before)

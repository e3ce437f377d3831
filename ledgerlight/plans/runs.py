"""Queries on runs that store what they find: indicators and their flags, incremental tables, sources, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlight.functions.scalars import severity_band
from ledgerlight.operators import indicators as I
from ledgerlight.operators import resolve as R
from ledgerlight.operators.plugins import run_indicators
from ledgerlight.plans.base import ORACLE_SQL, query
from ledgerlight.plans.indicators import FRAMEWORK, GB_THRESHOLD, PLACEHOLDER
from ledgerlight.sources import ingest
from ledgerlight.sources.fetching import ConnectorSource
from ledgerlight.sources.files import document_scan
from ledgerlight.sources.flags import FlagStore
from ledgerlight.sources.merged import MergedTable
from ledgerlight.sources.views import Tables
from ledgerlight.sources.workdir import dropped_at_end, laid_out, settled, shared_dir
from ledgerlight.streaming.clusters import cluster_stream, splitting_flags
from ledgerlight.streaming.resume import ResumableFetch

SOURCES = {"ua_prozorro": "ua", "uk_contracts_finder": "gb", "co_secop_ii": "co"}


def folder(spark, name: str) -> str:
    """A new folder that driver and executors share, gone when the application ends."""
    return dropped_at_end(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


@query("i10_written_flags", "SELECT source_id, method AS indicator_id, tender_id AS subject FROM tender WHERE method = 'open' OR method = 'direct' AND source_id <> 'ua_prozorro'")
def i10(spark, sf_dir):
    """Each source's flags stored twice. Of three kinds two are run again: one still flags, the other no longer does; in one
    source neither does. The third kind, and other sources, keep what they had."""
    tender = Tables(spark, sf_dir).tender.where("method IN ('direct', 'limited', 'open')").select("source_id", F.col("method").alias("indicator_id"), F.col("tender_id").alias("subject"), "tender_id", F.lit("{}").alias("details"))
    store = FlagStore(spark, folder(spark, "flags"))
    for source in SOURCES:
        store.replace(tender.where(F.col("source_id") == source), source, ["direct", "limited", "open"])
    for source in SOURCES:
        again = "false" if source == "ua_prozorro" else "indicator_id = 'direct'"
        store.replace(tender.where(F.col("source_id") == source).where(again), source, ["direct", "limited"])
    return store.read().select("source_id", "indicator_id", "subject")


def _k01_sql() -> str:
    """Each indicator's rule once more, with flags and units side by side, over each source's tenders and awards."""
    days = "CAST(floor((epoch(tender_end) - epoch(tender_start)) / 86400) AS BIGINT)"
    words = {"ua": "limited|negotiation|reporting|direct", "co": "directa", "gb": "direct|single_tender"}
    least = {"ua": 30, "co": 10, "gb": 30}
    first = {
        "ua": "SELECT count(*) FILTER (n = 1) AS flags, (SELECT count(*) FROM {t} JOIN {a} USING (tender_id)) AS units FROM (SELECT t.tender_id, count(*) AS n FROM {t} t JOIN {a} USING (tender_id) JOIN bid USING (tender_id) GROUP BY 1)",
        "co": "SELECT count(*) FILTER (greatest(CAST(bidders_stated AS INT), CAST(bidders_unique AS INT)) = 1) AS flags, count(*) AS units FROM {t} JOIN {a} USING (tender_id)",
        "gb": f"SELECT count(*) FILTER (NOT ({FRAMEWORK}) AND regexp_matches(lower(method), 'open|competitive|restricted')) AS flags, count(*) AS units FROM {{t}} WHERE tender_id IN (SELECT tender_id FROM {{a}} GROUP BY 1 HAVING count(*) = 1)",
    }
    pairs = f"SELECT buyer_name, supplier_name, count(*) AS won FROM {{t}} JOIN {{a}} USING (tender_id) WHERE NOT ({PLACEHOLDER}) GROUP BY ALL"
    mine = "(SELECT a.*, r.company_number FROM {a} a JOIN resolution r USING (award_id) WHERE status = 'active' AND supplier_name <> '' AND r.company_number IS NOT NULL) LEFT JOIN (SELECT company_number, incorporation_date, lower(trim(accounts_category)) AS cat, last_made_up FROM company) c USING (company_number)"
    dormant = "coalesce(cat IN ('dormant','dormant company','dormant no significant accounting'), false)"
    out = []
    for source, code in SOURCES.items():
        t, a = f"(SELECT * FROM tender WHERE source_id = '{source}')", f"(SELECT * FROM award WHERE tender_id IN (SELECT tender_id FROM tender WHERE source_id = '{source}'))"
        each = {
            "i001": first[code],
            "i002": f"SELECT count(*) FILTER ({days} < {least[code]}) AS flags, count(*) AS units FROM {{t}} WHERE tender_start IS NOT NULL AND tender_end IS NOT NULL",
            "i003": f"SELECT count(*) FILTER (total >= 4 AND won / total >= 0.5) AS flags, count(*) AS units FROM (SELECT *, sum(won) OVER (PARTITION BY buyer_name) AS total FROM ({pairs}))",
            "i004": f"SELECT count(*) FILTER (NOT ({FRAMEWORK}) AND abs(a.value_cents - t.value_cents) / t.value_cents >= 0.25) AS flags, count(*) AS units FROM {{t}} t JOIN {{a}} a USING (tender_id) WHERE a.value_cents > 0 AND t.value_cents > 0",
            "i005": f"SELECT count(*) FILTER (total >= 4 AND direct / total >= 0.3) AS flags, count(*) AS units FROM (SELECT buyer_name, count(*) AS total, count(*) FILTER (regexp_matches(lower(method), '{words[code]}')) AS direct FROM {{t}} GROUP BY 1)",
        }
        if code == "gb":
            each |= {
                "i006": f"SELECT count(*) FILTER (award_date - incorporation_date BETWEEN 0 AND 89) AS flags, count(*) AS units FROM {mine}",
                "i007": f"SELECT count(*) FILTER (value_kind <> 'shared_ceiling' AND ({dormant} AND value_cents > 0 OR cat IN ('micro-entity','micro entity') AND value_cents > 5000000 OR cat IN ('small','small company') AND value_cents > 500000000)) AS flags, count(*) AS units, count(*) FILTER (value_kind = 'shared_ceiling') AS unscoreable FROM {mine}",
                "i008": f"SELECT count(*) FILTER ({dormant} OR coalesce(award_date - last_made_up > 547.92, false)) AS flags, count(*) AS units FROM {mine}",
            }
        for name, sql in each.items():
            out.append(f"SELECT '{source}' AS source_id, '{name}' AS indicator_id, flags, units, {'unscoreable' if name == 'i007' else '0'} AS unscoreable FROM ({sql.format(t=t, a=a)})")
    return " UNION ALL ".join(out)


@query("k01_all_indicators", _k01_sql())
def k01(spark, sf_dir):
    """Every source's run of all indicators validated for its country: stored, and counted in the store. Tenders and awards are
    laid out by tender once: no run and no indicator shuffles them again to join them."""
    t = Tables(spark, sf_dir)
    tender = laid_out(t.tender.select("tender_id", "tender_key", "source_id", "buyer_name", "title", "method", "value_cents", "tender_start", "tender_end", "raw_json", "bidders_stated", "bidders_unique"), "tender_id")
    award = laid_out(t.award.select("award_id", "tender_id", "supplier_name", "value_cents", "status", "award_date", "value_kind"), "tender_id")
    tables = {"tender": tender, "award": award, "bid": t.bid, "company": t.company, "resolution": R.resolve_awards(t.award, t.company)}
    store = FlagStore(spark, folder(spark, "flags"))
    reports = [run_indicators(tables, source, code, store) for source, code in SOURCES.items()]
    rows = [(r["source"], i, n["units"], n["unscoreable"]) for r in reports for i, n in r["per_indicator"].items()]
    flags = store.read().groupBy("source_id", "indicator_id").agg(F.count("*").alias("flags"))
    ran = spark.createDataFrame(rows, "source_id string, indicator_id string, units long, unscoreable long")
    return ran.join(flags, ["source_id", "indicator_id"], "left").select("source_id", "indicator_id", F.coalesce("flags", F.lit(0)).alias("flags"), "units", "unscoreable")


def _pages(t: Tables, size: int = 500) -> str:
    """Orders as pages of releases, written for from_folder(): each names the next by its cursor."""
    page = F.floor(F.col("o_orderkey") / size)
    release = F.struct(F.concat(F.lit("ocds-"), F.col("o_orderkey").cast("string")).alias("ocid"), F.struct(F.col("o_orderkey").cast("string").alias("id"), F.struct(F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.lit("GBP").alias("currency")).alias("value")).alias("tender"))
    orders = t.read("orders")
    last = orders.agg(F.max(page)).first()[0]
    pages = orders.groupBy(page.alias("page")).agg(F.sort_array(F.collect_list(release)).alias("releases"))
    following = F.when(F.col("page") < last, F.struct(F.concat(F.lit("p"), F.col("page") + 1).alias("cursor")))
    path = folder(t.spark, "pages")
    pages.select(F.to_json(F.struct("releases", following.alias("next_page"))).alias("value"), F.when(F.col("page") == 0, "first").otherwise(F.concat(F.lit("p"), "page")).alias("cursor")).write.partitionBy("cursor").text(path)
    return path


def _connected(reader, path: str):
    return reader.format("connector").option("source_id", "uk_contracts_finder").option("transport", "ledgerlight.sources.fetching:from_folder").option("path", path).option("tasks_per_partition", "4").option("pages_per_batch", "7")


def _tenders(artifacts):
    releases = artifacts.select(F.explode(F.from_json(F.decode("payload", "UTF-8"), "STRUCT<releases: ARRAY<STRING>>")["releases"]).alias("document"))
    return ingest.contracts_finder(releases)["tender"].select("tender_id", "value_cents", "currency")


FETCHED = "SELECT CAST(o_orderkey AS VARCHAR) AS tender_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS value_cents, 'GBP' AS currency FROM orders"


@query("a01_connector_source", FETCHED)
def a01(spark, sf_dir):
    """Pages listed and fetched by a connector through Spark's own reader."""
    spark.dataSource.register(ConnectorSource)
    return _tenders(_connected(spark.read, _pages(Tables(spark, sf_dir))).load())


@query("a01_connector_stream", FETCHED)
def a01_stream(spark, sf_dir):
    """The same pages as a stream whose offset is the cursor, seven pages in the first batch and twice as many in each that
    follows; stopped and restarted."""
    spark.dataSource.register(ConnectorSource)
    path, out = _pages(Tables(spark, sf_dir)), folder(spark, "artifacts")
    for once in (True, False):
        stream = _connected(spark.readStream, path).option("catch_up", "2").load().writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint")
        run = (stream.trigger(availableNow=True) if once else stream).start()
        try:
            run.awaitTermination() if once else run.processAllAvailable()
        finally:
            run.stop()
    return _tenders(spark.read.parquet(out))


def _streamed(spark, awards, keys: list[str], window: int):
    """Clusters of awards that come as a stream: in eight batches by date, out of order by up to five days, and at last one
    award of a much later day, with which all others are behind the watermark."""
    path, out = folder(spark, "awards"), folder(spark, "clusters")
    awards = settled(awards)
    first, last = awards.agg(F.min("award_date"), F.max("award_date")).first()
    shuffled = F.date_diff(F.date_add("award_date", F.pmod(F.xxhash64("tender_id"), F.lit(6)).cast("int")), F.lit(first))
    slot = F.least(F.floor(shuffled * 8 / ((last - first).days + 6)), F.lit(7))
    for k in range(8):  # one after the other, as files are taken in the order of their times
        awards.where(slot == k).repartition(1).write.mode("append").parquet(path)
    end = awards.limit(1).select(*(F.lit(None).cast(awards.schema[c].dataType).alias(c) for c in keys), F.date_add(F.lit(last), window + 60).alias("award_date"), F.lit("end").alias("tender_id"), F.lit(0).cast("long").alias("value_cents"), F.lit(None).cast("double").alias("match_confidence"))
    end.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(awards.schema).option("maxFilesPerTrigger", 1).parquet(path)
    writer = cluster_stream(stream, keys, window).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


ORACLE_SQL["j06_clusters"] = ORACLE_SQL["e01_clusters"]
ORACLE_SQL["j06_splitting"] = f"SELECT subject, pieces, awards, total_cents, band, confidence FROM ({ORACLE_SQL['i09_splitting']})"


@query("j06_clusters")
def j06(spark, sf_dir):
    """e01_clusters, its rows coming as a stream."""
    awards = Tables(spark, sf_dir).award.select(F.col("supplier_key").alias("k"), "award_date", "tender_id", "value_cents", F.lit(None).cast("double").alias("match_confidence"))
    return _streamed(spark, awards, ["k"], 60).select("k", F.col("anchor").cast("string").alias("anchor"), F.col("awards").alias("n"))


@query("j06_splitting")
def j06_splitting(spark, sf_dir):
    """i09_splitting, its awards coming as a stream."""
    t = Tables(spark, sf_dir)
    tender = I.framework(t.tender).where("NOT framework AND buyer_nation <> ''").select("tender_id", F.col("buyer_nation").alias("buyer"))
    mine = I.evaluable(t.award, R.resolve_awards(t.award, t.company)).where("value_cents > 0").join(tender, "tender_id")
    awards = mine.select("buyer", "company_number", "award_date", "tender_id", "value_cents", "match_confidence")
    found = splitting_flags(_streamed(spark, awards, ["buyer", "company_number"], 30), GB_THRESHOLD)
    subject = F.concat("company_number", F.lit("@"), "buyer", F.lit(":"), F.col("anchor").cast("string"))
    return found.select(subject.alias("subject"), "pieces", "awards", "total_cents", severity_band(F.date_diff("last", "anchor"), 30).alias("band"), "confidence")


@query("b05_incremental", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def b05_incremental(spark, sf_dir):
    """The last event of each user, from three batches merged one after the other into a stored table; the second is sent
    twice, and each has events that are older than some of the batch before."""
    rows = Tables(spark, sf_dir).read("events").select("user_id", "event_type", "event_id")
    table = MergedTable(spark, folder(spark, "merged"), ["user_id"], "event_id", buckets=8)
    for batch in (0, 1, 1, 2):
        table.merge(rows.where((F.col("event_id") % 5 + F.floor(F.col("event_id") * 3 / rows.agg(F.max("event_id") + 1).first()[0])) % 3 == batch), batch)
    return table.read()


class Interrupted(ResumableFetch):
    """A run that breaks off after its third batch has been stored, before that is known to be done."""

    def store(self, batch, batch_id):
        super().store(batch, batch_id)
        if batch_id == 2:
            raise RuntimeError("stopped")


@query("j04_resumed", "SELECT c_name AS key, sha256('document of ' || c_name) AS sha256, 1 AS times FROM customer WHERE c_custkey % 10 > 0 UNION ALL SELECT c_name, NULL, 5 FROM customer WHERE c_custkey % 10 = 0")
def j04_resumed(spark, sf_dir):
    """Customers named by five roster files, each in two or more of them; the run is stopped half-way and resumed. Every tenth
    has no document, and is tried whenever a file names it."""
    rows, path = Tables(spark, sf_dir).read("customer"), folder(spark, "fetched")
    for i in range(5):
        rows.where((F.col("c_custkey") % 5 >= i - 2) & (F.col("c_custkey") % 5 <= i + 1) | (F.col("c_custkey") % 10 == 0)).select(F.col("c_name").alias("key")).coalesce(1).write.mode("append").parquet(f"{path}/roster")

    def fetch(key: str) -> bytes:
        if key.endswith("0"):
            raise FileNotFoundError(key)
        return f"document of {key}".encode()

    try:
        Interrupted(spark, f"{path}/roster", path, fetch).run()
    except Exception:  # as the stopped run ends; what went wrong otherwise shows in the rows
        pass
    resumed = ResumableFetch(spark, f"{path}/roster", path, fetch)
    resumed.run()
    return resumed.outcomes().groupBy("key").agg(F.max("sha256").alias("sha256"), F.count("*").cast("int").alias("times"))


class Reader:
    """Stands for a recogniser: reads the samples' text behind their fifth byte, but of those marked R."""

    name = "sample reader"

    def is_available(self):
        return True

    def unavailable_reason(self):
        return None

    def extract(self, data):
        if data[4:5] == b"R":
            raise ValueError("blurred")
        return data[5:].decode(), 1


def sample_layer(data: bytes) -> list[str]:
    """The text layer of a sample: of those marked L all their text; others have none or can't be parsed."""
    if data[:4] != b"%PDF" or data[4:5] == b"B":
        raise ValueError("no PDF")
    return [data[5:].decode() if data[4:5] == b"L" else ""]


def write_files(rows, path: str) -> None:
    """rows (name, content) as files in a folder, written by the executors."""

    def write(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        files.create_dir(root)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_output_stream(f"{root}/{name}") as f:
                    f.write(content)
            yield batch.slice(0, 0).select(["name"])

    rows.select("name", "content").mapInArrow(write, "name string").count()


PASSES = "solid > 0 AND length(text) >= 50 AND alnum >= 0.5 * solid AND len(words) > 0 AND len(list_filter(words, lambda x: regexp_matches(x, '^[A-Za-z0-9][A-Za-z0-9''\\-.,;:()/]*$'))) >= 0.6 * len(words)"


@query("a20_document_scan", f"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS words, len(regexp_extract_all(text, '\\S')) AS solid, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]')) AS alnum FROM documents),
s AS (SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN 'TEXT_LAYER' WHEN 1 THEN CASE WHEN {PASSES} THEN 'TEXT_LAYER' ELSE 'EXTRACTION_UNRELIABLE' END WHEN 2 THEN CASE WHEN {PASSES} THEN 'OCR' ELSE 'EXTRACTION_UNRELIABLE' END ELSE 'FAILED' END AS status FROM w)
SELECT doc_id, status, CASE WHEN status = 'FAILED' THEN 0 WHEN doc_id % 6 = 0 THEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) ELSE length(text) END AS chars FROM s""")
def a20(spark, sf_dir):
    """Documents as files of six kinds: a page, PDFs with a layer, as an image, broken and blurred, and an unknown kind."""
    docs, path = Tables(spark, sf_dir).read("documents"), folder(spark, "files")
    kind = F.col("doc_id") % 6
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.when(kind == 0, F.concat(F.lit("<html><script>x</script><p>"), escaped, F.lit("</p>"))).otherwise(F.concat(F.lit("%PDF"), F.element_at(F.array(*map(F.lit, "?LIBLR")), (kind + 1).cast("int")), "text"))
    write_files(docs.select(F.concat("doc_id", F.element_at(F.array(*map(F.lit, (".HTML", ".pdf", ".pdf", ".PDF", ".docx", ".pdf"))), (kind + 1).cast("int"))).alias("name"), F.encode(body, "UTF-8").alias("content")), path)
    found = document_scan(spark, path, sample_layer, Reader())
    return found.select(F.regexp_extract("path", r"(\d+)\.[^./]*$", 1).cast("long").alias("doc_id"), "status", "chars")

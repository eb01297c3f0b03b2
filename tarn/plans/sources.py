"""Source, sink and stream queries over the tables. Files are written to the shared folder and read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import functions as F

from ..cluster import scratch
from ..sources import json_array, paged, readers, sinks
from ..streaming import streams
from .views import query

c = F.col
OLD = "old AS (SELECT p_partkey AS k, p_brand AS v FROM part WHERE p_partkey % 3 = 0), new AS (SELECT p_partkey % 500 AS k, p_type AS v, p_partkey AS seq FROM part WHERE p_partkey % 2 = 0)"


def old(t):
    return t.part.where("p_partkey % 3 = 0").select(c("p_partkey").alias("k"), c("p_brand").alias("v"))


def new(t):
    return t.part.where("p_partkey % 2 = 0").select((c("p_partkey") % 500).alias("k"), c("p_type").alias("v"), c("p_partkey").alias("seq"))


@query("src_05_incremental", "SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def src_05(t):
    return readers.changed_since(t.events, "ts", F.lit("2024-01-20").cast("timestamp")).select("event_id", "event_type")


@query("src_11_flat_company", "SELECT CAST(p_partkey AS VARCHAR) AS orgnr, p_name AS name, p_brand AS form, DATE '2020-01-02' AS registered, 'Gatan ' || p_size || ', 11122 Stockholm' AS address, p_size > 40 AS removed FROM part")
def src_11(t):
    removed = F.when(c("p_size") > 40, F.struct(F.lit("2021-01-01").alias("datum")))
    doc = F.to_json(F.struct(F.struct(c("p_partkey").cast("string").alias("identitetsbeteckning")).alias("identitet"), F.array(F.struct(c("p_name").alias("namn"))).alias("namn"), F.struct(c("p_brand").alias("kod")).alias("organisationsform"), F.lit("2020-01-02").alias("registreringsdatum"), F.struct(F.concat(F.lit("Gatan "), c("p_size").cast("string")).alias("utdelningsadress"), F.lit("11122").alias("postnummer"), F.lit("Stockholm").alias("postort")).alias("adress"), removed.alias("avregistrering")))
    return readers.flat_company(t.part.select(doc.alias("doc")), "doc")


@query("src_13_registry_company", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status, CASE WHEN c_acctbal > 5000 THEN 'large' WHEN c_acctbal > 1000 THEN 'medium' ELSE 'small' END AS size_class, c_mktsegment || ':' || c_nationkey AS address_key FROM customer")
def src_13(t):
    size = F.when(c("c_acctbal") > 5000, "large").when(c("c_acctbal") > 1000, "medium").otherwise("small")
    return t.customer.select("c_custkey", F.when(c("c_acctbal") < 0, "inactive").otherwise("active").alias("status"), size.alias("size_class"), F.concat_ws(":", "c_mktsegment", c("c_nationkey").cast("string")).alias("address_key"))


@query("snk_01_insert_or_ignore", f"WITH {OLD}, f AS (SELECT k, arg_min(v, seq) AS v FROM new GROUP BY k) SELECT k, v FROM old UNION ALL SELECT k, v FROM f WHERE k NOT IN (SELECT k FROM old)")
def snk_01(t):
    return sinks.insert_or_ignore(old(t), new(t), ["k"], "seq")


@query("snk_02_insert_or_replace", f"WITH {OLD}, f AS (SELECT k, arg_max(v, seq) AS v FROM new GROUP BY k) SELECT coalesce(f.k, old.k) AS k, CASE WHEN f.k IS NULL THEN old.v ELSE f.v END AS v FROM old FULL JOIN f ON f.k = old.k")
def snk_02(t):
    return sinks.insert_or_replace(old(t), new(t), ["k"], "seq")


@query("snk_03_count_upsert", f"WITH {OLD}, f AS (SELECT k, count(*) AS n, arg_max(v, seq) AS v FROM new GROUP BY k) SELECT coalesce(f.k, old.k) AS k, CAST(CASE WHEN old.k IS NULL THEN 0 ELSE 1 END + coalesce(n, 0) AS BIGINT) AS attempts, coalesce(f.v, old.v) AS v FROM old FULL JOIN f ON f.k = old.k")
def snk_03(t):
    return sinks.count_upsert(old(t).withColumn("attempts", F.lit(1)), new(t), "k", "seq", "v")


@query("snk_04_coalesce_merge", f"WITH {OLD}, f AS (SELECT k, CASE WHEN k % 5 <> 0 THEN arg_max(v, seq) END AS v FROM new GROUP BY k) SELECT coalesce(f.k, old.k) AS k, coalesce(f.v, old.v) AS v, CASE WHEN f.k IS NULL THEN 'old' WHEN old.k IS NULL THEN 'new' ELSE 'both' END AS source FROM old FULL JOIN f ON f.k = old.k")
def snk_04(t):
    last = new(t).groupBy("k").agg(F.max_by("v", "seq").alias("v")).select("k", F.when(c("k") % 5 != 0, c("v")).alias("v"))
    return sinks.coalesce_merge(old(t), last, "k", ["v"])


@query("snk_06_nested_export", "SELECT o_orderkey, CAST(count(l_orderkey) AS INT) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def snk_06(t):
    lines = t.lineitem.select(c("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    x = sinks.nested(t.orders.select("o_orderkey"), lines, "o_orderkey", "lines")
    return x.select("o_orderkey", F.coalesce(F.array_size("lines"), F.lit(0)).alias("lines"))


@query("snk_08_replace_by_prefix", "SELECT p_partkey, p_name FROM part WHERE NOT starts_with(p_name, 'red') UNION ALL SELECT p_partkey, 'red new' FROM part WHERE p_partkey < 10")
def snk_08(t):
    fresh = t.part.where("p_partkey < 10").select("p_partkey", F.lit("red new").alias("p_name"))
    return sinks.replace_by_prefix(t.part.select("p_partkey", "p_name"), fresh, "p_name", "red")


@query("snk_09_job_stats", "SELECT event_type AS stage, CASE WHEN value < 5 THEN 'failed' ELSE 'completed' END AS status, count(*) AS n FROM events GROUP BY stage, status")
def snk_09(t):
    jobs = t.events.select(c("event_id").alias("job"), c("event_type").alias("stage"), F.lit("pending").alias("status"), F.lit(2).alias("retries"))
    done = t.events.select(c("event_id").alias("job"), c("ts").alias("at"), (c("value") >= 5).alias("ok"))
    return sinks.job_states(jobs, done).groupBy("stage", "status").agg(F.count("*").alias("n"))


@query("st_05_incremental_recompute", "WITH ch AS (SELECT DISTINCT user_id FROM events WHERE ts > TIMESTAMP '2024-01-29 00:00:00') SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id IN (SELECT user_id FROM ch) GROUP BY user_id")
def st_05(t):
    changed = t.events.where(c("ts") > F.lit("2024-01-29").cast("timestamp")).select("user_id")
    return streams.recompute_changed(t.events, changed, "user_id", lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))


@query("st_06_next_mark", "SELECT CAST(epoch_us(max(ts)) AS BIGINT) AS mark FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def st_06(t):
    new = readers.changed_since(t.events, "ts", F.lit("2024-01-20").cast("timestamp"))
    return readers.next_mark(new, "ts").select(F.unix_micros("mark").alias("mark"))


def text_files(df, name, group, value):
    """One file a group with a single line each, so that a file is one document."""
    path = scratch(df.sparkSession, name)
    df.select(group, value).repartition(group).write.partitionBy(group).text(path)
    return path


@query("src_01_packed_csv", "SELECT CAST(p_partkey AS VARCHAR) AS orgnr, 'ORG' AS kind, p_name AS name, nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END, '') AS street, CAST(p_size AS VARCHAR) AS size FROM part WHERE p_partkey % 4 <> 0")
def src_01(t):
    key, path = c("p_partkey"), scratch(t.spark, "packed")
    street = F.when(key % 3 == 0, "").otherwise(c("p_type"))
    size = F.when(key % 4 != 0, c("p_size"))  # rows without it have too few columns
    t.part.select(F.concat(key.cast("string"), F.lit("$ORG")).alias("id"), F.concat_ws("$", "p_name", street).alias("who"), size.alias("size")).write.csv(path, sep=";", header=True)
    return readers.packed_csv(t.spark, path, {"id": ["orgnr", "kind"], "who": ["name", "street"]}, least=3)


@query("src_02_registry_tsv", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '5') AS orgnr, 'Åre ' || s_name AS name FROM supplier")
def src_02(t):
    path, own = scratch(t.spark, "registry"), F.lpad(c("s_suppkey").cast("string"), 10, "5")
    written = F.when(c("s_suppkey") % 2 == 0, F.concat(F.lit("16"), own)).otherwise(own)
    t.supplier.select(written.alias("orgnr"), F.concat(F.lit("Åre "), "s_name").alias("name")).write.csv(path, sep="\t", header=True, encoding="ISO-8859-1")
    return readers.registry_tsv(t.spark, path, "orgnr")


@query("src_03_json_companies", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def src_03(t):
    listed = F.collect_list(F.struct(c("s_suppkey").alias("id"), c("s_name").alias("name")))
    docs = t.supplier.groupBy("s_nationkey").agg(F.to_json(F.struct(F.lit(1).alias("meta"), listed.alias("companies"))).alias("value"))
    return readers.json_companies(t.spark, text_files(docs, "companies", "s_nationkey", "value")).select("id", "name")


@query("src_03_json_stream", "SELECT s_suppkey AS id, s_name || ' {\"}]' AS name, s_acctbal AS balance FROM supplier")
def src_03_stream(t):
    inner = F.struct(c("s_acctbal").alias("balance"), F.array(F.lit("]"), F.lit("}")).alias("marks"))
    row = F.to_json(F.struct(c("s_suppkey").alias("id"), F.concat("s_name", F.lit(' {"}]')).alias("name"), inner.alias("inner")))
    whole = F.concat(F.lit('{"meta": {"companies": [1]}, "companies": ['), F.array_join(F.collect_list(row), ", "), F.lit('], "after": [{"id": -1}]}'))
    docs = t.supplier.groupBy("s_nationkey").agg(whole.alias("value"))
    return json_array.json_array(t.spark, text_files(docs, "stream", "s_nationkey", "value"), "id long, name string, inner struct<balance: double>", "companies").select("id", "name", "inner.balance")


@query("src_04_renamed_json", "SELECT s_suppkey AS id, s_name AS name, s_acctbal > 0 AS f_skatt FROM supplier")
def src_04(t):
    flag = F.when(c("s_acctbal") > 0, "Ja").when(c("s_suppkey") % 2 == 0, "Nej")
    docs = t.supplier.groupBy("s_nationkey").agg(F.to_json(F.collect_list(F.struct(c("s_suppkey").alias("nr"), c("s_name").alias("namn"), flag.alias("f_skatt")))).alias("value"))
    return readers.renamed_json(t.spark, text_files(docs, "renamed", "s_nationkey", "value"), {"nr": "id", "namn": "name"}, {"f_skatt": "Ja"})


def zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, content): each page as the only report of an archive; every tenth archive is broken."""
    for pdf in batches:
        rows = []
        for own, html in zip(pdf["page_id"], pdf["html"], strict=True):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("report.xhtml", html or "")
            rows.append((str(own), out.getvalue() if own % 10 else b"broken"))
        yield pd.DataFrame(rows, columns=["path", "content"])


@query("src_06_zipped_reports", "SELECT CAST(page_id AS VARCHAR) AS path, 'report.xhtml' AS member, CAST(0 AS INT) AS at, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages WHERE html LIKE '%<title>%' AND page_id % 10 <> 0")
def src_06(t):
    return readers.archived_reports(t.pages.select("page_id", "html").mapInPandas(zipped, "path string, content binary"), ["title"])


@query("src_09_leaked_rows", "SELECT CAST(c_custkey AS VARCHAR) AS node, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'extra' END AS second, CAST(c_nationkey AS VARCHAR) AS country FROM customer")
def src_09(t):
    path, key = scratch(t.spark, "leaked"), c("c_custkey").cast("string")
    # a comma within a name moves all fields after it, except those that are counted from the end
    rows = t.customer.select(F.concat_ws(",", key, F.when(c("c_custkey") % 2 == 0, c("c_mktsegment")).otherwise(F.concat(F.lit("extra,"), "c_mktsegment")), F.concat(F.lit('"'), c("c_nationkey").cast("string"), F.lit('"'))).alias("value"))
    t.spark.createDataFrame([("node,segment,country",)], "value string").unionByName(rows).write.text(path)
    return readers.leaked_rows(t.spark, path, {"node": 0, "second": 1, "country": -1}, heading="node,segment,country")


@query("src_10_tidy_cube", "SELECT c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, CAST(count(*) AS DOUBLE) AS value FROM customer GROUP BY ALL")
def src_10(t):
    counts = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).groupBy("c_mktsegment")
    cells = counts.agg(F.sort_array(F.collect_list(F.struct(c("c_nationkey"), c("n")))).alias("cells")).withColumn("codes", F.transform("cells", lambda x: x["c_nationkey"].cast("string")))
    places = F.map_from_arrays("codes", F.sequence(F.lit(0), F.size("codes") - 1))
    index = lambda m: F.struct(F.struct(m.alias("index")).alias("category"))
    dimension = F.struct(index(F.create_map("c_mktsegment", F.lit(0))).getField("category").alias("category"))
    cube = F.struct(F.array(F.lit("segment"), F.lit("nation")).alias("id"), F.struct(dimension.alias("segment"), index(places).alias("nation")).alias("dimension"), F.transform("cells", lambda x: x["n"]).alias("value"))
    docs = cells.select("c_mktsegment", F.to_json(cube).alias("value"))
    x = readers.tidy_cube(t.spark, text_files(docs, "cube", "c_mktsegment", "value"))
    return x.select(F.get_json_object("key", "$.segment").alias("segment"), F.get_json_object("key", "$.nation").alias("nation"), "value")


def company_page(page: int, options: dict) -> Iterator[tuple]:
    """A page of a company service that counts its companies."""
    size = int(options["size"])
    for k in range(page * size, (page + 1) * size):
        yield k, f"company {k}"


@query("src_12_paged_service", "SELECT CAST(range AS BIGINT) AS id, 'company ' || range AS name FROM range(1000)")
def src_12(t):
    t.spark.dataSource.register(paged.PagedSource)
    service = t.spark.read.format("paged").option("fetcher", "tarn.plans.sources:company_page").option("pages", 20).option("size", 50)
    return service.schema("id long, name string").load()


FORMS = ("json", "csv", "xml", "parquet")


@query("snk_05_exports", " UNION ALL ".join(f"SELECT '{f}' AS form, s_suppkey, s_name FROM supplier" for f in FORMS))
def snk_05(t):
    x, read = t.supplier.select("s_suppkey", "s_name"), []
    for form in FORMS:
        path = scratch(t.spark, form)
        sinks.export(x, path, form)
        reader = t.spark.read.schema(x.schema).option("header", True).option("rowTag", "row")
        read.append(reader.format(form).load(path).select(F.lit(form).alias("form"), "s_suppkey", "s_name"))
    return read[0].unionByName(read[1]).unionByName(read[2]).unionByName(read[3])


@query("snk_07_saved_graph", "SELECT 'vertex' AS part, s_suppkey AS src, CAST(s_nationkey AS BIGINT) AS dst FROM supplier UNION ALL SELECT DISTINCT 'edge', l_suppkey, l_partkey FROM lineitem")
def snk_07(t):
    path = scratch(t.spark, "graph")
    sinks.save_graph(t.supplier.select("s_suppkey", "s_nationkey"), t.lineitem.select("l_suppkey", "l_partkey").distinct(), path)
    vertices, edges = t.spark.read.parquet(f"{path}/vertices"), t.spark.read.parquet(f"{path}/edges")
    v = vertices.select(F.lit("vertex").alias("part"), c("s_suppkey").alias("src"), c("s_nationkey").cast("long").alias("dst"))
    return v.unionByName(edges.select(F.lit("edge").alias("part"), c("l_suppkey").alias("src"), c("l_partkey").alias("dst")))


def event_stream(t):
    """The events as a stream of their files, with UTC times. A stream reads a single file only through a pattern."""
    source = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    return t.spark.readStream.schema(source.schema).parquet(f"{t.sf_dir}/events.parque[t]").withColumn("ts", c("ts").cast("timestamp"))


def streamed(t, stream, name, mode="append"):
    """What a stream gives for all that is there."""
    table = f"{name}_{scratch(t.spark, name)[-32:]}"
    streams.run_available(stream, table, scratch(t.spark, name), mode)
    return t.spark.table(table)


@query("st_01_available_now", "SELECT event_id, event_type FROM events WHERE value > 60")
def st_01(t):
    return streamed(t, event_stream(t).where("value > 60").select("event_id", "event_type"), "st_01")


@query("st_02_staged_batches", "SELECT 'seen' AS stage, event_id, value FROM events UNION ALL SELECT 'scaled', event_id, value * 2 FROM events WHERE value > 60")
def st_02(t):
    path, x = scratch(t.spark, "staged"), event_stream(t).select("event_id", "value")
    stages = [("seen", lambda df: df), ("scaled", lambda df: df.where("value > 60").withColumn("value", c("value") * 2))]
    streams.staged(x, stages, lambda stage, rows, batch: rows.write.mode("overwrite").parquet(f"{path}/stage={stage}/batch={batch}"), scratch(t.spark, "staged")).awaitTermination()
    return t.spark.read.parquet(path).select("stage", "event_id", "value")


@query("st_04_lockout", """WITH e AS (SELECT user_id AS k, ts, event_type <> 'error' AS ok FROM events WHERE event_type IN ('error', 'purchase')), s AS (SELECT k, max(ts) FILTER (WHERE ok) AS good FROM e GROUP BY k),
f AS (SELECT e.k, e.ts, max(e.ts) OVER (PARTITION BY e.k) AS last FROM e JOIN s ON s.k = e.k WHERE NOT ok AND (good IS NULL OR ts > good)), n AS (SELECT k, count(*) AS failures FROM f WHERE ts > last - INTERVAL 86400 SECOND GROUP BY k)
SELECT CAST(s.k AS VARCHAR) AS key, coalesce(failures, 0) AS failures, coalesce(failures, 0) >= 2 AS blocked FROM s LEFT JOIN n ON n.k = s.k""")
def st_04(t):
    attempts = event_stream(t).where("event_type IN ('error', 'purchase')").select(c("user_id").cast("string").alias("key"), "ts", (c("event_type") != "error").alias("ok"))
    return streamed(t, streams.lockout_stream(attempts, most=2, window_s=86400), "st_04", "update")


@query("st_07_alert_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def st_07(t):
    return streamed(t, streams.dedupe_stream(event_stream(t).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "40 days").select("user_id", "event_type"), "st_07")

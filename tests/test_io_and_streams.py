"""Files in and out, and streams over them."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from tarn.sources import readers, sinks
from tarn.streaming import streams


def test_registry_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;who;n\n"1$ORG";"Foo$Gatan 1";3\n"2$ORG";"Bar$";4\n')
    rows = readers.packed_csv(spark, str(tmp_path / "a.csv"), {"id": ["orgnr", "kind"], "who": ["name", "street"]}).collect()
    assert [(r.orgnr, r.name, r.street, r.n) for r in rows] == [("1", "Foo", "Gatan 1", "3"), ("2", "Bar", None, "4")]
    (tmp_path / "b.tsv").write_bytes("PeOrgNr\tNamn\n165567037485\tÅre\n5567037485\tB\n".encode("latin-1"))
    assert [(r.PeOrgNr, r.Namn) for r in readers.registry_tsv(spark, str(tmp_path / "b.tsv"), "PeOrgNr").collect()] == [("5567037485", "Åre"), ("5567037485", "B")]
    (tmp_path / "c.json").write_text(json.dumps({"meta": 1, "companies": [{"id": 1}, {"id": 2}]}))
    assert {r.id for r in readers.json_companies(spark, str(tmp_path / "c.json")).collect()} == {1, 2}
    (tmp_path / "d.json").write_text(json.dumps([{"n": "x", "f": "Ja"}, {"n": "y", "f": None}]))
    assert [(r.name, r.f) for r in readers.renamed_json(spark, str(tmp_path / "d.json"), {"n": "name"}, {"f": "Ja"}).collect()] == [("x", True), ("y", False)]
    (tmp_path / "e.csv").write_text('node,name,a,country\n1,"X",q,SWE\n2,Y,q,r,NOR\n')
    assert [(r.node, r.country) for r in readers.leaked_rows(spark, str(tmp_path / "e.csv"), {"node": 0, "country": -1}).collect()] == [("1", "SWE"), ("2", "NOR")]


def test_cube_zip_and_uploads(spark, tmp_path):
    cube = {"id": ["a", "b"], "dimension": {"a": {"category": {"index": {"x": 0, "y": 1}}}, "b": {"category": {"index": {"p": 0}}}}, "value": [1, None]}
    (tmp_path / "cube.json").write_text(json.dumps(cube))
    assert [(json.loads(r.key), r.value) for r in readers.tidy_cube(spark, str(tmp_path / "cube.json")).collect()] == [({"a": "x", "b": "p"}, 1.0), ({"a": "y", "b": "p"}, None)]
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("r.xhtml", "<x><ix:name a='1'> Anna </ix:name><ix:name>Bo</ix:name><ix:role>VD</ix:role></x>")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = readers.zipped_reports(spark, str(tmp_path / "*.zip"), ["ix:name", "ix:role"]).orderBy("at").collect()
    assert [(r.member, r.at, r["name"], r.role) for r in got] == [("r.xhtml", 0, "Anna", "VD"), ("r.xhtml", 1, "Bo", None)]
    up = tmp_path / "up"
    up.mkdir()
    (up / "a.html").write_text("<p>Hej &amp; <b>du</b></p><script>x</script>")
    (up / "b.eml").write_text("Subject: x\n\nbody here")
    (up / "c.bin").write_bytes(b"\x00")
    assert {r.kind: (r.text, r.words) for r in readers.uploads(spark, str(up)).collect()} == {"html": ("Hej & du", 3), "eml": ("body here", 2), "bin": (None, None)}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    for form in ("json", "csv", "xml", "parquet"):
        sinks.export(df, str(tmp_path / form), form)
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["id", "name"]
    assert spark.read.format("xml").option("rowTag", "row").load(str(tmp_path / "xml")).count() == 2
    sinks.save_graph(df, df, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 2


def stream_of(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_streaming_detectors(spark, tmp_path):
    rows = [("s1", "r1", 145000.0, f"2024-01-01 0{k}:00:00") for k in range(4)] + [(f"s{k}", "r2", 60000.0, f"2024-01-01 0{k}:30:00") for k in range(4)]
    t = stream_of(spark, tmp_path, rows, "sender string, receiver string, amount double, ts string")
    streams.run_available(streams.structuring_stream(t), "near", str(tmp_path / "c1"), "complete")
    assert {r.sender for r in spark.table("near").collect()} == {"s1"}
    streams.run_available(streams.smurfing_stream(t), "smurf", str(tmp_path / "c2"), "complete")
    assert {r.receiver for r in spark.table("smurf").collect()} == {"r2"}
    e = t.select(F.col("receiver").alias("entity"), "ts")
    streams.run_available(streams.burst_stream(e, gap="2 hours"), "burst", str(tmp_path / "c3"), "complete")
    assert {(r.entity, r.n) for r in spark.table("burst").collect()} == {("r1", 4), ("r2", 4)}
    streams.run_available(streams.velocity_stream(e), "speed", str(tmp_path / "c4"), "complete")
    assert {(r.entity, r.n) for r in spark.table("speed").collect()} == {("r1", 4), ("r2", 4)}
    streams.run_available(streams.dedupe_stream(e, ["entity"]), "once", str(tmp_path / "c5"))
    assert sorted(r.entity for r in spark.table("once").collect()) == ["r1", "r2"]


def test_state_and_stages(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:0{k}:00", False) for k in range(5)] + [("b", "2024-01-01 00:00:00", False), ("b", "2024-01-01 00:01:00", True)]
    t = stream_of(spark, tmp_path, rows, "key string, ts string, ok boolean")
    streams.run_available(streams.lockout_stream(t), "locks", str(tmp_path / "c1"), "update")
    assert {(r.key, r.failures, r.blocked) for r in spark.table("locks").collect()} == {("a", 5, True), ("b", 0, False)}
    seen, tries = [], []

    def flaky(df):
        tries.append(1)
        if len(tries) == 1:
            raise ValueError("once")
        return df.where("ok")

    q = streams.staged(t, [("all", lambda df: df), ("good", flaky)], lambda name, df, n: seen.append((name, df.count())), str(tmp_path / "c2"))
    q.awaitTermination()
    assert seen == [("all", 7), ("good", 1)]


def test_staged_batches_with_a_failing_sink(spark, tmp_path):
    """A stage is not applied to its own output when only its sink failed."""
    rows = spark.range(5).withColumn("x", F.lit(1))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen, broken = [], {"n": 2}

    def sink(name, df, number):
        if name == "more" and broken["n"]:
            broken["n"] -= 1
            raise OSError("full")
        seen.append((name, df.agg(F.sum("x")).first()[0]))

    streams.staged(stream, [("more", lambda df: df.withColumn("x", F.col("x") + 1)), ("most", lambda df: df.withColumn("x", F.col("x") * 10))], sink, str(tmp_path / "c")).awaitTermination()
    assert seen == [("more", 10), ("most", 100)]


def page_of(page, options):
    return [(page * 2 + k, f"row {page}") for k in range(2)]


def test_paged_source(spark):
    from tarn.sources.paged import PagedSource

    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").option("fetcher", "tests.test_io_and_streams:page_of").option("pages", 3).schema("id long, name string").load()
    assert sorted(r.id for r in df.collect()) == list(range(6))


def test_detector_registry(spark):
    from tarn.plans.detectors import Detector, Registry

    r = Registry([Detector("x", "low", "t", lambda t: t, ["a"])])
    r.add(Detector("y", "high", "u", lambda t: t, ["a", "b"]))
    df = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    assert r.run(df).count() == 4
    r.disable("x")
    assert {tuple(row.entity_ids) for row in r.run(df).collect()} == {("1", "2"), ("3", "4")}
    assert [d.name for d in r.by_typology("t")] == ["x"]
    assert r.check(df, spark.createDataFrame([("4",)], "entity string")).count() == 1

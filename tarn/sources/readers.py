"""Readers of registry files, and the parse stages behind registry services."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import small_batches
from ..operators.text import html_text, tagged_fields


def packed_csv(spark: SparkSession, path: str, packed: dict[str, Sequence[str]], separator: str = ";", least: int = 0) -> DataFrame:
    """A CSV whose columns hold fields joined by $; `packed` names the parts of a column. Rows with fewer than `least` filled columns go."""
    df = spark.read.csv(path, sep=separator, header=True, quote='"', escape='"')
    if least:
        df = df.where(sum(F.col(c).isNotNull().cast("int") for c in df.columns) >= least)
    out = []
    for c in df.columns:
        out += [F.nullif(F.btrim(F.get(F.split(c, "\\$"), F.lit(k))), F.lit("")).alias(name) for k, name in enumerate(packed[c])] if c in packed else [F.col(c)]
    return df.select(*out)


def registry_tsv(spark: SparkSession, path: str, id_column: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """A tab-separated registry; twelve-digit ids lose their prefix 16."""
    df = spark.read.csv(path, sep="\t", header=True, encoding=encoding)
    x = F.btrim(id_column)
    return df.withColumn(id_column, F.when((F.length(x) == 12) & F.startswith(x, F.lit("16")), F.substring(x, 3, 10)).otherwise(x))


def json_companies(spark: SparkSession, path: str, field: str = "companies") -> DataFrame:
    """One row an element of a JSON array nested under `field`."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("x")).select("x.*")


def renamed_json(spark: SparkSession, path: str, names: dict[str, str], flags: dict[str, str]) -> DataFrame:
    """A JSON list with keys renamed; a flag column is true where its text equals the given one."""
    df = spark.read.json(path, multiLine=True)
    return df.select(*[F.col(k).alias(v) for k, v in names.items()], *[F.coalesce(F.col(k) == v, F.lit(False)).alias(k) for k, v in flags.items()])


def changed_since(df: DataFrame, column: str, since: Column | None) -> DataFrame:
    """Rows newer than `since`, all rows without one; the highest value seen is the next mark."""
    return df if since is None else df.where(F.col(column) > since)


def next_mark(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("mark"))


def leaked_rows(spark: SparkSession, path: str, fields: dict[str, int], separator: str = ",", heading: str | None = None) -> DataFrame:
    """Lines cut at every separator; fields by position, from the end if negative. Lines equal to the heading go: the one given, else the first line of one file."""
    lines = spark.read.text(path).where(F.col("value") != "")
    head = (heading,) if heading is not None else lines.first()
    parts = F.split("value", separator)
    rows = lines.where(F.col("value") != head[0]) if head else lines
    return rows.select(*[F.btrim(F.try_element_at(parts, F.lit(k + 1 if k >= 0 else k)), F.lit('" ')).alias(n) for n, k in fields.items()])


def tidy_cube(spark: SparkSession, path: str) -> DataFrame:
    """A json-stat cube {id, size, dimension: {d: {category: {index: {code: place}}}}, value} as rows (one column a dimension, value)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import itertools
        import json

        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                cube = json.loads(text)
                codes = [sorted(cube["dimension"][d]["category"]["index"].items(), key=lambda kv: kv[1]) for d in cube["id"]]
                for key, value in zip(itertools.product(*codes), cube["value"], strict=True):
                    rows.append((json.dumps({d: k[0] for d, k in zip(cube["id"], key, strict=True)}), None if value is None else float(value)))
            yield pd.DataFrame(rows, columns=["key", "value"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "key string, value double")


ORGANISATION = "identitet STRUCT<identitetsbeteckning: STRING>, namn ARRAY<STRUCT<namn: STRING>>, organisationsform STRUCT<kod: STRING>, registreringsdatum STRING, adress STRUCT<utdelningsadress: STRING, postnummer: STRING, postort: STRING>, avregistrering STRUCT<datum: STRING>"


def flat_company(df: DataFrame, column: str) -> DataFrame:
    """A nested organisation document (JSON text) as one flat row; unknown fields are null."""
    x = df.select(F.from_json(column, ORGANISATION).alias("o"))
    place = F.concat_ws(", ", "o.adress.utdelningsadress", F.concat_ws(" ", "o.adress.postnummer", "o.adress.postort"))
    return x.select(F.col("o.identitet.identitetsbeteckning").alias("orgnr"), F.get("o.namn", F.lit(0))["namn"].alias("name"), F.col("o.organisationsform.kod").alias("form"), F.try_to_date("o.registreringsdatum", "yyyy-MM-dd").alias("registered"), F.nullif(place, F.lit("")).alias("address"), F.col("o.avregistrering.datum").isNotNull().alias("removed"))


def zipped_reports(spark: SparkSession, path: str, tags: Sequence[str]) -> DataFrame:
    """Tagged fields of the XHTML reports in the ZIP files of a folder (see archived_reports)."""
    return archived_reports(spark.read.format("binaryFile").load(path), tags)


def archived_reports(files: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Tagged fields of the XHTML reports in archives (path, content): (path, member, at, one column a tag, named without its prefix). Broken archives give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        rows += [(where, n, archive.read(n).decode("utf-8", "replace")) for n in archive.namelist() if n.lower().endswith((".xhtml", ".html", ".xml"))]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["path", "member", "text"])

    small_batches(files.sparkSession)
    texts = files.select("path", "content").mapInPandas(run, "path string, member string, text string")
    fields = tagged_fields(texts.withColumn("id", F.struct("path", "member")), tags, "id", "text")
    return fields.select("doc_id.path", "doc_id.member", "at", *[t.split(":")[-1] for t in tags])


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text, words) of text, HTML and mail files; other kinds have null text."""
    x = spark.read.format("binaryFile").load(path).select("path", F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1)).alias("kind"), F.col("content").cast("string").alias("raw"))
    mail = F.btrim(F.regexp_extract("raw", "(?s)\\r?\\n\\r?\\n(.*)$", 1))
    text = F.when(F.col("kind").isin("txt", "csv", "md"), F.col("raw")).when(F.col("kind").isin("html", "htm", "xhtml"), html_text(F.col("raw"))).when(F.col("kind") == "eml", mail)
    return x.select("path", "kind", text.alias("text")).withColumn("words", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\\s+"))))

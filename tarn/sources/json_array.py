"""A splittable reader of JSON arrays: one large file is read by as many tasks as it has splits, in DataFrame functions alone.

Spark cuts the file at closing braces, which its text source does in any byte range and file system. Which of them really end an element is
then settled by running sums in file order: whether a piece begins inside a string follows from the quotes before it, its depth from the braces outside
strings before it. An escape never spans two pieces, as a brace is not escaped in JSON. Pieces are summed by split, splits by
file, so no task holds a file. An element belongs to the piece that it begins in, and is put together from its pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

PLACE = ("file", "split")
#: What may stand before an element's brace: no brace outside strings. BROKEN begins inside a string.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
LEAD = rf'[^"{{]*+(?:{STRING}[^"{{]*+)*+'
BROKEN = rf'[^"\\]*+(?:\\.[^"\\]*+)*+"{LEAD}'


def _before(pieces: DataFrame, columns: Sequence[str]) -> DataFrame:
    """pieces with <c>_before: the sum of column c over all earlier pieces of the file."""
    parts = pieces.groupBy(*PLACE).agg(*[F.sum(c).alias(f"{c}_part") for c in columns])
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    parts = parts.select(*PLACE, *[F.coalesce(F.sum(f"{c}_part").over(earlier), F.lit(0)).alias(f"{c}_part") for c in columns])
    inside = Window.partitionBy(*PLACE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    out = pieces.withColumns({f"{c}_own": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}).join(parts, list(PLACE))
    return out.select(*pieces.columns, *[(F.col(f"{c}_own") + F.col(f"{c}_part")).alias(f"{c}_before") for c in columns])


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def json_array_texts(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """(file, element): the text of each object in the array at the top of the files, or under the top-level `key`.

    Elements are objects, with any braces, brackets, quotes and escapes in them and in their strings; other elements are passed over. What comes before and after
    the array is left out; an array that a file lacks gives none; an unfinished last element gives none.
    """
    base = 0 if key is None else 1
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("file_size")]
    raw = spark.read.text(path, lineSep="}").select("value", *meta, F.monotonically_increasing_id().alias("at"))
    # a file that ends in the middle of an element has no brace after its last piece
    lengths = raw.groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("read"), F.max("file_size").alias("size"), F.max(F.struct("split", "at")).alias("last"))
    cut = lengths.where("read > size").select("file", F.col("last.split").alias("split"), F.col("last.at").alias("at"))
    pieces = raw.withColumn("plain", F.regexp_replace("value", r"(?s)\\.", "")).withColumn("quotes", _count(F.col("plain"), '"'))
    pieces = _before(pieces, ["quotes"])
    quoted = F.col("quotes_before") % 2 == 1
    strings = r'"[^"]*("|$)'
    bare = F.regexp_replace(F.concat(F.when(quoted, '"').otherwise(""), "plain"), strings, "")
    ends = ((F.col("quotes_before") + F.col("quotes")) % 2 == 0).cast("long")  # its brace is outside strings
    pieces = pieces.select(*PLACE, "at", "value", "plain", quoted.alias("quoted"), bare.alias("bare"), ends.alias("ends"))
    pieces = _before(pieces.withColumn("depth", _count(F.col("bare"), "{") - F.col("ends")), ["depth"])
    begins = F.col("depth_before") == base  # between two elements, or before the array
    if key is None:
        opens = F.lit(0).cast("long")
    else:
        sign = r'"' + key.replace("\\", r"\\") + r'"\s*:\s*\['
        ahead = F.regexp_replace(F.regexp_replace("plain", f"(?s){sign}.*$", ""), strings, "")
        opens = (F.col("plain").rlike(sign) & ~F.col("quoted") & (F.col("depth_before") + _count(ahead, "{") == base)).cast("long")
    listed = F.when(opens > 0, F.regexp_replace(F.regexp_replace("plain", f"(?s)^.*?{sign}", ""), strings, "")).otherwise(F.col("bare")) if key is not None else F.col("bare")
    gap = F.regexp_replace(listed, r"(?s)\{.*$", "")
    closes = ((begins | (opens > 0)) & F.contains(gap, F.lit("]"))).cast("long")
    starts = F.contains(listed, F.lit("{"))
    done = ((F.col("ends") == 1) & (F.col("depth_before") + F.col("depth") == base)).cast("long")
    pieces = _before(pieces.select(*PLACE, "at", "value", "quoted", (begins | (opens > 0)).alias("begins"), starts.alias("starts"), done.alias("done"), opens.alias("opens"), closes.alias("closes")), ["done", "opens", "closes"])
    opened = F.lit(1) if key is None else F.col("opens_before") + F.col("opens")
    inside = pieces.where((opened > 0) & (F.col("closes_before") + F.col("closes") == 0))
    inside = inside.where(~F.col("begins") | F.col("starts")).join(cut, ["file", "split", "at"], "left_anti")
    # a piece that begins an element starts at its brace, beyond the key where it opens the array
    text = F.when(F.col("begins"), F.regexp_replace("value", "(?s)^" + LEAD, ""))
    text = F.when(F.col("begins") & F.col("quoted"), F.regexp_replace("value", "(?s)^" + BROKEN, "")).otherwise(text)
    if key is not None:
        text = F.when(F.col("opens") > 0, F.regexp_replace("value", f"(?s)^.*?{sign}{LEAD}", "")).otherwise(text)
    text = F.concat(F.coalesce(text, F.col("value")), F.lit("}"))
    elements = inside.groupBy("file", F.col("done_before").alias("number")).agg(F.max("done").alias("whole"), F.sort_array(F.collect_list(F.struct("split", "at", text.alias("text")))).alias("parts"))  # one element's pieces
    return elements.where("whole = 1").select("file", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("element"))


def json_array(spark: SparkSession, path: str, schema: StructType | str, key: str | None = None) -> DataFrame:
    """The elements of json_array_texts as rows of the schema; fields that an element lacks are null."""
    return json_array_texts(spark, path, key).select(F.from_json("element", schema).alias("x")).select("x.*")

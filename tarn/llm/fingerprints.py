"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a piece of text up to and with a line feed, or up to and with a sentence mark and white space. Each is
hashed to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, each lane modulo a
power of two. So the order of paragraphs does not matter, equal multisets have equal fingerprints, and inserting or
deleting a paragraph adds or subtracts its vector (`insert`, `delete`) without reading the rest.

Lanes: two wide ones (2 ** 62) for equality; then 120 lanes modulo 2 ** 20 that each get one bit of two more hashes, three to a long;
and the count. With n paragraphs, 2 * lane - n is a sum of random signs, so the mean product over the
lanes of two documents estimates how many paragraphs they share: the likeness is the cosine of those vectors, at least 0, with a standard
error of about 1 / sqrt(120) = 0.09 near 0. Beyond 2 ** 20 paragraphs the lanes wrap, which only the likeness feels.

Everything is DataFrame functions; a text is hashed in its own row, so no group is gathered. What follows what is found on thin rows
(id, hash, number of characters): they alone are dealt by ranges and sorted. Texts meet their row's number of characters by an equality join, and each sends
the beginning that its predecessor needs, and its vector, by another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._cluster import durable

WIDE = (1 << 62) - 1
LANE = (1 << 20) - 1
#: Three lanes of 20 bits, each followed by a bit that takes the carry until it is cleared.
STEP = 21
LANES = 40
ONES = 1 | 1 << STEP | 1 << 2 * STEP
CLEAR = LANE | LANE << STEP | LANE << 2 * STEP
PARAGRAPH = "(?<=\\n)|(?<=[.!?…][ \\t])|(?<=[。！？।။。])"


def paragraphs(text: Column) -> Column:
    """The pieces of a text; they join to the text again. An empty or null text has none."""
    return F.when(F.length(text) > 0, F.array_remove(F.split(text, PARAGRAPH), "")).otherwise(F.array().cast("array<string>"))


def _low(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("long"))


def _hashes(pieces: Column, seed: int) -> Column:
    return F.transform(pieces, lambda p: F.xxhash64(p, F.lit(seed)))


def _add_signs(shift: int):
    return lambda total, h: _low(total + _low(F.shiftrightunsigned(h, shift), ONES), CLEAR)


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column computed once a row. A generator of one row keeps the optimizer from copying `value` into each place that uses it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_vector(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the fingerprint of a text column, as an array of longs: two wide lanes, LANES packed ones, the count."""
    df = fixed(df, "__pieces", paragraphs(F.col(text)))
    df = fixed(df, "__signs", F.array(_hashes(F.col("__pieces"), 3), _hashes(F.col("__pieces"), 4)))
    zero = F.lit(0).cast("long")
    out = [F.aggregate(_hashes(F.col("__pieces"), seed), zero, lambda a, h: _low(a + _low(h, WIDE), WIDE)) for seed in (1, 2)]
    out += [F.aggregate(F.get("__signs", F.lit(k)), zero, _add_signs(j)) for k in range(2) for j in range(LANES // 2)]
    out.append(_low(F.size("__pieces").cast("long"), LANE))
    return fixed(df, name, F.array(*out)).drop("__pieces", "__signs")


def _sum(x: Column, y: Column, sign: int) -> Column:
    """Lane by lane, modulo the lanes' powers. The borrow of a subtraction is taken from a lane's carry bit."""
    wide = [_low(F.get(x, k) + F.lit(WIDE + 1) - F.get(y, k), WIDE) if sign < 0 else _low(F.get(x, k) + F.get(y, k), WIDE) for k in range(2)]
    spare = (LANE + 1) * ONES - (1 << 63 if (LANE + 1) * ONES >= 1 << 63 else 0)
    rest = [_low(F.get(x, k).bitwiseOR(F.lit(spare).cast("long")) - F.get(y, k), CLEAR) if sign < 0 else _low(F.get(x, k) + F.get(y, k), CLEAR) for k in range(2, 2 + LANES)]
    n = F.get(x, 2 + LANES) - F.get(y, 2 + LANES) + F.lit(LANE + 1) if sign < 0 else F.get(x, 2 + LANES) + F.get(y, 2 + LANES)
    return F.array(*wide, *rest, _low(n, LANE))


def insert(fingerprint: Column, added: Column) -> Column:
    """The fingerprint vector after inserting text pieces whose vector is `added`, anywhere."""
    return _sum(fingerprint, added, 1)


def delete(fingerprint: Column, gone: Column) -> Column:
    """The fingerprint vector after deleting pieces whose vector is `gone`."""
    return _sum(fingerprint, gone, -1)


def as_text(vector: Column) -> Column:
    """A fixed-width hexadecimal form."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.get(vector, k)), 16, "0")) for k in range(3 + LANES)])


def signs(vector: Column) -> Column:
    """2 * lane - n of the sign lanes."""
    n = F.get(vector, 2 + LANES)
    return F.array(*[2 * _low(F.shiftrightunsigned(F.get(vector, 2 + j), STEP * k), LANE) - n for j in range(LANES) for k in range(3)])


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a * b).cast("double")), F.lit(0.0), lambda a, b: a + b)


def likeness(x: Column, y: Column, sx: Column, sy: Column) -> Column:
    """0 to 1; 1 for equal fingerprints, 0 where one is of an empty text."""
    cosine = F.try_divide(_dot(sx, sy), F.sqrt(_dot(sx, sx) * _dot(sy, sy)))
    return F.when(x == y, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def _chain(rows: DataFrame, each: int) -> DataFrame:
    """(key, before): each row's predecessor as (key, doc_id, half), half being how many characters it needs of the row. rows: key, doc_id, tie, n; each key once.

    Rows are dealt into ranges of about `each` by (doc_id, tie) in order, so a repeated or null id is as many ranges as it needs.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("key")]
    parts = max(1, -(-rows.count() // each))
    own = F.struct("key", "doc_id", F.floor(F.col("n") / 2).cast("int").alias("half"))
    dealt = durable(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    line = Window.partitionBy("part").orderBy(*order)
    linked = durable(dealt.select("key", "part", own.alias("own"), F.lag(own).over(line).alias("before"), F.lead("key").over(line).alias("after")))
    # a row per range
    ends = Window.orderBy("part")
    whole = ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = linked.where("after is null").select(F.coalesce(F.lead("part", 1).over(ends), F.min("part").over(whole)).alias("part"), F.col("own").alias("last"))
    heads = linked.where("before is null").join(last, "part").select("key", F.col("last").alias("before"))
    return heads.unionByName(linked.where("before is not null").select("key", "before"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", each: int = 1_000_000) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    text in descending doc_id; after the last comes the first. Null texts are empty. Null ids come last; rows
    of equal id follow each other by the text's hash. Rows of equal id and text each get a row, but are one in the order, so all of them have the same next. A
    single document is its own next. An empty table gives an empty result; other columns are ignored, whatever their names. Texts are
    hashed whole, however long.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("key", F.xxhash64("doc_id", "text"))
    # both joins below take this, so its shuffle is done once
    texts = base.select("key", "text")
    thin = durable(base.select("key", "doc_id", F.xxhash64("text").alias("tie"), F.length("text").alias("n")).groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("tie").alias("tie"), F.first("n").alias("n"), F.count("*").alias("rows")))
    chain = durable(_chain(thin.select("key", "doc_id", "tie", "n"), each).join(thin.select("key", "rows"), "key"))
    begun = with_vector(texts.join(chain, "key"), "text", "w").select(F.col("before.key").alias("key"), F.col("before.doc_id").alias("doc_id"), F.substring("text", F.lit(1), F.col("before.half")).alias("next"), "w", "rows")
    if thin.where("rows > 1").isEmpty():
        begun = begun.drop("rows")
    else:
        again = begun.where("rows > 1").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("next").alias("next"), F.first("w").alias("w"))
        begun = begun.where("rows = 1").drop("rows").unionByName(again)
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.col("next"))
    rows = with_vector(texts.join(begun, "key"), "text", "v")
    rows = fixed(rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("x"), "v", "w"), "edited", F.col("x"))
    rows = with_vector(rows.select("doc_id", "n_chars", "edited", "v", "w"), "edited", "e")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "v", "e", "w")
    for x in "vew":
        rows = fixed(rows, f"s{x}", signs(F.col(x)))
    near = lambda y, sy: likeness(F.col("v"), F.col(y), F.col("sv"), F.col(sy))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("v")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), near("e", "se").alias("near_edited"), near("w", "sw").alias("near_next"))

"""Sharding by histogram sort: shards of nearly equal bytes, cut in one global order.

Rows are ordered by (group, place, id): group is a hash of the text, so copies are neighbours; place is a hash of the id. Cuts are
wanted at k / shards of all bytes. They are found without sorting: each round counts the exact bytes below the
boundaries of finer and finer probe bins around each cut, over all partitions, until a bin holds one group. A
group goes whole to the shard in which its middle byte falls, if it is at most `tolerance` of a shard; a
larger one (a third of all rows may be copies) is cut inside, by the same refinement over places. Then
every row knows its shard, and rows move once.

Slots count within a shard: sub-bins by a hash of the row, numbered in themselves, and offset by the sizes of those before.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._cluster import durable

#: Keys are the first 15 hexadecimal digits of an MD5, so from 0 to TOP - 1.
TOP = 1 << 60


def key_of(value: Column) -> Column:
    """A uniform 60-bit key."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def _refine(rows: DataFrame, key: str, cuts: dict[int, int], bins: int) -> dict[int, tuple[int, int, int]]:
    """For each wanted byte position: (key, bytes below it, bytes of it) of the key at that position.

    `cuts` maps a number to a position. Each round replaces a range by the one of its `bins` bins that holds the position; all cuts
    are counted in one pass.
    """
    spans = {k: (0, TOP, 0) for k in cuts}  # from, to, bytes below
    found: dict[int, tuple[int, int, int]] = {}
    while spans:
        ranges = sorted({(a, b) for a, b, _ in spans.values()})
        width = {(a, b): max(1, -(-(b - a) // bins)) for a, b in ranges}
        which = F.array(*[F.when((F.col(key) >= a) & (F.col(key) < b), F.struct(F.lit(i).alias("span"), F.floor((F.col(key) - a) / width[a, b]).cast("long").alias("bin")) if width[a, b] < 1 << 52 else F.struct(F.lit(i).alias("span"), F.expr(f"({key} - {a}L) div {width[a, b]}L").alias("bin"))) for i, (a, b) in enumerate(ranges)])
        counted = rows.select(F.explode(F.array_compact(which)).alias("x"), "size", key).groupBy("x.span", "x.bin").agg(F.sum("size").alias("bytes"), F.min(key).alias("low"), F.max(key).alias("high"))
        table: dict[int, list] = {}
        for r in counted.collect():  # bins a range at the utmost
            table.setdefault(r["span"], []).append((r["bin"], r["bytes"], r["low"], r["high"]))
        after = {}
        for k, (a, b, below) in spans.items():
            at = below
            for _, size, low, high in sorted(table.get(ranges.index((a, b)), [])):
                if at + size > cuts[k]:
                    if low == high:
                        found[k] = (low, at, size)
                    else:
                        after[k] = (low, high + 1, at)
                    break
                at += size
        spans = after
    return found


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 1 / 16, bins: int = 256, slot_bins: int = 256) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes plus 1, for a null text 1; its crc32 is that of the empty text. Equal texts share a shard unless
    they make up more than `tolerance` of one. Repeated rows are neighbours and each get a slot. Null ids are placed as
    the empty id. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key_of(text).alias("group"))
    rows = durable(rows.withColumn("place", key_of(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    total = rows.agg(F.sum("size")).first()[0] or 0
    # the k-th cut is before the first byte that belongs to shard k
    cuts = {k: -(-total * k // shards) for k in range(1, shards) if -(-total * k // shards) < total}
    most = total / shards * tolerance
    shard = F.lit(0)
    for k, (group, below, size) in _refine(rows, "group", cuts, bins).items():
        after = F.col("group") > group
        here = F.col("group") == group
        if size <= most:
            if 2 * below + size > 2 * cuts[k]:
                after = after | here
        else:
            inside = _refine(rows.where(here), "place", {0: cuts[k] - below}, bins)
            place, under, own = inside[0]
            # rows of one place are cut at the nearer end
            edge = (F.col("place") >= place) if 2 * under + own > 2 * (cuts[k] - below) else (F.col("place") > place)
            after = after | (here & edge)
        shard = shard + after.cast("int")
    rows = rows.withColumn("shard", shard.cast("int")).withColumn("bin", F.pmod(F.xxhash64("group", "place", F.lit(11)), F.lit(slot_bins)).cast("int"))
    counts = rows.groupBy("shard", "bin").agg(F.count("*").alias("n"))  # shards * slot_bins rows
    offsets = counts.select("shard", "bin", (F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("offset"))
    number = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("group", "place", "doc_id")) - 1
    out = rows.withColumn("number", number).join(F.broadcast(offsets), ["shard", "bin"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

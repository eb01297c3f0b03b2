"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

A window of a document is as many words as a benchmark item has, or the whole text where that is shorter, at any offset. The
similarity of a window and an item is the weighted Jaccard of their five-word shingles: the sum of the smaller counts over the sum
of the larger ones.

1. Two of m and m' shingles that reach similarity t share at least t (m + m') / (1 + t). So a window counts only if as many
   of its places hold a shingle of the item. Those windows are found exactly, from the sorted places alone: if place i is the
   first one at or after a window's start, then the start lies after place i - 1 and place i + need - 1 lies in the window.
2. Such a window's fingerprint is the 128-bit SimHash of all its shingles, each weighing as often as it occurs. Fingerprints are cut into
   radius + 1 blocks: two that differ in at most `radius` bits agree in one, so an equality join on (item, block, its
   bits) finds every pair within the radius. At a similarity of 0.75 a bit differs with probability 0.17: 22 bits, and more
   than 48 once in some ten million.
3. The pairs found are compared on the shingles themselves.

Everything is DataFrame functions. The benchmark is the query set: its shingles, and the runs of window starts, are broadcast
only up to `broadcast_rows` rows, and joined by shuffles beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import durable, free_name

SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column | str) -> Column:
    """The text's words, A-Z lower-cased; an empty array for null and blank texts."""
    parts = F.array_remove(F.split(F.translate(text, UPPER, LOWER), SPACE), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def word_hashes(text: Column | str) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, size: int) -> Column:
    """Hashes of all runs of `size` words, in order."""
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
    return F.when(n >= size, runs).otherwise(F.array().cast("array<bigint>"))


#: Bits of one of the three counters in a long, so a window has up to four million shingles.
LANES = 22
#: Windows of one text that a row holds at a time.
CHUNK = 256
#: Longs of a fingerprint. Each has 64 bits of the tokens hashed with another seed.
LONGS = 2


def _shifted(x: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, bits)


def _numbers(n: int) -> Column:
    """0 to n - 1. Functions of them keep plans small, which a column for each would not."""
    return F.sequence(F.lit(0), F.lit(n - 1))


def _seeded(seed: int):
    return lambda x: F.xxhash64(x, F.lit(seed))


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column computed once a row. A generator of one row keeps the optimizer from copying `value` into each place that uses it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_simhash(df: DataFrame, tokens: str, name: str) -> DataFrame:
    """df with the SimHash of an array of hashes, an element per occurrence, as an array of longs. Three bit counters share a long."""
    mask = F.lit(1 | 1 << LANES | 1 << 2 * LANES)
    zero = F.lit(0).cast("long")
    df = fixed(df, "__hashes", F.array(*[F.transform(tokens, _seeded(seed)) for seed in range(LONGS)]))
    counted = lambda hashes: F.transform(_numbers(LANES), lambda j: F.aggregate(hashes, zero, lambda total, x: total + _shifted(x, j).bitwiseAND(mask)))
    df = fixed(df, "__counters", F.transform("__hashes", counted))

    def long_of(counters: Column) -> Column:
        count = lambda bit: _shifted(F.get(counters, bit % LANES), LANES * F.floor(bit / LANES).cast("int")).bitwiseAND(F.lit((1 << LANES) - 1))
        power = lambda bit: F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        return F.aggregate(_numbers(64), zero, lambda out, bit: out.bitwiseOR(F.when(2 * count(bit) > F.size(tokens), power(bit)).otherwise(zero)))

    return fixed(df, name, F.transform("__counters", long_of)).drop("__hashes", "__counters")


def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks or some more, none of which lies in two longs."""
    each = -(-(radius + 1) // LONGS)
    sizes = [64 // each + (j < 64 % each) for j in range(each)]
    return [(64 * k + sum(sizes[:j]), size) for k in range(LONGS) for j, size in enumerate(sizes)]


def _block_values(fingerprint: str, radius: int) -> Column:
    """The bits of each block, in order."""
    places = F.array(*[F.lit(at) for at, _ in blocks(radius)])
    masks = F.array(*[F.lit((1 << size) - 1) for _, size in blocks(radius)])
    return F.zip_with(places, masks, lambda at, mask: _shifted(F.get(fingerprint, F.floor(at / 64).cast("int")), at % 64).bitwiseAND(mask))


def _distance() -> Column:
    bits = F.zip_with("mark", "item_mark", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(bits, F.lit(0), lambda total, n: total + n)


def _first_equal_block() -> Column:
    """The number of the first block that is equal, so that each pair is verified once."""
    return (F.array_position(F.zip_with("blocks", "item_blocks", lambda a, b: a == b), True) - 1).cast("int")


def _starts(spots: str, need: str, width: str, last: str) -> Column:
    """Runs (lo, hi) of the window starts 0 to `last` whose `width` places hold at least `need` of the sorted `spots`."""
    at = lambda i: F.get(spots, i)
    lo = lambda i: F.greatest(F.lit(0), at(i + F.col(need) - 1) - F.col(width) + 1, F.coalesce(at(i - 1) + 1, F.lit(0)))
    runs = F.transform(F.sequence(F.lit(0), F.size(spots) - F.col(need)), lambda i: F.struct(lo(i).alias("lo"), F.least(at(i), F.col(last)).alias("hi")))
    return F.filter(runs, lambda r: r["lo"] <= r["hi"])


def weighted_jaccard(x: str, y: str) -> Column:
    """Sum of the smaller counts over the sum of the larger ones, of two arrays as multisets."""
    times = lambda array, t: F.size(F.filter(array, lambda e: e == t))
    both = F.aggregate(F.array_distinct(y), F.lit(0), lambda a, t: a + F.least(times(F.col(x), t), times(F.col(y), t)))
    return both / (F.size(x) + F.size(y) - both).cast("double")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 5, similarity: float = 0.75, radius: int = 48, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, item_id, start, similarity, text_key): the best window of each item in each contaminated document.

    start counts words from 0; of windows that are as similar, the first. A document shorter than the item is compared as a
    whole. Items of fewer than `size` words are one shingle of all their words. Null or empty texts match nothing. Rows of equal
    id and text count once; null ids are kept; text_key = xxhash64(id, text) tells rows apart. Items of equal text, or equal id,
    are compared once and all reported. Empty tables give an empty result. Texts are read whole, however long: a task
    holds one text and CHUNK of its windows. Other columns are ignored, whatever their names.
    """
    items = fixed(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("t")), "hashes", word_hashes(F.col("t"))).where("size(hashes) > 0")
    items = items.withColumn("words", F.size("hashes")).withColumn("size", F.least(F.lit(size), F.col("words")))
    sizes = [r[0] for r in items.select("size").distinct().collect()] or [size]
    of_size = lambda column: F.coalesce(*[F.when(F.col("size") == k, shingle_hashes(F.col(column), k)) for k in sizes])
    named = durable(fixed(items, "item", of_size("hashes")).select("item_id", F.xxhash64("words", "item").alias("no"), "words", "size", "item"))
    items = durable(with_simhash(named.select("no", "words", "size", "item").dropDuplicates(["no"]), "item", "item_mark"))
    grams = durable(items.select("no", "words", "size", F.explode(F.array_distinct("item")).alias("token")))
    small = F.broadcast if grams.count() <= broadcast_rows else (lambda df: df)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    hashed = fixed(base, "hashes", word_hashes(F.col("text"))).select("key", "hashes")
    hits = None
    for k in sizes:
        found = hashed.select("key", F.size("hashes").alias("n"), F.posexplode(shingle_hashes(F.col("hashes"), k)).alias("pos", "token"))
        found = found.join(small(grams.where(F.col("size") == k)), "token").select("key", "n", "no", "words", "size", "pos")
        hits = found if hits is None else hits.unionByName(found)
    spots = hits.groupBy("key", "n", "no", "words", "size").agg(F.sort_array(F.collect_set("pos")).alias("spots"))
    spots = spots.withColumn("long", F.least("n", "words")).withColumn("width", F.col("long") - F.col("size") + 1).withColumn("last", F.col("n") - F.col("long"))
    both = F.col("width") + F.col("words") - F.col("size") + 1
    spots = spots.withColumn("need", F.greatest(F.lit(1), F.ceil(similarity / (1 + similarity) * both - 1e-9).cast("int"))).where("size(spots) >= need")
    places = durable(spots.select("key", "no", "size", "long", _starts("spots", "need", "width", "last").alias("runs")).where("size(runs) > 0"))
    if (places.agg(F.sum(F.size("runs"))).first()[0] or 0) <= broadcast_rows:
        laid = base.join(F.broadcast(places), "key")
    else:
        laid = base.join(places, "key")
    laid = fixed(laid, "hashes", word_hashes(F.col("text"))).select("key", "doc_id", "no", "size", "long", "runs", "hashes")
    laid = fixed(laid, "starts", F.flatten(F.transform("runs", lambda r: F.sequence(r["lo"], r["hi"]))))
    parts = F.transform(F.sequence(F.lit(1), F.size("starts"), F.lit(CHUNK)), lambda i: F.slice("starts", i, F.lit(CHUNK)))
    laid = laid.select("key", "doc_id", "no", "size", "long", "hashes", F.explode(parts).alias("starts"))
    cut = F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("hashes", s + 1, F.col("long")).alias("part")))
    cut = laid.select("key", "doc_id", "no", "size", F.explode(cut).alias("w")).select("key", "doc_id", "no", "size", "w.start", "w.part")
    marked = with_simhash(fixed(cut, "window", of_size("part")).select("key", "doc_id", "no", "start", "window"), "window", "mark")
    marked = fixed(marked, "blocks", _block_values("mark", radius))
    probe = marked.select("*", F.posexplode("blocks").alias("block", "bits"))
    index = fixed(items, "item_blocks", _block_values("item_mark", radius))
    index = index.select("no", "item", "item_mark", "item_blocks", F.posexplode("item_blocks").alias("block", "bits"))
    pairs = probe.join(small(index), ["no", "block", "bits"]).where((F.col("block") == _first_equal_block()) & (_distance() <= radius))
    pairs = fixed(pairs.select("key", "doc_id", "no", "start", "window", "item"), "similarity", weighted_jaccard("window", "item")).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before")))
    best = pairs.groupBy("key", "doc_id", "no").agg(best.alias("best"))
    out = best.join(small(named.select("no", "item_id").distinct()), "no")
    return out.select("doc_id", "item_id", (-F.col("best.before")).cast("long").alias("start"), F.col("best.similarity").alias("similarity"), F.col("key").alias("text_key"))


def drop_contaminated(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hits name, by id and text: null ids and repeated rows included. Empty tables drop nothing; the columns of docs stay, whatever their names."""
    mark = free_name(docs)
    bad = hits.select(F.col("text_key").alias(mark)).distinct()
    return docs.join(bad, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")) == F.col(mark), "left_anti")

"""N-gram Jaccard join: token-combination prefixes, then exact verification.

A document is the set of its distinct five-word shingles (the whole sequence, where it has fewer
words). Two documents link when 100 * intersection >= 75 * union. The join is exact:

* Documents with equal sets become one node, so copies cost nothing further.
* Tokens (shingles) are ordered rare first, then frequent, by hash within a class. The class comes from
  counts of all tokens of all documents, kept by hash cell; cells that collide only make tokens count
  as frequent, which never changes the result.
* A set of n tokens may miss e = n - ceil(0.75 n) tokens of a partner. If its first e + 1 tokens are rare,
  they are indexed singly. Otherwise the prefix is extended into the frequent tokens, which are
  split into subclasses and indexed as pairs of one subclass, until the rare tokens plus each
  subclass's tokens but one come to e + 1: then a partner shares a rare token or a pair in each case.
  Subclasses depend on a size level; a set near a level's edge is indexed at both levels. Sets of
  at most 64 tokens, where pairs cannot reach the bound, index their e + 1 first tokens singly.
* Postings of up to `small_group` nodes, fewer than a rare token has, give all pairs of fitting sizes: at most 7.5 for a posting, at any size of the
  corpus. A block of postings sums its pairs, and packs them by buckets of pairs, which add them up. Sets whose prefixes are rare tokens alone are
  compared further only if the prefix tokens that they share leave the needed overlap possible.
* A larger group gives each member a hub (of its band of sizes and the next), so a group of copies costs linear
  time. After the components of these links are known, only members outside their hub group's main component are open.
  Two members of a hub share at most the smaller of their overlaps with the hub, plus what they share outside it. So a
  link that is still missing shows in shared tokens outside the hub (joined on hub and token, large groups of
  which get hubs of their own in the next round), or in both overlaps with the hub being as large as the one needed.
* Pairs are verified on the full sets.

Components are found by star contractions (components.py). The driver holds only the frequent cells, at most
`frequent_cap` of them (the threshold doubles until they fit), and a node filter of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import blocks_for, durable, free_name, give_back, new_dir, ready, release, remove, trim
from ._words import PLACE, U, mix, shingles, steps
from .components import connected_components

BASE_LEVEL = 64
FLUSH = 1 << 20
#: Members of a hub that one task compares with it.
HUB_ROWS = 1000
CELL_BITS = 24
#: The nodes of a round, if so few, go to all tasks, so that no other node's set is moved.
SMALL_ROUND = 50_000


def _set(tokens: np.ndarray) -> np.ndarray:
    return np.unique(tokens)


def _node(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a token set."""
    return int(mix(mix(tokens ^ PLACE[7]).sum(keepdims=True) + U(len(tokens))).view(np.int64)[0])


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for at, _, words in steps(batch.column("text")):
        for k, tokens in enumerate(shingles(words, size)):
            yield at + k, _set(tokens)


def _block(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block, and the next 32 bits of the place within it."""
    x = (hashes >> U(32)) * U(n_blocks)
    return (x >> U(32)).astype(np.int64), (x & U(0xFFFFFFFF)).astype(np.uint32)


def _cell(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    """A count cell of the whole range: block, then CELL_BITS bits."""
    x = (hashes >> U(32)) * U(n_blocks)
    return x >> U(32 - CELL_BITS)


def _spans(block: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(block, from, to) of a sorted array."""
    edges = np.flatnonzero(np.diff(block)) + 1
    bounds = [0, *edges.tolist(), len(block)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            yield int(block[a]), a, b


def allowed_misses(n: int, percent: int = 75) -> int:
    """How many tokens of an n-token set a partner may lack."""
    return n - -(-percent * n // 100)


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int = 75) -> np.ndarray:
    """Index entries of a sorted token set, as 64-bit hashes."""
    n = len(tokens)
    need = allowed_misses(n, percent) + 1
    rare = tokens[~frequent]
    if len(rare) >= need:
        return rare[:need]
    often = tokens[frequent]
    out = [rare]
    if n * percent <= 100 * BASE_LEVEL:  # alone, or with a partner that is, at the base level
        out.append(often[: need - len(rare)])
    level = BASE_LEVEL
    while n > level:
        if n <= 2 * level or n * percent <= 100 * 2 * level:
            out.append(_pairs(often, need - len(rare), level))
        level *= 2
    return np.concatenate(out)


def _pairs(often: np.ndarray, need: int, level: int) -> np.ndarray:
    """Pairs within each of level / 4 subclasses of the shortest run of `often` that reaches the bound."""
    group = (mix(often ^ PLACE[9]) >> U(40)).astype(np.int64) % (level // 4)
    _, first = np.unique(group, return_index=True)
    counts = np.ones(len(often), dtype=np.int64)
    counts[first] = 0
    m = int(np.searchsorted(np.cumsum(counts), need)) + 1
    order = np.argsort(group[:m], kind="stable")
    x, g = often[:m][order], group[:m][order]
    out = []
    for d in range(1, len(x)):
        same = g[:-d] == g[d:]
        if not same.any():
            break
        out.append(mix(x[:-d][same] * PLACE[1] + x[d:][same] * PLACE[2] + U(level)))
    return np.concatenate(out) if out else x[:0]


def _nodes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for k, tokens in _sets(batch, size):
                n[k], node[k] = len(tokens), _node(tokens)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_key"), pa.array(n), pa.array(node)], names=["doc_id", "text_key", "n_shingles", "node"])

    return run


def document_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, node) of each row, written: the size and the name of its set of `size`-word shingles; text_key = xxhash64(id, text)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("doc_id", "text"))
    return durable(own.mapInArrow(_nodes(size), "doc_id long, text_key long, n_shingles long, node long"))


def _distinct(batches: Iterator[pa.RecordBatch], most: int, size: int = 5) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Non-empty token sets and their nodes, some `most` tokens at a time, copies within a portion once."""
    sets: dict[int, np.ndarray] = {}
    held = 0
    for batch in batches:
        for _, tokens in _sets(batch, size):
            if len(tokens) and (node := _node(tokens)) not in sets:
                sets[node] = tokens
                held += len(tokens)
                if held >= most:
                    yield list(sets.values()), list(sets)
                    sets, held = {}, 0
    if sets:
        yield list(sets.values()), list(sets)
    sets = {}
    trim()


def _count_cells(n_blocks: int):
    def run(batches):
        for sets, _ in _distinct(batches, FLUSH):
            cells, counts = np.unique(_cell(np.concatenate(sets), n_blocks), return_counts=True)
            block = (cells >> U(CELL_BITS)).astype(np.int64)
            cells = (cells & U((1 << CELL_BITS) - 1)).astype(np.uint32)
            rows = []
            for k, a, b in _spans(block):
                high = np.bincount(cells[a:b] >> 16, minlength=256).astype(np.uint32)
                many = np.flatnonzero(counts[a:b] > 1).astype(np.uint32)
                rows.append((k, high.tobytes() + cells[a:b].astype(np.uint16).tobytes(), many.tobytes() + counts[a:b][many].astype(np.uint32).tobytes()))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "cells", "many"])

    return run


def _often(least: int):
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << CELL_BITS, dtype=np.uint32)
        for cells, many in zip(group["cells"], group["many"], strict=True):
            high = np.frombuffer(cells[:1024], np.uint32)
            x = np.repeat(np.arange(256, dtype=np.uint32), high) << np.uint32(16) | np.frombuffer(cells[1024:], np.uint16)
            total[x] += 1
            pairs = np.frombuffer(many, np.uint32)
            total[x[pairs[: len(pairs) // 2]]] += pairs[len(pairs) // 2 :] - 1
        cells = np.flatnonzero(total >= least)
        level = np.log2(np.maximum(total[cells], 1)).astype(np.int64)
        del total
        trim()
        return pd.DataFrame([(key[0], int(x), cells[level == x].astype(np.uint32).tobytes()) for x in np.unique(level)], columns=["block", "level", "cells"])

    return run


def frequent_cells(docs: DataFrame, n_blocks: int, least: int, cap: int) -> np.ndarray:
    """Sorted cells of tokens in `least` sets or more, over all documents; the threshold doubles until `cap` suffices."""
    portions = docs.mapInArrow(_count_cells(n_blocks), "block long, cells binary, many binary")
    found = durable(portions.groupBy("block").applyInPandas(_often(least), "block long, level long, cells binary"))
    sizes = sorted(((r[0], r[1] // 4) for r in found.groupBy("level").agg(F.sum(F.length("cells"))).collect()), reverse=True)
    lowest, held = 64, 0
    for level, size in sizes:
        if held + size > cap:
            break
        lowest, held = level, held + size
    parts = [np.frombuffer(r["cells"], np.uint32).astype(U) + (U(r["block"]) << U(CELL_BITS)) for r in found.where(F.col("level") >= lowest).select("block", "cells").collect()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, dtype=U)


def _is_frequent(tokens: np.ndarray, cells: np.ndarray, n_blocks: int) -> np.ndarray:
    if not len(cells):
        return np.zeros(len(tokens), dtype=bool)
    x = _cell(tokens, n_blocks)
    at = np.minimum(np.searchsorted(cells, x), len(cells) - 1)
    return cells[at] == x


#: edge: how far a set is from the middle of its groups, as the share of its tokens that are rare.
POSTING = np.dtype([("sig", "<u4"), ("node", "<i8"), ("n", "<u4"), ("edge", "<u2")])
#: Set in a posting's n where the index entries are the set's first tokens, all rare.
PLAIN = 1 << 31


def _postings(n_blocks: int, index_blocks: int, cells, percent: int):
    def run(batches):
        for sets, nodes in _distinct(batches, 2 * FLUSH):
            marks = _is_frequent(np.concatenate(sets), cells.value, n_blocks)
            ends = np.cumsum([len(s) for s in sets])
            sigs, plain, edge = [], [], []
            for s, e in zip(sets, ends, strict=True):
                own = marks[e - len(s) : e]
                sigs.append(np.unique(signatures(s, own, percent)))
                edge.append(65535 * (len(s) - int(own.sum())) // len(s))
                plain.append(len(s) - own.sum() > allowed_misses(len(s), percent))
            times = [len(s) for s in sigs]
            block, local = _block(mix(np.concatenate(sigs)), index_blocks)
            rows = np.empty(len(block), dtype=POSTING)
            sizes = np.array([len(s) for s in sets], np.uint32) | np.where(plain, np.uint32(PLAIN), np.uint32(0))
            rows["sig"], rows["node"], rows["n"] = local, np.repeat(np.array(nodes, np.int64), times), np.repeat(sizes, times)
            rows["edge"] = np.repeat(np.array(edge, np.uint16), times)
            order = np.argsort(block, kind="stable")
            rows, block = rows[order], block[order]
            out = [(k, rows[a:b].tobytes()) for k, a, b in _spans(block)]
            yield pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], names=["block", "rows"])

    return run


def _fits(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)).astype(bool)


def _needed(n: np.ndarray, m: np.ndarray, plain: np.ndarray, percent: int) -> np.ndarray:
    """How many index entries a linked pair shares at least."""
    overlap = -(-percent * (n + m) // (100 + percent))
    rest = -(-percent * np.maximum(n, m) // 100) - 1
    return np.where(plain, np.maximum(1, overlap - rest), 1)


def band_of(n: np.ndarray, percent: int) -> np.ndarray:
    """Sizes of one band fit each other; sizes two bands apart never do."""
    return np.floor(np.log(n) / -np.log(percent / 100) + 1e-9).astype(np.int64)


PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("needed", "<u4"), ("shared", "<u4")])


def _packed(pairs: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, pairs) of columns a, b, needed, shared; a bucket holds all of what is known of a pair."""
    rows = np.empty(len(pairs), PAIR)
    for k, name in enumerate(PAIR.names):
        rows[name] = pairs[:, k]
    bucket = _block(mix(rows["a"].view(U) * PLACE[1] + rows["b"].view(U) * PLACE[2]), buckets)[0]
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    for k, a, b in _spans(bucket):
        yield k, rows[a:b].tobytes()


def _summed(key, group: pd.DataFrame) -> pd.DataFrame:
    """The distinct memberships, and the pairs that share as many entries as they need."""
    out = []
    for hub, own in group.groupby("hub"):
        rows = np.concatenate([np.frombuffer(x, PAIR) for x in own["pairs"]])
        rows = _sum_pairs([np.column_stack([rows[name].astype(np.int64) for name in PAIR.names])])
        rows = rows if hub else rows[rows[:, 3] >= rows[:, 2]]
        out.append(pd.DataFrame({"hub": bool(hub), "a": rows[:, 0], "b": rows[:, 1]}))
    return pd.concat(out)


def _sum_pairs(parts: list[np.ndarray]) -> np.ndarray:
    """Columns a, b, needed, shared; rows of equal a and b added up."""
    x = np.concatenate(parts)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    first = np.flatnonzero(np.r_[True, (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])])
    out = x[first]
    out[:, 3] = np.add.reduceat(x[:, 3], first)
    return out


def _candidates(small_group: int, percent: int, buckets: int):
    """Pairs (hub false) and memberships (hub true: a is b's hub), packed by buckets."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        rows = np.unique(np.concatenate([np.frombuffer(x, POSTING) for x in group["rows"]]))
        starts = np.flatnonzero(np.r_[True, rows["sig"][1:] != rows["sig"][:-1]])
        sizes = np.diff(np.r_[starts, len(rows)])
        node, n, plain = rows["node"], (rows["n"] & np.uint32(PLAIN - 1)).astype(np.int64), rows["n"] >= PLAIN
        pairs: list[np.ndarray] = []
        for size in np.unique(sizes[(sizes > 1) & (sizes <= small_group)]).tolist():
            at = starts[sizes == size]
            for i in range(size - 1):
                for j in range(i + 1, size):
                    x, y = at + i, at + j
                    keep = _fits(n[x], n[y], percent)
                    x, y = x[keep], y[keep]
                    pairs.append(np.column_stack([node[x], node[y], _needed(n[x], n[y], plain[x] & plain[y], percent), np.ones(len(x), np.int64)]))
            if sum(map(len, pairs)) > 2_000_000:
                pairs = [_sum_pairs(pairs)]
        large = sizes > small_group
        members = []
        if large.any():
            # one order for all blocks, so that the groups of a family of copies have few different hubs
            for a, size in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
                x, band = node[a : a + size], band_of(n[a : a + size], percent)
                edge = rows["edge"][a : a + size]
                hubs = {}
                for k in np.unique(band).tolist():
                    own = np.flatnonzero(band == k)
                    hubs[k] = x[own[np.lexsort((x[own], edge[own]))[0]]]
                for k, hub in hubs.items():
                    with_hub = x[(band == k) | (band == k - 1)]
                    members.append(np.column_stack([np.full(len(with_hub), hub), with_hub])[with_hub != hub])
        both = _sum_pairs(pairs) if pairs else np.zeros((0, 4), np.int64)
        star = np.unique(np.concatenate(members), axis=0) if members else np.zeros((0, 2), np.int64)
        star = np.column_stack([star, np.zeros_like(star)])
        out = [(bucket, hub, blob) for hub, found in ((False, both), (True, star)) for bucket, blob in _packed(found, buckets)]
        return pd.DataFrame(out, columns=["bucket", "hub", "pairs"])

    return run


#: Bits of the node filter that one row holds.
FILTER_BITS = 18


def _filter_block(key, group: pd.DataFrame) -> pd.DataFrame:
    marks = np.zeros(1 << FILTER_BITS, np.uint8)
    marks[group["place"].to_numpy(np.int64) & ((1 << FILTER_BITS) - 1)] = 1
    return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(marks, bitorder="little").tobytes()]})


def _node_filter(nodes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2 ** bits bits with the nodes' places; its size is fixed, and full bits only cost time. The driver gets it packed, in blocks of 32 KB."""
    place = nodes.select(F.expr(f"node & {(1 << bits) - 1}L AS place")).distinct().withColumn("block", F.shiftright("place", FILTER_BITS).cast("int"))
    rows = place.groupBy("block").applyInPandas(_filter_block, "block int, bits binary").collect()
    out = np.zeros(1 << (bits - 3), np.uint8).reshape(-1, 1 << (FILTER_BITS - 3))
    for block, packed in rows:
        out[block] = np.frombuffer(packed, np.uint8)
    return out.reshape(-1).view(U)


def _wanted_sets(bitmap, bits: int, size: int):
    """The sets of nodes that the filter has, 48 bits a token."""

    def run(batches):
        for sets, nodes in _distinct(batches, FLUSH, size):
            place = np.array(nodes, np.int64).view(U) & U((1 << bits) - 1)
            hit = np.flatnonzero((bitmap.value[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1))
            blobs = [sets[k].view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for k in hit.tolist()]
            yield pa.record_batch([pa.array([nodes[k] for k in hit.tolist()], pa.int64()), pa.array(blobs, pa.binary())], names=["node", "tokens"])

    return run


def _tokens(blob: bytes) -> np.ndarray:
    x = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, 2:] = x
    return out.reshape(-1).view(U)


def _verify(percent: int):
    """Per pair: sizes, overlap, whether it links, and for a hub pair the tokens of b outside a."""

    def run(batches):
        for batch in batches:
            out = []
            for hub, x, y in zip(*(batch.column(c).to_pylist() for c in ("hub", "x", "y")), strict=True):
                p, q = _tokens(x), _tokens(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                rest = np.setdiff1d(q, p, assume_unique=True).view(np.int64) if hub else None
                out.append((len(p), len(q), both, 100 * both >= percent * (len(p) + len(q) - both), rest))
            sizes = [pa.array([o[k] for o in out], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.bool_()), (4, pa.list_(pa.int64())))]
            yield pa.record_batch([batch.column("a"), batch.column("b"), batch.column("hub"), *sizes], names=["a", "b", "hub", "na", "nb", "both", "linked", "rest"])

    return run


def _kept_sets(docs: DataFrame, pairs: DataFrame, bits: int, size: int, folder: str) -> DataFrame:
    """(node, tokens) of the nodes in pairs (a, b), and of some that the filter takes for them, written to folder."""
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(_node_filter(pairs.select(F.explode(F.array("a", "b")).alias("node")), bits))
    give_back()
    sets = docs.mapInArrow(_wanted_sets(bitmap, bits, size), "node long, tokens binary").groupBy("node").agg(F.any_value("tokens").alias("tokens"))
    sets.write.parquet(folder)
    bitmap.destroy()
    return spark.read.schema(sets.schema).parquet(folder)


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (hub, a, b), compared on their full sets (node, tokens)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if ends.limit(SMALL_ROUND + 1).count() <= SMALL_ROUND:
        sets = sets.join(F.broadcast(ends), "node", "left_semi")
    x = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    # a hub of thousands is sent to several tasks, each with a part of its members
    large = durable(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HUB_ROWS).select("a", F.ceil(F.col("n") / HUB_ROWS).cast("int").alias("parts")))
    first = pairs.join(large, "a", "left_anti").join(x.hint("merge"), "a")
    if not large.isEmpty():
        copies = x.join(large, "a").select("a", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        dealt = pairs.join(large, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
        first = first.unionByName(dealt.join(copies, ["a", "part"]).drop("part"))
    joined = first.join(y.hint("merge"), "b").select("a", "b", "hub", "x", "y")
    return durable(joined.mapInArrow(_verify(percent), "a long, b long, hub boolean, na long, nb long, both long, linked boolean, rest array<long>"))


def _open_pairs(stars: DataFrame, named: DataFrame, tested: DataFrame, percent: int, small_group: int, last: bool) -> DataFrame | None:
    """Pairs that are not in tested (a, b), and memberships, that may still link components within hub groups; None if all is settled.

    stars: verified memberships, a being b's hub. Steps are written one by one, as the driver holds the plan of each as a whole.
    """
    roots = named.select(F.col("node").alias("b"), "root")
    member = stars.select(F.col("a").alias("hub"), "b", F.col("nb").alias("n"), "both", "rest").join(roots, "b", "left").withColumn("root", F.coalesce("root", "b"))
    votes = member.groupBy("hub", "root").agg(F.count("*").alias("votes"))
    main = votes.groupBy("hub").agg(F.max_by("root", F.struct("votes", "root")).alias("main"), F.count("*").alias("roots"))
    least = member.groupBy("hub").agg(F.min("n").alias("least"))
    # a row a hub whose members are of several components, written first, so that the join can split a large hub
    hubs = durable(main.where("roots > 1").join(least, "hub"))
    if hubs.isEmpty():
        return None
    member = durable(member.join(hubs, "hub").withColumn("odd", F.col("root") != F.col("main")))
    overlap = lambda n, m: F.ceil(F.lit(percent) * (F.col(n) + F.col(m)) / F.lit(float(100 + percent)) - 1e-9).cast("long")
    fit = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.col("root") != F.col("root2"))
    side = lambda df: df.select("hub", *[c for c in ("token",) if c in df.columns], F.col("b").alias("c"), F.col("n").alias("m"), F.col("both").alias("both2"), F.col("root").alias("root2"))
    # both overlaps with the hub suffice: possible only near the threshold, for smaller partners
    near = member.where(F.col("odd") & (F.col("both") >= overlap("n", "least")))
    direct = near.join(side(member.drop("token")), "hub").where(fit & (F.least("both", "both2") >= overlap("n", "m"))).select("b", "c")
    tokens = member.select("hub", "b", "n", "both", "root", "odd", F.explode("rest").alias("token"))
    groups = durable(tokens.groupBy("hub", "token").agg(F.count("*").alias("size"), F.count_if("odd").alias("odds")).where("size > 1 and odds > 0"))
    common = durable(tokens.join(groups.select("hub", "token", "size"), ["hub", "token"]))
    own = common if last else common.where(F.col("size") <= 4 * small_group)
    shared = own.where("odd").join(side(own), ["hub", "token"]).where(fit)
    shared = shared.groupBy("hub", "b", "c").agg(F.count("*").alias("k"), F.first(overlap("n", "m") - F.least("both", "both2")).alias("needed")).where("k >= needed").select("b", "c")
    shared = durable(shared)
    found = direct.unionByName(shared).select(F.lit(False).alias("hub"), F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b")).distinct()
    pairs = durable(found.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    many = common.where(F.col("size") > 4 * small_group)
    if last or many.isEmpty():
        return pairs
    band = F.floor(F.log("n") / -math.log(percent / 100) + 1e-9).cast("long")
    grouped = many.withColumn("band", band)
    hubs = grouped.groupBy("hub", "token", "band").agg(F.max_by("b", F.struct("both", "b")).alias("own"))
    reach = hubs.select("hub", "token", "own", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"))
    stars = grouped.join(reach, ["hub", "token", "band"]).where("own <> b").select(F.lit(True).alias("hub"), F.col("own").alias("a"), "b").distinct()
    return pairs.unionByName(durable(stars))


def _merged(named: DataFrame | None, new: DataFrame) -> DataFrame:
    """(node, root) of the components that the links new (a, b) make out of those in named. Only what joins different components is contracted again."""
    if named is None:
        return durable(connected_components(new))
    root = lambda end: named.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    ends = new.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    across = durable(ends.where("a <> b").distinct())
    if across.isEmpty():
        return named
    found = durable(connected_components(across))
    moved = named.join(found.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    return durable(moved.unionByName(found.join(named.select("node"), "node", "left_anti").select("node", "root")))


def settled(text: DataFrame, todo: DataFrame, count: int, percent: int, size: int, small_group: int = 16, rounds: int = 12) -> DataFrame:
    """(node, root) of the components that the candidates in todo (hub, a, b) make, all compared on their full sets.

    text has the column text alone, of `count` rows. Rows of todo with hub false are pairs; with hub true, a is the hub of a group that b belongs to: any two
    members of a group that link end in one component. What `rounds` - 1 rounds of hubs leave open is compared pair by pair in the last.
    """
    spark, bits = text.sparkSession, min(27, max(18, count.bit_length() + 4))
    release(spark)
    # later rounds ask for members of the first one's hubs, so the texts are read once
    folder = new_dir(spark, "sets")
    sets = _kept_sets(text, todo, bits, size, folder)
    tested = named = None
    for round_no in range(rounds):
        release(spark)
        seen = _verified(sets, todo, percent)
        tested = seen.select("a", "b") if tested is None else tested.unionByName(seen.select("a", "b"))
        release(spark)
        named = _merged(named, seen.where("linked").select("a", "b"))
        release(spark)
        stars = seen.where("hub")
        if stars.isEmpty() or (todo := _open_pairs(stars, named, tested, percent, small_group, round_no == rounds - 2)) is None or todo.isEmpty():
            break
    remove(spark, folder)
    return named


def with_components(own: DataFrame, named: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of the component; a null id only where it has no other), component, text_key."""
    # an empty set is a component of its own; smallest ids are written first, so that the join can split a large component
    labelled = own.join(durable(named), "node", "left").withColumn("root", F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")))
    least_id = durable(labelled.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least_id")))
    out = labelled.join(least_id, "root", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least_id", "doc_id").alias("component_id"), F.col("root").alias("component"), "text_key")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, least: int = 17, small_group: int = 16, frequent_cap: int = 1 << 21, rounds: int = 12) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest id reachable by links, its own included), component, text_key.

    Null and empty texts, and texts of white space, have no shingles and link with nothing. Rows with equal ids
    or texts each get a row; a null id is never a component's name while the component has another id.
    An empty table gives an empty result; other columns are ignored, whatever their names. Texts of
    any length are taken whole. Token hashes have 64 bits (48 when sets are compared). component names the component even where ids
    repeat, null for an empty set; text_key = xxhash64(id, text) tells rows apart. What `rounds` - 1 rounds of hubs leave open
    is compared pair by pair in the last.
    """
    if rounds < 2:
        raise ValueError("the last round compares what the others leave open, so there are two at least")
    spark: SparkSession = ready(docs.sparkSession)
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    own = document_sets(docs, id_col, text_col, 5)
    tokens, count = own.agg(F.sum("n_shingles"), F.count("*")).first()
    n_blocks = blocks_for(tokens, 1 << 20)
    # as many postings as tokens at the very most, about a third in practice
    index_blocks = blocks_for(tokens, 1 << 21)
    cells = spark.sparkContext.broadcast(frequent_cells(text, n_blocks, least, frequent_cap))
    index = text.mapInArrow(_postings(n_blocks, index_blocks, cells, percent), "block long, rows binary")
    # a bucket gets what some blocks' postings make
    packed = index.groupBy("block").applyInPandas(_candidates(small_group, percent, blocks_for(index_blocks, 8)), "bucket long, hub boolean, pairs binary")
    todo = durable(packed.groupBy("bucket").applyInPandas(_summed, "hub boolean, a long, b long"))
    named = settled(text, todo, int(count), percent, 5, small_group, rounds)
    return with_components(own, named)


def keep_one(docs: DataFrame, components: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each component: that of smallest id, of equal ids the one of smallest text_key, a null id last.

    Rows are told apart by id and text, so repeated ids with different texts are judged each for itself, and rows of equal id and text
    are one. Rows without words all stay. An empty table gives an empty result; the columns of docs stay, whatever their names.
    """
    mark = free_name(docs)
    # written first, as joins before a grouping by component could not split a large one
    rows = durable(components.select("component", "text_key", "doc_id")).groupBy("component", "text_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "n")).alias("x")
    kept = rows.where("component is not null").groupBy("component").agg(first).select(F.col("x.text_key").alias(mark), F.col("x.n").alias("n"))
    kept = durable(kept.unionByName(rows.where("component is null").select(F.col("text_key").alias(mark), F.lit(1).cast("long").alias("n"))))
    marked = docs.withColumn(mark, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")))
    once = marked.join(kept.where("n = 1").select(mark), mark, "left_semi")
    again = marked.join(kept.where("n > 1").select(mark), mark, "left_semi").dropDuplicates([mark])
    return once.unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])

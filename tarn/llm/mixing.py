"""Mixing sources to target weights by the cube method of balanced sampling.

Sources in code-point order (null last) take the given weights in turn. Together they are to give `share` of all
words; no source gives more than `most` times its size, and what it cannot give is shared among the rest
by weight, until none is above. A source of rate f = target / size then takes each document floor(f)
times, and once more with probability f - floor(f). Those fractions are settled by the cube method: within
blocks of a source, three undecided documents at a time move along the null space of the two
constraints (number of documents, number of words) until one of them is certain. A block leaves two
undecided at most; these meet again in fewer blocks, round by round, until one block per source lands the last
two, with a dozen more of all sizes, on the rounding that is nearest in words, then in documents. So each source's
word and document totals are kept, but for that landing, and a source with a third of all rows is as many tasks as it has blocks.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._cluster import durable, free_name, ready

#: Documents that the landing decides, with the two at most that the flight leaves: all their roundings are compared.
LANDING = 12
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column | str) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(units: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, n) from rows (source, size, m), m equal documents each. A source without words gets 0.

    The water level is found over one row per source: with sources by their cap per weight, the first whose cap reaches
    the level that the rest of the mass gives sets it.
    """
    by_source = durable(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n")))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int") + 1)
    cap = F.lit(float(most)) * F.col("source_size")
    levels = by_source.withColumn("weight", weight).withColumn("cap", cap)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    mass = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(rising), F.lit(0.0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0))
    levels = levels.withColumn("level", mass / free)
    reached = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.least("cap", F.coalesce(reached, F.lit(float("inf"))) * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"), "n")


def _flight(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Moves one block's probabilities until two documents at most are undecided; lands them, with those kept for it, where it is the last block."""
    last = bool(group["last"].iloc[0])
    group = group.sort_values(["h", "doc_id", "size", "m"], kind="stable", na_position="last").reset_index(drop=True)
    p = group["p"].tolist()
    words = [float(s) * m for s, m in zip(group["size"], group["m"], strict=True)]
    docs = [float(m) for m in group["m"]]
    dice = random.Random(f"{group['h'].iloc[0]}:{len(p)}")
    tiny = 1e-9

    def move(units: list[int], u: list[float]) -> None:
        """Along +u or -u until a unit is certain, by odds that keep each expectation."""
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(units, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(units, u, strict=True) if x)
        step = up if dice.random() * (up + down) < down else -down
        for i, x in zip(units, u, strict=True):
            p[i] += step * x
            if p[i] < tiny:
                p[i] = 0.0
            elif p[i] > 1 - tiny:
                p[i] = 1.0

    # the last block keeps a dozen documents of all sizes for the landing
    by_size = sorted(range(len(p)), key=lambda i: (words[i], i))
    kept = by_size[:: max(1, -(-len(p) // LANDING))] if last else []
    held = set(kept)
    open_units: list[int] = []
    for i in range(len(p)):
        if i in held:
            continue
        open_units.append(i)
        while len(open_units) == 3:
            a, b, c = open_units
            # the cross product spans the null space of the two constraints
            u = [docs[b] * words[c] - docs[c] * words[b], docs[c] * words[a] - docs[a] * words[c], docs[a] * words[b] - docs[b] * words[a]]
            if any(u):
                largest = max(map(abs, u))
                move(open_units, [x / largest for x in u])
            else:  # proportional units: any two of them balance both
                move([a, b], [docs[b], -docs[a]] if docs[a] and docs[b] else [1.0, 0.0])
            open_units = [i for i in open_units if 0 < p[i] < 1]
    if last:
        units = open_units + kept
        choices = (np.arange(1 << len(units))[:, None] >> np.arange(len(units)) & 1).astype(float)
        share = np.array([p[i] for i in units])
        off_words = np.abs((choices - share) @ np.array([words[i] for i in units]))
        off_docs = np.abs((choices - share) @ np.array([docs[i] for i in units]))
        best = np.lexsort((off_docs, np.round(off_words)))[0]
        for i, x in zip(units, choices[best].tolist(), strict=True):
            p[i] = x
    group["p"] = p
    return group[["doc_id", "source", "size", "m", "whole", "h", "p"]]


UNIT = "doc_id long, source string, size long, m long, whole long, h long, p double"


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 2048, seed: int = 17) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies, taken (size * copies).

    Rows of equal id, source and size are one unit and are taken alike. Null texts have size 0; a document or a source
    without words is taken no times and 0. Null ids and a null source are values like others. Ties do not
    matter: units are ordered by a seeded hash, so that reruns agree. An empty table gives an empty result.
    Texts are counted whole; other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    units = durable(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")))
    targets = durable(source_targets(units, weights, share, most))
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    per_source = targets.withColumn("rate", F.when(F.abs(rate - F.round(rate)) < 1e-12, F.round(rate)).otherwise(rate)).withColumnRenamed("source", "s")
    state = units.join(F.broadcast(per_source) if _few(per_source) else per_source, F.col("source").eqNullSafe(F.col("s")))
    whole = F.floor("rate").cast("long")
    rate_now = F.when(F.col("size") > 0, F.col("rate")).otherwise(0.0)
    state = state.withColumn("rate", rate_now).select("doc_id", "source", "size", "m", whole.alias("whole"), F.xxhash64("doc_id", "source", "size", F.lit(seed)).alias("h"), (F.col("rate") - whole).alias("p"))
    settled = [state.where("p <= 0")]
    undecided = state.where("p > 0")
    while True:
        counts = durable(undecided.groupBy("source").agg(F.count("*").alias("left")).withColumnRenamed("source", "s"))
        largest = counts.agg(F.max("left")).first()[0]
        if not largest:
            break
        blocks = F.greatest(F.lit(1), F.ceil(F.col("left") / block)).cast("long")
        dealt = undecided.join(F.broadcast(counts) if _few(counts) else counts, F.col("source").eqNullSafe(F.col("s")))
        dealt = dealt.withColumn("last", blocks == 1).withColumn("block", F.pmod(F.xxhash64("h", F.lit(largest)), blocks))
        after = durable(dealt.groupBy("source", "block").applyInPandas(_flight, UNIT))
        settled.append(after.where("p <= 0 or p >= 1"))
        undecided = after.where("p > 0 and p < 1")
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    copies = F.col("whole") + F.when(F.col("p") >= 1, 1).otherwise(0)
    out = out.join(F.broadcast(per_source) if _few(per_source) else per_source, F.col("source").eqNullSafe(F.col("s")))
    out = out.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies"), "m")
    out = out.withColumn("m", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).drop("m")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _few(table: DataFrame, most: int = 100_000) -> bool:
    """Whether a table of one row per source is small enough to broadcast."""
    return table.limit(most + 1).count() <= most


def take_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with each row repeated as often as the mix takes it, and without those that it does not take.

    Rows of equal id, source and size are taken alike; nulls match nulls; rows without words are taken no times. Empty tables give an empty
    result; the columns of docs stay, whatever their names.
    """
    mark = free_name(docs)
    name = lambda x: f"{mark}_{x}"
    plan = mixed.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    plan = plan.select(*[F.col(c).alias(name(c)) for c in ("doc_id", "source", "size", "copies")])
    here = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(name("doc_id"))) & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(name("source"))) & (word_count(F.col(f"`{text_col}`")) == F.col(name("size")))
    taken = docs.join(plan, here).withColumn(name("k"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(name("copies")))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])

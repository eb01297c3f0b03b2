"""Money trails over payments (id, src, dst, ts, amount): layering chains that respect time, and round trips that meet in the middle.

Payments without a sender, receiver or time, and those to oneself, are left out. Steps are equality joins; loops cut their lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import durable

HOUR, DAY = 3600, 86400


def _payments(payments: DataFrame) -> DataFrame:
    p = payments.select("id", "src", "dst", F.col("ts").cast("timestamp").alias("ts"), "amount")
    return p.where("src <> dst AND ts IS NOT NULL").withColumn("sec", F.unix_timestamp("ts"))


def _band(value: Column, limits: dict[str, Column]) -> Column:
    out = F
    for name, holds in limits.items():
        out = out.when(holds, name)
    return out.otherwise("low")


def last_receivers(p: DataFrame, n: int, salts: int = 16) -> DataFrame:
    """(src, latest): the n different receivers that each sender paid last, as an array of (sec, dst). A busy sender is ranked in `salts` parts first."""
    from pyspark.sql import Window

    pairs = p.groupBy("src", "dst").agg(F.max("sec").alias("sec")).withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(salts)))
    newest = [F.desc("sec"), F.asc("dst")]
    part = pairs.withColumn("k", F.row_number().over(Window.partitionBy("src", "salt").orderBy(*newest))).where(F.col("k") <= n)
    whole = part.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(*newest))).where(F.col("k") <= n)
    return whole.groupBy("src").agg(F.collect_list(F.struct("sec", "dst")).alias("latest"))


def layering(payments: DataFrame, hops: int = 3, longest: int = 10, hours: int = 72, least: float = 50_000, windowed: bool = False) -> DataFrame:
    """Chains of payments through different entities, each no earlier than the one before: path, transactions, hops, first, last, hours, amount, severity, confidence.

    A chain starts anywhere, has `hops` to `longest` payments of `least` or more within `hours`, and cannot be made longer at its end:
    its last entity pays none outside the chain at that time or later, however late and small that payment is. With windowed=True
    only a payment that the chain could have held, in its hours and large enough, makes it longer.

    The frontier is keyed by entity and time bucket, so a step meets the payments of two buckets at most, however many the entity has made. Whether a chain can go on
    is seen from the last receivers of its entity: of one more than the chain has members, one is outside it.
    """
    window = hours * HOUR
    p = _payments(payments)
    bucket = lambda sec: F.floor(sec / window)
    e = p.where(F.col("amount") >= least).select("id", F.col("src").alias("node"), F.col("dst").alias("e_dst"), F.col("sec").alias("e_sec"), F.col("amount").alias("e_amount"), bucket(F.col("sec")).alias("bucket"))
    e = durable(e)
    latest = durable(last_receivers(p, longest + 2).withColumnRenamed("src", "node"))
    now = e.select(F.array("node", "e_dst").alias("path"), F.array("id").alias("transactions"), F.col("e_dst").alias("node"), F.col("e_sec").alias("first"), F.col("e_sec").alias("last"), F.col("e_amount").alias("amount"), F.col("e_amount").alias("smallest"))
    out = None
    for k in range(1, longest + 1):
        steps = now.select("*", F.explode(F.array_distinct(F.array(bucket(F.col("last")), bucket(F.col("first") + window)))).alias("bucket")).join(e, ["node", "bucket"])
        steps = steps.where((F.col("e_sec") >= F.col("last")) & (F.col("e_sec") <= F.col("first") + window) & ~F.array_contains("path", F.col("e_dst")))
        grown = None
        if k < longest:
            grown = steps.select(F.concat("path", F.array("e_dst")).alias("path"), F.concat("transactions", F.array("id")).alias("transactions"), F.col("e_dst").alias("node"), "first", F.col("last").alias("before"), F.col("e_sec").alias("last"), "amount", F.least("smallest", "e_amount").alias("smallest"))
            grown = durable(grown)
        if k >= hops:
            ended = now
            if k < longest and windowed:
                # by all that decides on a next payment: payments may share an id
                ended = now.join(grown.select(F.slice("path", 1, k + 1).alias("path"), "first", F.col("before").alias("last")).distinct(), ["path", "first", "last"], "left_anti")
            elif k < longest:
                goes_on = F.exists("latest", lambda x: (x["sec"] >= F.col("last")) & ~F.array_contains("path", x["dst"]))
                ended = now.join(latest, "node", "left").where(~F.coalesce(goes_on, F.lit(False))).drop("latest")
            ended = ended.withColumn("hops", F.lit(k)).select("path", "transactions", "hops", "first", "last", "amount", "smallest")
            out = ended if out is None else out.unionByName(ended)
        if grown is None or grown.isEmpty():
            break
        now = grown.drop("before")
    if out is None:
        out = now.limit(0).withColumn("hops", F.lit(0))
    severity = _band(F.col("hops"), {name: (F.col("hops") >= n) | (F.col("smallest") >= amount) for name, n, amount in (("critical", 7, 1_000_000), ("high", 5, 500_000), ("medium", 4, 200_000))})
    elapsed = (F.col("last") - F.col("first")) / HOUR
    return out.select("path", "transactions", "hops", F.timestamp_seconds("first").alias("first"), F.timestamp_seconds("last").alias("last"), elapsed.alias("hours"), "amount", severity.alias("severity"), (0.7 + F.least(F.lit(0.25), F.col("hops") * 0.05)).alias("confidence"))


def _halves(first: DataFrame, e: DataFrame, steps: int, ahead: bool) -> list[DataFrame]:
    """Simple half paths (start, order, node, inner, ids, amount, sec) of 1 to `steps` payments of e over entities that come after the start in order.

    Each begins with one of `first`, whose amount and sec it keeps. ahead: from the start on; else back from it. inner holds the nodes but the start, from the start on.
    """
    here, there, of = ("src", "dst", "order_dst") if ahead else ("dst", "src", "order_src")
    row = lambda df: df.select(F.col(here).alias("node"), F.col(there).alias("e_to"), F.col(of).alias("e_order"), F.col("id").alias("e_id"))
    start = first.where(F.col(of) > F.col("order_src" if ahead else "order_dst"))
    now = start.select(F.col(here).alias("start"), F.col("order_src" if ahead else "order_dst").alias("order"), F.col(there).alias("node"), F.array(there).alias("inner"), F.array("id").alias("ids"), "amount", "sec")
    out = [durable(now)]
    for _ in range(steps - 1):
        step = out[-1].join(row(e), "node").where((F.col("e_order") > F.col("order")) & ~F.array_contains("inner", F.col("e_to")))
        ids = F.concat("ids", F.array("e_id")) if ahead else F.concat(F.array("e_id"), "ids")
        out.append(durable(step.select("start", "order", F.col("e_to").alias("node"), F.concat("inner", F.array("e_to")).alias("inner"), ids.alias("ids"), "amount", "sec")))
    return out


def round_trips(payments: DataFrame, longest: int = 8, least: float = 50_000, days: int = 30, loss: float = 0.15) -> DataFrame:
    """Payments that lead back to their start over other entities: path, transactions, hops, start_amount, end_amount, loss, days, severity, confidence.

    A trip has 2 to `longest` payments; the first is of `least` or more, the last loses at most the share `loss` of it and is made no
    later than `days` whole days after it; the order in time is not asked for. Each set of payments counts once, from
    the entity on it whose own first payment (by time, then id) is the earliest.

    Paths of half the length leave the start and come back to it, and meet on (start, middle): with d payments an entity that makes 2 d ** (longest / 2)
    rows a start instead of d ** longest.
    """
    p = _payments(payments)
    order = durable(p.groupBy(F.col("src").alias("node")).agg(F.min(F.struct("sec", "id", "src")).alias("order")))
    e = p.join(order.select(F.col("node").alias("src"), F.col("order").alias("order_src")), "src").join(order.select(F.col("node").alias("dst"), F.col("order").alias("order_dst")), "dst")
    e = durable(e)
    ahead = _halves(e.where(F.col("amount") >= least), e, -(-longest // 2), True)
    back = _halves(e, e, longest // 2, False)
    out = None
    for n in range(2, longest + 1):
        x = ahead[-(-n // 2) - 1]
        y = back[n // 2 - 1].select("start", "node", F.slice("inner", 1, n // 2 - 1).alias("rest"), F.col("ids").alias("after"), F.col("amount").alias("end_amount"), F.col("sec").alias("end_sec"))
        met = x.join(y, ["start", "node"]).where(~F.arrays_overlap("inner", "rest") & (F.col("amount") - F.col("end_amount") <= F.lit(loss).cast("decimal(9,6)") * F.col("amount")) & (F.col("end_sec") < F.col("sec") + (days + 1) * DAY))
        path = F.concat(F.array("start"), "inner", F.reverse("rest"), F.array("start"))
        met = met.select(path.alias("path"), F.concat("ids", "after").alias("transactions"), F.lit(n).alias("hops"), F.col("amount").alias("start_amount"), "end_amount", F.floor((F.col("end_sec") - F.col("sec")) / DAY).alias("days"))
        out = met if out is None else out.unionByName(met)
    share = (F.col("start_amount") - F.col("end_amount")).cast("double") / F.col("start_amount").cast("double")
    severity = _band(F.col("hops"), {name: (F.col("start_amount") >= amount) | (F.col("hops") >= n) for name, n, amount in (("critical", 6, 1_000_000), ("high", 4, 500_000), ("medium", 3, 200_000))})
    return out.select("*", share.alias("loss"), severity.alias("severity"), F.lit(0.8).alias("confidence"))

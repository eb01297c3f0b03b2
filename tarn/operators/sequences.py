"""Detectors over time: range windows, sequences, greedy clusters.

A window by time takes in all rows of one timestamp (RANGE semantics), so results do not depend on the order of ties.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..cluster import durable
from ..lists import PLAYBOOKS, REPORTING_THRESHOLD
from .filters import just_under

DAY = 86_400


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts))


def trailing(key: str, ts: str, seconds: int) -> WindowSpec:
    return Window.partitionBy(key).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)


def forward(key: str, ts: str, seconds: int) -> WindowSpec:
    return Window.partitionBy(key).orderBy(micros(ts)).rangeBetween(0, seconds * 1_000_000)


def with_distinct(df: DataFrame, key: str, value: str, ts: str, seconds: int, name: str, ahead: bool = False) -> DataFrame:
    """df with the number of different values in the trailing (or coming) `seconds` of its key, both ends included, nulls not counted.

    Each row stands for its value from its own time until it leaves the window or the value's next row takes over; the count is a running sum of
    rows that begin and end, so no set is built.
    """
    at, end = "__at", "__end"
    m = -micros(ts) if ahead else micros(ts)
    rows = df.withColumn(at, m)
    following = F.lead(at).over(Window.partitionBy(key, value).orderBy(at))
    rows = rows.withColumn(end, F.when(F.col(value).isNotNull(), F.least(F.col(at) + seconds * 1_000_000 + 1, following)))
    begins = rows.withColumn("__step", F.when(F.col(value).isNotNull(), 1).otherwise(0)).withColumn("__row", F.lit(True)).drop(end)
    ends = rows.where(F.col(end).isNotNull()).select(key, F.col(end).alias(at), F.lit(-1).alias("__step"), F.lit(False).alias("__row"))
    upto = Window.partitionBy(key).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    out = begins.unionByName(ends, allowMissingColumns=True).withColumn(name, F.sum("__step").over(upto).cast("int")).where("__row")
    return out.select(*[F.col(c) for c in df.columns], name)


def spans(anchors: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end, anchors): windows of a key that overlap or touch, merged into maximal spans that do not."""
    w = anchors.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(key, F.col(start).alias("start"), F.col(end).alias("end"))
    before = Window.partitionBy(key).orderBy("start", "end")
    fresh = F.coalesce(F.col("start") > F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = w.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("anchors")).drop("island")


def in_spans(rows: DataFrame, found: DataFrame, key: str, ts: str) -> DataFrame:
    """rows that lie in a span of their key, with the span's start, end and anchors. Rows and spans are swept together once a key, without pairs."""
    marks = found.select(key, F.col("start").alias("__at"), F.struct("start", "end", "anchors").alias("__span"), F.lit(0).alias("__kind"))
    both = rows.withColumn("__at", F.col(ts)).withColumn("__kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    latest = F.last("__span", ignorenulls=True).over(Window.partitionBy(key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__span", latest).where((F.col("__kind") == 1) & (F.col("__at") <= F.col("__span.end")))
    return out.select(*[F.col(c) for c in rows.columns], F.col("__span.start").alias("start"), F.col("__span.end").alias("end"), F.col("__span.anchors").alias("anchors"))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour periods from start to end, rounded down."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / (DAY * 1_000_000))


def severity(amount: Column, amounts: Sequence[float], other: Column, others: Sequence[float], rising: bool = True) -> Column:
    """critical, high or medium, by the first of three amounts that is reached or the first of three limits of another measure; else low."""
    reached = [(amount >= a) | (other >= b if rising else other <= b) for a, b in zip(amounts, others, strict=True)]
    return F.when(reached[0], "critical").when(reached[1], "high").when(reached[2], "medium").otherwise("low")


def structuring(txns: DataFrame, days: int = 7, least: int = 3, total: float = REPORTING_THRESHOLD, low: float = 142_500, high: float = 150_000, collapse: bool = False) -> DataFrame:
    """Payments just under the threshold, per sender over trailing days: one row per anchor whose window has `least` of them and `total`.

    Severity by total or number of payments, confidence min(0.95, 0.5 + 0.1 (n - least)). collapse=True merges windows that overlap, from their
    first payment to their anchor, into spans (start, end, anchors) and judges all payments of a span together.
    """
    under = txns.where((F.col("amount") >= low) & (F.col("amount") < high))
    w = trailing("sender", "ts", days * DAY)
    found = under.select("id", "sender", "ts", F.min("ts").over(w).alias("from"), F.count("*").over(w).alias("n"), F.sum("amount").over(w).alias("total")).where((F.col("n") >= least) & (F.col("total") >= total))
    shown = ["id", "sender"]
    if collapse:
        inside = in_spans(under.select("sender", "ts", "amount"), spans(found, "sender", "from", "ts"), "sender", "ts")
        shown = ["sender", "start", "end", "anchors"]
        found = inside.groupBy(*shown).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    grade = severity(F.col("total"), [k * REPORTING_THRESHOLD for k in (5, 3, 2)], F.col("n"), (10, 7, 5))
    confidence = F.least(F.lit(0.95), 0.5 + (F.col("n") - least) * 0.1)
    return found.select(*shown, "n", F.col("total").cast("double").alias("total"), grade.alias("severity"), F.round(confidence, 6).alias("confidence"))


def structuring_forward(txns: DataFrame, days: int = 3, least: int = 3, threshold: float = REPORTING_THRESHOLD) -> DataFrame:
    """Per anchor a forward window: (a) `least` amounts in [140k, 150k); (b) many smaller ones that sum to the threshold. Both may hold."""
    w = forward("sender", "ts", days * DAY)
    near = F.count_if((F.col("amount") >= 140_000) & (F.col("amount") < threshold)).over(w)
    x = txns.select("id", "sender", F.count("*").over(w).alias("n"), near.alias("k"), F.sum("amount").over(w).cast("double").alias("total"), F.max("amount").over(w).alias("top"), F.avg("amount").over(w).alias("mean"))
    x = x.where(F.col("n") >= least)
    a = x.where(F.col("k") >= least).select("id", F.lit("near_threshold").alias("kind"), F.round(F.least(F.lit(1.0), F.col("k") / 5 * 0.9), 6).alias("confidence"))
    b = x.where((F.col("total") >= threshold) & (F.col("top") < threshold) & (F.col("mean") > 10_000))
    return a.unionByName(b.select("id", F.lit("split").alias("kind"), F.round(F.least(F.lit(1.0), (F.col("total") / threshold - 1) * 0.5 + 0.5), 6).alias("confidence")))


def structuring_share(txns: DataFrame, least: int = 5, share: float = 0.3) -> DataFrame:
    """Senders with more than `least` payments of which more than `share` lie in (0.85 T, T)."""
    k = F.count_if(just_under(F.col("amount"), ratio=0.85, strict=True))
    return txns.groupBy("sender").agg(F.count("*").alias("n"), k.alias("k")).where((F.col("n") > least) & (F.col("k") / F.col("n") > share))


def smurfing(txns: DataFrame, days: int = 7, least: int = 3, total: float = REPORTING_THRESHOLD, collapse: bool = False) -> DataFrame:
    """Recipients with `least` different depositors and `total` in trailing days; one row per anchor.

    Severity by total or number of depositors, confidence 0.7 + min(0.25, 0.05 (depositors - least)). collapse=True merges windows that overlap, from
    their first payment to their anchor, into spans (start, end, anchors) and judges all payments of a span together.
    """
    w = trailing("receiver", "ts", days * DAY)
    x = txns.select("id", "receiver", "sender", "ts", F.min("ts").over(w).alias("from"), F.sum("amount").over(w).cast("double").alias("total"))
    x = with_distinct(x, "receiver", "sender", "ts", days * DAY, "depositors").where((F.col("depositors") >= least) & (F.col("total") >= total))
    shown = ["id", "receiver"]
    if collapse:
        inside = in_spans(txns.select("receiver", "sender", "ts", "amount"), spans(x, "receiver", "from", "ts"), "receiver", "ts")
        shown = ["receiver", "start", "end", "anchors"]
        # a span's senders first, so that no task holds a set of them
        each = inside.groupBy(*shown, "sender").agg(F.sum("amount").alias("part"))
        x = each.groupBy(*shown).agg(F.count("sender").cast("int").alias("depositors"), F.sum("part").cast("double").alias("total"))
    grade = severity(F.col("total"), (1_000_000, 500_000, 200_000), F.col("depositors"), (10, 7, 5))
    confidence = 0.7 + F.least(F.lit(0.25), (F.col("depositors") - least) * 0.05)
    return x.select(*shown, "depositors", "total", grade.alias("severity"), F.round(confidence, 6).alias("confidence"))


def rapid_movement(ins: DataFrame, outs: DataFrame, hours: int = 24, least: float = 100_000, share: float = 0.8) -> DataFrame:
    """Payments in of `least` at least, of which `share` leaves the account within `hours`: (id, account, amount, n, moved, hours, severity, confidence).

    ins and outs: (id, account, ts, amount). Both are swept once an account by a range window, so no pairs are made. Severity by the
    amount or the hours to the last payment out.
    """
    amount = F.col("amount").cast("decimal(18,2)")
    both = ins.select("id", "account", "ts", amount.alias("amount"), F.lit(None).cast("decimal(18,2)").alias("gone"))
    both = both.unionByName(outs.select(F.lit(None).alias("id"), "account", "ts", F.lit(None).alias("amount"), amount.alias("gone")))
    w = forward("account", "ts", hours * 3600)
    last = F.max(F.when(F.col("gone").isNotNull(), micros("ts"))).over(w)
    x = both.select("id", "account", "amount", F.count("gone").over(w).alias("n"), F.sum("gone").over(w).alias("moved"), ((last - micros("ts")) / 3.6e9).alias("hours"))
    x = x.where((F.col("amount") >= least) & (F.col("moved") >= share * F.col("amount")))
    grade = severity(F.col("amount"), (1_000_000, 500_000, 200_000), F.col("hours"), (2, 6, 12), rising=False)
    return x.select("id", "account", F.col("amount").cast("double").alias("amount"), "n", F.col("moved").cast("double").alias("moved"), F.round("hours", 6).alias("hours"), grade.alias("severity"), F.lit(0.75).alias("confidence"))


def velocity_spikes(now: DataFrame, history: DataFrame, key: str, ts: str, factor: float = 3.0) -> DataFrame:
    """Keys whose count now exceeds `factor` times their daily mean over the history's own span; without history the baseline is 1."""
    days = F.greatest(elapsed_days(F.min(ts), F.max(ts)), F.lit(1))
    base = history.groupBy(key).agg((F.count("*") / days).alias("base"))
    x = now.groupBy(key).agg(F.count("*").alias("n")).join(base, key, "left").withColumn("ratio", F.col("n") / F.coalesce("base", F.lit(1.0)))
    return x.where(F.col("ratio") > factor).select(key, "n", F.round("ratio", 6).alias("ratio"), F.round(F.least(F.lit(1.0), (F.col("ratio") - 3) / 5 + 0.6), 6).alias("confidence"))


def bursts(events: DataFrame, hours: int = 24, least: int = 3, collapse: bool = False) -> DataFrame:
    """Anchors whose next `hours` hold `least` events of the entity; risk is the mean of n / 20, types / 5 and 1 / (1 + hours spanned), each at most 1.

    collapse=True merges windows that overlap, from their anchor to their last event, into spans (start, end, anchors) and judges all events of a span together.
    """
    w = forward("entity", "ts", hours * 3600)
    x = events.select("id", "entity", "type", "ts", F.count("*").over(w).alias("n"), F.max("ts").over(w).alias("to"))
    x = x.withColumn("span", (micros("to") - micros("ts")) / 3.6e9)
    shown = ["id", "entity"]
    if collapse:
        inside = in_spans(events.select("entity", "type", "ts"), spans(x.where(F.col("n") >= least), "entity", "ts", "to"), "entity", "ts")
        shown = ["entity", "start", "end", "anchors"]
        each = inside.groupBy(*shown, "type").agg(F.count("*").alias("part"))
        x = each.groupBy(*shown).agg(F.sum("part").alias("n"), F.count("type").cast("int").alias("types")).withColumn("span", (micros("end") - micros("start")) / 3.6e9)
    else:
        x = with_distinct(x, "entity", "type", "ts", hours * 3600, "types", ahead=True).where(F.col("n") >= least)
    part = lambda c: F.least(F.lit(1.0), c)
    risk = (part(F.col("n") / 20) + part(F.col("types") / 5) + 1 / (1 + F.col("span"))) / 3
    return x.select(*shown, "n", "types", F.round(risk, 6).alias("risk"))


def coordinated(events: DataFrame, entities: Sequence, seconds: int = 3600, least: int = 2) -> DataFrame:
    """Anchors in whose next hour `least` of the given entities act; confidence is their share. All entities share one line of time, cut
    into hours so that it is dealt over tasks: an anchor's window lies in its hour and the next.
    """
    e = events.where(F.col("entity").isin(*entities)).select("id", "entity", "ts", F.floor(micros("ts") / (seconds * 1_000_000)).alias("b"))
    other = e.select(F.col("entity").alias("other"), F.col("ts").alias("t2"), F.col("b").alias("b2"))
    near = e.withColumn("b", F.explode(F.array("b", F.col("b") + 1))).join(other, F.col("b") == F.col("b2"))
    near = near.where((micros("t2") >= micros("ts")) & (micros("t2") - micros("ts") <= seconds * 1_000_000))
    x = near.groupBy("id").agg(F.countDistinct("other").alias("n")).where(F.col("n") >= least)
    return x.select("id", "n", F.round(F.col("n") / len(entities), 6).alias("confidence"))


def contiguous(events: DataFrame, types: Sequence[str]) -> DataFrame:
    """First events of runs of exactly these types, neighbours in the entity's order of time and id."""
    w = Window.partitionBy("entity").orderBy("ts", "id")
    x = events.select("id", "entity", *[F.lead("type", k).over(w).alias(f"t{k}") if k else F.col("type").alias("t0") for k in range(len(types))])
    for k, kind in enumerate(types):
        x = x.where(F.col(f"t{k}") == kind)
    return x.select("id", "entity")


def greedy_clusters(events: DataFrame, seconds: int = DAY, least: int = 5) -> DataFrame:
    """(entity, first_id, n): non-overlapping clusters per entity. From the first free event, all within `seconds`; `least` or more make a cluster and are used up, else one event is passed over.

    A range window counts what each event would use up, and with it the next event that could begin a cluster. From each entity's first such
    event the chosen ones are those on its chain of next ones, found by doubling the pointers: as many rounds as the logarithm of the longest chain.
    """
    order = Window.partitionBy("entity").orderBy("ts", "id")
    x = events.select("entity", "id", "ts").withColumn("place", F.row_number().over(order)).withColumn("tie", F.rank().over(Window.partitionBy("entity").orderBy("ts")))
    # the window's count has the earlier ones of its own moment too
    x = x.withColumn("n", F.count("*").over(forward("entity", "ts", seconds)) - F.col("place") + F.col("tie"))
    rest = Window.partitionBy("entity").orderBy("place").rowsBetween(0, Window.unboundedFollowing)
    x = durable(x.withColumn("head", F.first(F.when(F.col("n") >= least, F.col("place")), ignorenulls=True).over(rest)))
    heads = x.where(F.col("n") >= least).select("entity", "place", (F.col("place") + F.col("n")).alias("after"))
    target = x.select("entity", F.col("place").alias("after"), F.col("head").alias("next"))
    step = durable(heads.join(target, ["entity", "after"], "left").select("entity", "place", "next"))
    chosen = durable(step.groupBy("entity").agg(F.min("place").alias("place")))
    while True:
        ahead = chosen.join(step.where("next IS NOT NULL"), ["entity", "place"]).select("entity", F.col("next").alias("place"))
        more = durable(ahead.join(chosen, ["entity", "place"], "left_anti"))
        if more.isEmpty():
            break
        chosen = durable(chosen.unionByName(more))
        again = step.select("entity", F.col("place").alias("next"), F.col("next").alias("beyond"))
        step = durable(step.join(again, ["entity", "next"], "left").select("entity", "place", F.col("beyond").alias("next")))
    return x.join(chosen, ["entity", "place"]).select("entity", F.col("id").alias("first_id"), "n")


def greedy_dedupe(patterns: DataFrame, share: float = 0.5) -> DataFrame:
    """Patterns (entity, id, start, end, confidence, events array) kept by falling confidence unless one kept overlaps in time and shares `share` of the events.

    Of equal confidence the smaller id goes first; patterns without events share none. Only patterns that share events meet. In each round those are kept that no
    open pattern before them contests, and what they contest is dropped, until all is settled.
    """
    own = patterns.select("entity", "id", "start", "end", "confidence", F.array_distinct("events").alias("events"))
    member = own.select("entity", "id", "start", "end", "confidence", F.size("events").alias("size"), F.explode("events").alias("event"))
    first = member.select("entity", "event", F.col("id").alias("by"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("confidence").alias("c2"))
    goes_first = (F.col("c2") > F.col("confidence")) | ((F.col("c2") == F.col("confidence")) & (F.col("by") < F.col("id")))
    met = member.join(first, ["entity", "event"]).where(goes_first & (F.col("start") <= F.col("e2")) & (F.col("s2") <= F.col("end")))
    contest = durable(met.groupBy("entity", "id", "by").agg(F.count("*").alias("shared"), F.first("size").alias("size")).where(F.col("shared") >= share * F.col("size")).select("entity", "id", "by"))
    every = own.select("entity", "id").distinct()
    kept = every.join(contest, ["entity", "id"], "left_anti")
    dropped = None
    while True:
        kept = durable(kept)
        lost = durable(contest.join(kept.withColumnRenamed("id", "by"), ["entity", "by"], "left_semi").select("entity", "id").distinct())
        if lost.isEmpty():
            break
        dropped = lost if dropped is None else dropped.unionByName(lost)
        settled = kept.unionByName(lost)
        contest = contest.join(settled, ["entity", "id"], "left_anti").join(lost.withColumnRenamed("id", "by"), ["entity", "by"], "left_anti")
        contest = durable(contest)
        kept = every.join(dropped, ["entity", "id"], "left_anti").join(contest, ["entity", "id"], "left_anti")
    return kept


def off_hours(events: DataFrame, least: int = 3) -> DataFrame:
    """Entities with `least` events at weekends, before 6 or from 22 o'clock."""
    odd = (F.weekday("ts") >= 5) | (F.hour("ts") < 6) | (F.hour("ts") >= 22)
    return events.where(odd).groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def progress(times: Sequence[Column], steps: Sequence[str], days: int, absent: Sequence[str] = ()) -> Column:
    """Struct (confidence, stage, next) from the time at which each step's type occurs, null where it does not.

    A step is met within `days` of the first step met, one in `absent` if its type never occurs. confidence = met / steps; stage = last met step;
    next = the step after it.
    """
    anchor, met = F.lit(None).cast("timestamp"), []
    for step, own in zip(steps, times, strict=True):
        if step in absent:
            met.append(own.isNull())
            continue
        ok = own.isNotNull() & (anchor.isNull() | (elapsed_days(anchor, own) <= days))
        met.append(F.coalesce(ok, F.lit(False)))
        anchor = F.coalesce(anchor, F.when(own.isNotNull(), own))
    stage = F.greatest(*[F.when(m, F.lit(k + 1)).otherwise(F.lit(0)) for k, m in enumerate(met)])
    following = F.get(F.array(*[F.lit(x) for x in steps]), stage)
    return F.struct(F.round(sum(m.cast("int") for m in met) / len(steps), 6).alias("confidence"), stage.alias("stage"), following.alias("next"))


def first_times(events: DataFrame, types: Sequence[str]) -> DataFrame:
    """(entity, t0, t1, ..): when each type first occurs."""
    return events.groupBy("entity").agg(*[F.min(F.when(F.col("type") == s, F.col("ts"))).alias(f"t{k}") for k, s in enumerate(types)])


def times_in_order(events: DataFrame, steps: Sequence[str], days: int, absent: Sequence[str] = ()) -> DataFrame:
    """(entity, t0, t1, ..): when each step first occurs after the last step met, so that steps are in order and need events of their own.

    One aggregate and join a step, all by entity; no list of an entity's events is built.
    """
    x = events.select("entity").distinct().withColumns({"anchor": F.lit(None).cast("timestamp"), "last": F.lit(None).cast("timestamp")})
    for k, step in enumerate(steps):
        own = F.col(f"t{k}")
        of_type = events.where(F.col("type") == step).select("entity", F.col("ts").alias("at"))
        later = of_type.join(x.select("entity", "last"), "entity") if step not in absent else of_type.withColumn("last", F.lit(None).cast("timestamp"))
        x = x.join(later.where("last IS NULL OR at > last").groupBy("entity").agg(F.min("at").alias(f"t{k}")), "entity", "left")
        if step not in absent:
            ok = own.isNotNull() & (F.col("anchor").isNull() | (elapsed_days(F.col("anchor"), own) <= days))
            x = x.withColumns({"last": F.when(ok, own).otherwise(F.col("last")), "anchor": F.coalesce("anchor", own)})
    return x.drop("anchor", "last")


def playbook(events: DataFrame, steps: Sequence[str], days: int, absent: Sequence[str] = (), least: float = 0.5, strict_order: bool = False) -> DataFrame:
    """(entity, confidence, stage, next): how much of a sequence each entity has gone through, from `least` on (see progress).

    A step is met by its type's first event, in whatever order, and a repeated step by the same event; with strict_order by the first event after the step before.
    """
    x = times_in_order(events, steps, days, absent) if strict_order else first_times(events, steps)
    return x.select("entity", progress([F.col(f"t{k}") for k in range(len(steps))], steps, days, absent).alias("p")).select("entity", "p.*").where(F.col("confidence") >= least)


def playbooks(events: DataFrame, books: Mapping[str, tuple] = PLAYBOOKS, least: float = 0.5, strict_order: bool = False) -> DataFrame:
    """(entity, playbook, confidence, stage, next, severity, typology) over several playbooks (steps, absent, days, severity, typology).

    Without strict_order one aggregate by entity serves them all.
    """
    extra = lambda book: [F.lit(book[3]).alias("severity"), F.lit(book[4]).alias("typology")]
    if strict_order:
        parts = [playbook(events, b[0], b[2], b[1], least, True).select("entity", F.lit(k).alias("playbook"), "confidence", "stage", "next", *extra(b)) for k, b in books.items()]
        return reduce(DataFrame.unionByName, parts)
    types = sorted({s for b in books.values() for s in b[0]})
    x, time = first_times(events, types), {s: F.col(f"t{k}") for k, s in enumerate(types)}
    found = []
    for k, b in books.items():
        p = progress([time[s] for s in b[0]], b[0], b[2], b[1])
        found.append(F.struct(F.lit(k).alias("playbook"), p["confidence"].alias("confidence"), p["stage"].alias("stage"), p["next"].alias("next"), *extra(b)))
    return x.select("entity", F.inline(F.array(*found))).where(F.col("confidence") >= least)


def next_steps(matches: DataFrame, books: Mapping[str, tuple] = PLAYBOOKS) -> DataFrame:
    """matches (entity, playbook, stage, ..) with `expected`: the playbook's steps beyond the stage, joined by commas, but for those that must not occur (in a playbook with such steps, a repeated one is named once)."""
    out = F.lit(None).cast("string")
    for name, (steps, absent, *_) in books.items():
        later = F.slice(F.array(*[F.lit(x) for x in steps]), F.col("stage") + 1, len(steps))
        kept = F.array_except(later, F.array(*[F.lit(x) for x in absent])) if absent else later
        out = F.when(F.col("playbook") == name, F.array_join(kept, ",")).otherwise(out)
    return matches.withColumn("expected", out)


def find_playbook(events: DataFrame, name: str, books: Mapping[str, tuple] = PLAYBOOKS, least: float = 0.5, strict_order: bool = False) -> DataFrame:
    """Entities that have gone through at least `least` of one playbook, with the steps still expected."""
    return next_steps(playbooks(events, {name: books[name]}, least, strict_order), books)


def trend(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(last - first) / first by order; 0 with fewer than two rows or a first of 0."""
    first, last = F.min_by(value, order), F.max_by(value, order)
    return df.groupBy(key).agg(F.when(F.count("*") < 2, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(last - first, F.nullif(first, F.lit(0.0))), F.lit(0.0))).alias("trend"))


def behaviour(txns: DataFrame, key: str = "sender") -> DataFrame:
    """Payments far above the sender's earlier ones: more than 5 times the mean, or 1.5 times the maximum, of all rows before."""
    w = Window.partitionBy(key).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    x = txns.select("id", key, "amount", F.avg("amount").over(w).alias("mean"), F.max("amount").over(w).alias("top"))
    return x.select("id", key, F.coalesce(F.col("amount") > 5 * F.col("mean"), F.lit(False)).alias("above_mean"), F.coalesce(F.col("amount") > 1.5 * F.col("top"), F.lit(False)).alias("above_max")).where("above_mean OR above_max")


def chain_breaks(entries: DataFrame, key: str, order: str, own: str, previous: str) -> DataFrame:
    """Entries whose `previous` is not the hash of the entry before; the first of a key must have none."""
    w = Window.partitionBy(key).orderBy(order)
    return entries.withColumn("expected", F.lag(own).over(w)).where(~F.col(previous).eqNullSafe(F.col("expected"))).drop("expected")


def entry_digest(content: Column, previous: Column) -> Column:
    """SHA-256 of an entry's content and the digest before it, lowercase hex; the first entry has an empty one before it."""
    return F.sha2(F.concat_ws("|", F.coalesce(content, F.lit("")), F.coalesce(previous, F.lit(""))), 256)


def verify_chain(entries: DataFrame, key: str, order: str, content: Column, own: str, previous: str) -> DataFrame:
    """entries with a fault: `link` where `previous` is not the digest stored before, `content` where the entry's own digest does not follow from its content and `previous`."""
    expected = F.lag(own).over(Window.partitionBy(key).orderBy(order))
    linked = F.col(previous).eqNullSafe(expected)
    sound = F.col(own).eqNullSafe(entry_digest(content, F.col(previous)))
    return entries.withColumn("fault", F.when(~linked, "link").when(~sound, "content")).where("fault IS NOT NULL")


def rate_limited(events: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """Events that are beyond `most` in the trailing `seconds` of their key."""
    return events.withColumn("n", F.count("*").over(trailing(key, ts, seconds))).where(F.col("n") > most)

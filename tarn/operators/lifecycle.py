"""Life of entities: merges as dated SAME_AS facts, their undoing and closure, splits, anonymisation under legal holds.

Requests are rows; each gets a row of outcome with an error, or null where it is carried out. Nothing is changed in place: facts are dated, so a merge is
undone by ending its fact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components


def new_id(*parts: Column) -> Column:
    """A name made from the parts alone, the same in every run."""
    return F.concat(F.lit("e-"), F.substring(F.sha2(F.concat_ws("|", *[x.cast("string") for x in parts]), 256), 1, 16))


def merge_outcomes(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """requests (canonical, secondary, confidence, ..) with `error`: itself, confidence, unknown, type or status; of entities (id, type, status)."""
    side = lambda mark: entities.select(F.col("id").alias(mark), F.col("type").alias(f"{mark}_type"), F.col("status").alias(f"{mark}_status"))
    x = requests.join(side("canonical"), "canonical", "left").join(side("secondary"), "secondary", "left")
    gone = [F.col(f"{m}_status").isin("MERGED", "ANONYMIZED") for m in ("canonical", "secondary")]
    error = F.when(F.col("canonical") == F.col("secondary"), "itself").when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence")
    error = error.when(F.col("canonical_type").isNull() | F.col("secondary_type").isNull(), "unknown").when(F.col("canonical_type") != F.col("secondary_type"), "type").when(gone[0] | gone[1], "status")
    return x.select(*requests.columns, error.alias("error"))


def active(facts: DataFrame, as_of: str) -> DataFrame:
    """Facts (subject, object, valid_from, valid_to) that hold on the day; an open end is null, the day it ends on no longer counts."""
    day = F.to_date(F.lit(as_of))
    return facts.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day)))


def closure(facts: DataFrame, as_of: str) -> DataFrame:
    """(node, component) of all entities in a SAME_AS fact that holds on the day; the smallest id names a component."""
    now = active(facts, as_of).select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    return components(now)


def updated_closure(old: DataFrame, facts: DataFrame, changed: DataFrame, as_of: str) -> DataFrame:
    """The closure of the facts on the day, from an earlier one and the facts that began or ended since (subject, object).

    Only components that a changed fact touches are worked out again: a merge joins those of its ends, an undone one may break its own. All others are taken over.
    """
    ends = changed.select(F.explode(F.array("subject", "object")).alias("node")).distinct()
    touched = old.join(ends, "node", "left_semi").select("component").distinct()
    again = old.join(touched, "component", "left_semi").select("node").unionByName(ends).distinct()
    now = active(facts, as_of).select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    # a fact that holds lies within one component, or is itself a changed one, so either end tells
    inside = now.join(again.withColumnRenamed("node", "src"), "src", "left_semi")
    return old.join(touched, "component", "left_anti").select("node", "component").unionByName(components(inside))


def split(facts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with moved ones under their new entity, outcomes) of requests (request, entity, name, facts array).

    facts: (id, entity, ..). A request without facts or name, or with a fact of another entity, fails as a whole: error nothing, name or foreign. The new
    entity's id follows from the request and the entity. A fact that two requests ask for goes to the smaller one.
    """
    asked = requests.select("request", "entity", F.explode("facts").alias("id")).distinct()
    foreign = asked.join(facts.select("id", F.col("entity").alias("owner")), "id", "left").where("owner IS NULL OR owner <> entity").select("request").distinct().withColumn("foreign", F.lit(True))
    out = requests.join(foreign, "request", "left")
    none = F.coalesce(F.size("facts"), F.lit(0)) <= 0
    error = F.when(none, "nothing").when(F.coalesce(F.btrim("name"), F.lit("")) == "", "name").when(F.col("foreign"), "foreign")
    out = out.withColumn("error", error).withColumn("new_entity", F.when(F.col("error").isNull(), new_id(F.lit("split"), F.col("request"), F.col("entity"))))
    moves = asked.join(out.where("error IS NULL").select("request", "new_entity"), "request").groupBy("id").agg(F.min_by("new_entity", "request").alias("new_entity"))
    moved = facts.join(moves, "id", "left").withColumn("entity", F.coalesce("new_entity", F.col("entity").cast("string"))).select(*facts.columns)
    return moved, out.select("request", "entity", "new_entity", "error")


def anonymous_name(entity: Column) -> Column:
    return F.concat(F.lit("ANONYMIZED_PERSON_"), F.upper(F.substring(F.sha2(F.concat(F.lit("anonymize:"), entity.cast("string")), 256), 1, 8)))


def anonymise(entities: DataFrame, requests: DataFrame, holds: DataFrame, personal: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(entities with the asked persons made anonymous, outcomes (id, error)) of requests (id, override).

    entities: (id, type, status, name, and the `personal` columns, which become null). Errors: unknown, type (only persons), status (already), hold (an
    id in holds, unless a request overrides it). Relations keep pointing to the id.
    """
    once = requests.groupBy("id").agg(F.bool_or(F.coalesce("override", F.lit(False))).alias("override"))
    held = holds.select("id").distinct().withColumn("held", F.lit(True))
    x = once.join(entities.select("id", "type", "status"), "id", "left").join(held, "id", "left")
    error = F.when(F.col("type").isNull(), "unknown").when(F.col("type") != "PERSON", "type").when(F.col("status") == "ANONYMIZED", "status").when(F.col("held") & ~F.col("override"), "hold")
    out = x.select("id", error.alias("error"))
    done = entities.join(out.where("error IS NULL").select("id", F.lit(True).alias("__done")), "id", "left")
    hide = {c: F.when(F.col("__done").isNull(), F.col(c)) for c in personal}
    named = {"name": F.when(F.col("__done"), anonymous_name(F.col("id"))).otherwise(F.col("name")), "status": F.when(F.col("__done"), "ANONYMIZED").otherwise(F.col("status"))}
    return done.withColumns(hide | named).select(*entities.columns), out


def resolution_accuracy(labelled: DataFrame, same_as: DataFrame) -> DataFrame:
    """One row: total, true and false positives and negatives, specificity, sensitivity of labelled pairs (a, b, is_same) against SAME_AS facts (subject, object, superseded), in either direction.

    A superseded fact says nothing; a share without a denominator is null; a null label counts in the total alone.
    """
    said = same_as.where("superseded IS NULL").select(F.least("subject", "object").alias("x"), F.greatest("subject", "object").alias("y")).distinct().withColumn("said", F.lit(True))
    p = labelled.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(said, ["x", "y"], "left")
    yes, true = F.coalesce("said", F.lit(False)), F.col("is_same")
    n = p.agg(F.count("*").alias("total"), F.count_if(true & yes).alias("tp"), F.count_if(~true & yes).alias("fp"), F.count_if(true & ~yes).alias("fn"), F.count_if(~true & ~yes).alias("tn"))
    return n.withColumn("specificity", F.try_divide("tn", F.col("tn") + F.col("fp"))).withColumn("sensitivity", F.try_divide("tp", F.col("tp") + F.col("fn")))


def blocking_accuracy(scored: DataFrame, same: Column, superseded: Column, auto: float) -> DataFrame:
    """What `resolution_accuracy` says of all pairs in scored (mention, candidate, score), the best of each mention being its fact from `auto` on; ties: the smallest candidate.

    Pairs are summed by mention where they are made, and never listed. same: whether a pair is one entity; superseded: whether a mention's fact says nothing.
    """
    by = scored.groupBy("mention").agg(F.count("*").alias("n"), F.count_if(same).alias("true"), F.min(F.struct((-F.col("score")).alias("s"), "candidate", same.alias("same"))).alias("b"))
    said = (-F.col("b.s") >= auto) & ~superseded
    n = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(said & F.col("b.same")).alias("tp"), F.count_if(said & ~F.col("b.same")).alias("fp"), F.coalesce(F.sum("true"), F.lit(0)).alias("true"))
    n = n.select("total", "tp", "fp", (F.col("true") - F.col("tp")).alias("fn"), (F.col("total") - F.col("true") - F.col("fp")).alias("tn"))
    return n.withColumn("specificity", F.try_divide("tn", F.col("tn") + F.col("fp"))).withColumn("sensitivity", F.try_divide("tp", F.col("tp") + F.col("fn")))

"""Row predicates and row-level classes; every one is a Column or a DataFrame -> DataFrame filter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lists import EXCLUDED, REPORTING_THRESHOLD, SEVERITY_RANK
from .rules import Condition, Rule

DEFAULT_RULES = (
    Rule("high_value_cash", (Condition("amount", "gte", 50000), Condition("kind", "contains", "cash")), "high", "aml"),
    Rule("near_threshold", (Condition("amount", "gte", 140000), Condition("amount", "lt", 150000)), "high", "structuring"),
    Rule("high_risk_country", (Condition("country", "in", ("AF", "IR", "KP", "SY", "YE")),), "critical", "sanctions"),
    Rule("new_entity_large", (Condition("entity_age_days", "lt", 90), Condition("amount", "gte", 100000)), "high", "kyc"),
)


def current_facts(facts: DataFrame, as_of) -> DataFrame:
    """Facts not superseded, and valid on as_of."""
    return facts.where(F.col("superseded_by").isNull() & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(as_of))))


def search(df: DataFrame, column: str, needle: str, limit: int, offset: int = 0, order: Sequence[str] = ()) -> DataFrame:
    """Case-insensitive substring search, a page in a stated order (the id breaks ties)."""
    return df.where(F.contains(F.lower(column), F.lit(needle.lower()))).orderBy(*(order or [column])).offset(offset).limit(limit)


def just_under(amount: Column, threshold: float = REPORTING_THRESHOLD, ratio: float = 0.95, strict: bool = False) -> Column:
    """ratio * threshold <= amount < threshold; with strict, the lower bound is excluded."""
    low = F.lit(ratio) * threshold
    return ((amount > low) if strict else (amount >= low)) & (amount < threshold)


def roundness(amount: Column) -> Column:
    """The largest of 100,000, 50,000 and 10,000 that divides the amount, else null."""
    out = F.lit(None).cast("int")
    for step in (10_000, 50_000, 100_000):
        out = F.when((amount > 0) & (amount % step == 0), F.lit(step)).otherwise(out)
    return out


def unusual_time(ts: Column, amount: Column) -> Column:
    """'weekend' (with more than 50,000) before 'night' (before 5), else null."""
    return F.when((F.weekday(ts) >= 5) & (amount > 50_000), F.lit("weekend")).when(F.hour(ts) < 5, F.lit("night"))


def first_category(name: Column, lists: Mapping[str, Sequence[str]] = EXCLUDED) -> Column:
    """The first category, in order, one of whose literals occurs in the lower-cased name; null if none does."""
    low = F.lower(name)
    tests = []
    for category, literals in lists.items():
        found = F.lit(False)
        for x in literals:
            found = found | F.contains(low, F.lit(x))
        tests.append(F.when(found, F.lit(category)))
    return F.coalesce(*tests)


def not_excluded(name: Column, categories: Sequence[str], lists: Mapping[str, Sequence[str]] = EXCLUDED) -> Column:
    """Whether a name's first category is none of the given ones; true without a category."""
    return ~F.coalesce(first_category(name, lists).isin(*categories), F.lit(False))


def severity_rank(column: Column) -> Column:
    """0 for critical to 3 for low; 4 for anything else."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]), column), F.lit(4))


def timeline_slice(events: DataFrame, entities: Sequence, start, end, types: Sequence[str]) -> DataFrame:
    """Events of the given entities and types from start to end, both included, in order of time and id."""
    return events.where(F.col("entity").isin(*entities) & F.col("ts").between(start, end) & F.col("type").isin(*types)).orderBy("ts", "id")


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first in `order`. Each task keeps its own first rows before the shuffle, as Spark limits row_number by groups."""
    from pyspark.sql.window import Window

    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each pair of ends once, the smaller end first."""
    return edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct()

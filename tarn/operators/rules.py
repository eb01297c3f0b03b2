"""A data-driven rules engine: conditions on dotted fields become one Column.

Operators: eq ne gt gte lt lte contains matches in not_in. A null field, or one that is absent, makes a condition false.
`contains` ignores case on strings and tests membership of arrays; `matches` is anchored at the start.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: object = None


@dataclass(frozen=True)
class Rule:
    id: str
    conditions: Sequence[Condition]
    severity: str = "medium"
    category: str = "general"
    any_of: bool = False
    enabled: bool = True
    tags: Sequence[str] = field(default_factory=tuple)


def _type_of(schema: StructType, path: str):
    for part in path.split("."):
        if not isinstance(schema, StructType) or part not in schema.fieldNames():
            return None
        schema = schema[part].dataType
    return schema


def condition_column(df: DataFrame, c: Condition) -> Column:
    kind = _type_of(df.schema, c.field)
    if kind is None:
        return F.lit(False)
    x, v = F.col(c.field), c.value
    if c.operator == "contains":
        test = F.array_contains(x, v) if isinstance(kind, ArrayType) else F.contains(F.lower(x.cast("string")), F.lower(F.lit(str(v))))
    elif c.operator == "matches":
        test = x.cast("string").rlike(f"^(?:{v})")
    elif c.operator in ("in", "not_in"):
        test = x.isin(*v) if c.operator == "in" else ~x.isin(*v)
    else:
        tests = {"eq": x.__eq__, "ne": x.__ne__, "gt": x.__gt__, "gte": x.__ge__, "lt": x.__lt__, "lte": x.__le__}
        if c.operator not in tests:
            raise ValueError(f"unknown operator {c.operator}")
        test = tests[c.operator](F.lit(v))
    return F.coalesce(test, F.lit(False))


def rule_column(df: DataFrame, rule: Rule) -> Column:
    tests = [condition_column(df, c) for c in rule.conditions]
    if not tests:
        return F.lit(False)
    return reduce(lambda a, b: a | b if rule.any_of else a & b, tests)


def evaluate(df: DataFrame, rules: Sequence[Rule], categories: Sequence[str] | None = None) -> DataFrame:
    """A row per match: df's columns with rule_id, severity, category. All rules share one scan."""
    used = [r for r in rules if r.enabled and (categories is None or r.category in categories)]
    if not used:
        return df.select("*", F.lit("").alias("rule_id"), F.lit("").alias("severity"), F.lit("").alias("category")).limit(0)
    hits = F.array(*[F.when(rule_column(df, r), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"))) for r in used])
    return df.select("*", F.explode(F.array_compact(hits)).alias("m")).select(*df.columns, "m.*")

"""A registry of detectors: name -> function of Tables, run singly, by typology or all together in one output schema."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, joins, sequences
from .views import Tables, ctes, query


@dataclass(frozen=True)
class Detector:
    """run gives one row a match; `entities` are the columns that name the entities involved."""

    name: str
    severity: str
    typology: str
    run: Callable[[Tables], DataFrame]
    entities: Sequence[str]


class Registry:
    """Detectors by name; a failing one fails the run, so that no scan is silently incomplete."""

    def __init__(self, detectors: Sequence[Detector] = ()) -> None:
        self.detectors = {d.name: d for d in detectors}
        self.disabled: set[str] = set()

    def add(self, detector: Detector) -> None:
        self.detectors[detector.name] = detector

    def disable(self, name: str) -> None:
        self.disabled.add(name)

    def enable(self, name: str) -> None:
        self.disabled.discard(name)

    def by_typology(self, typology: str) -> list[Detector]:
        return [d for d in self.detectors.values() if d.typology == typology]

    def run(self, tables: Tables, names: Sequence[str] | None = None) -> DataFrame:
        """(pattern, severity, typology, entity_ids) of the named detectors, or of all that are enabled."""
        used = [d for d in self.detectors.values() if (d.name in names if names is not None else d.name not in self.disabled)]
        parts = []
        for d in used:
            ids = F.array_sort(F.array_distinct(F.array(*[F.col(c).cast("string") for c in d.entities])))
            parts.append(d.run(tables).select(F.lit(d.name).alias("pattern"), F.lit(d.severity).alias("severity"), F.lit(d.typology).alias("typology"), ids.alias("entity_ids")))
        return reduce(DataFrame.unionByName, parts)

    def check(self, tables: Tables, entities: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """Matches that involve any of the given entities (entity), found by a join, never by a query text."""
        matches = self.run(tables, names).withColumn("entity", F.explode("entity_ids"))
        return matches.join(entities.select(F.col("entity").cast("string")).distinct(), "entity", "left_semi").select("pattern", "severity", "typology", "entity_ids").distinct()


DETECTORS = Registry(
    [
        Detector("structuring", "high", "money_laundering", lambda t: sequences.structuring(t.txn, days=30, least=2, low=75_000), ["sender"]),
        Detector("smurfing", "high", "money_laundering", lambda t: sequences.smurfing(t.txn), ["receiver"]),
        Detector("circular_flow", "high", "money_laundering", lambda t: graph.cycles(t.pay.select("src", "dst").distinct(), 3).select(F.get("path", F.lit(0)).alias("x"), F.get("path", F.lit(1)).alias("y")), ["x", "y"]),
        Detector("shared_directors", "medium", "shell_company_network", lambda t: joins.shared_pairs(t.directs, "company", "person", 2), ["g1", "g2"]),
    ]
)


@query("gr_19_pattern_registry", ctes("directs") + "SELECT 'shared_directors' AS pattern, 'medium' AS severity, array_to_string(list_sort([CAST(a.company AS VARCHAR), CAST(b.company AS VARCHAR)]), ',') AS ids FROM directs a JOIN directs b ON a.person = b.person AND a.company < b.company GROUP BY a.company, b.company HAVING count(DISTINCT a.person) >= 2")
def gr_19(t):
    x = DETECTORS.run(t, ["shared_directors"])
    return x.select("pattern", "severity", F.array_join("entity_ids", ",").alias("ids"))


@query("gr_19_all_patterns")
def gr_19_all(t):
    return DETECTORS.run(t).groupBy("pattern", "severity", "typology").agg(F.count("*").alias("matches"))


@query("gr_19_entity_check")
def gr_19_check(t):
    return DETECTORS.check(t, t.customer.select(F.col("c_custkey").alias("entity"))).select("pattern", F.array_join("entity_ids", ",").alias("ids"))

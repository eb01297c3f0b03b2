"""Row-level scores over feature columns. Flags and terms are declared once and summed by Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def flagged(flags: Mapping[str, Column], weights: Mapping[str, float]) -> tuple[Column, Column]:
    """(sum of the weights of true flags, at most 1; sorted names of true flags joined by commas). A null flag is false."""
    sure = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    score = _one(sum(F.when(v, F.lit(weights[k])).otherwise(F.lit(0.0)) for k, v in sure.items()))
    return score, F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in sure.items()]))), ",")


def shell_like(score: Column, flags: Column) -> Column:
    """Three flags or more, or a score of 0.4 or more."""
    return (flags >= 3) | (F.round(score, 9) >= 0.4)


def bands(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def person_risk(active: Column, shells: Column, velocity: Column, areas: Column, cluster: Column) -> Column:
    """Five capped terms: many directorships, shell companies, director changes, vulnerable areas, the network cluster."""
    z = F.lit(0.0)
    many = F.when(active >= 5, F.least(F.lit(0.3), 0.1 + 0.05 * (active - 5))).otherwise(z)
    fast = F.when(velocity > 2, F.least(F.lit(0.2), 0.1 * (velocity - 2))).otherwise(z)
    return _one(many + F.least(F.lit(0.5), 0.3 * shells) + fast + F.least(F.lit(0.15), 0.05 * areas) + 0.2 * cluster)


def company_risk(employees: Column, revenue: Column, generic: Column, age_days: Column, postal: Column, velocity: Column, reports: Column, foreign: Column, circular: Column) -> Column:
    """Nine terms; youth fades over twelve months of 30 days. Unknown employees and revenue count as none."""
    z, term = F.lit(0.0), lambda c, v: F.when(F.coalesce(c, F.lit(False)), F.lit(v)).otherwise(F.lit(0.0))
    youth = F.when(age_days / 30 < 12, 0.1 * (1 - age_days / 30 / 12)).otherwise(z)
    fast = F.when(velocity > 2, F.least(F.lit(0.2), 0.1 * (velocity - 2))).otherwise(z)
    abroad = F.when(foreign > 0.5, F.least(F.lit(0.2), foreign * 0.2)).otherwise(z)
    return _one(term(F.coalesce(employees, F.lit(0)) == 0, 0.15) + term(F.coalesce(revenue, F.lit(0)) < 100_000, 0.15) + term(generic, 0.15) + youth + term(postal, 0.15) + fast + term(~reports, 0.15) + abroad + term(circular, 0.2))


def address_risk(companies: Column, persons: Column, level: Column, turnover: Column) -> Column:
    """Registration hub by companies per person, vulnerability level (null: none), turnover above 0.3."""
    z = F.lit(0.0)
    hub = F.when(companies >= 10, F.least(F.lit(0.4), 0.1 + 0.05 * companies / F.greatest(persons, F.lit(1)))).otherwise(z)
    area = F.when(level == "PARTICULARLY", 0.3).when(level == "RISK", 0.2).when(level.isNotNull(), 0.1).otherwise(z)
    return _one(hub + area + F.when(turnover > 0.3, F.least(F.lit(0.2), turnover * 0.3)).otherwise(z))


#: Fixed weights of the shell-company scores.
SHELL_INDICATORS = {"no_employees": 0.15, "minimal_revenue": 0.15, "generic_sni_code": 0.15, "recently_formed": 0.1, "no_physical_address": 0.15, "high_director_turnover": 0.1, "no_annual_reports": 0.1, "foreign_director": 0.05, "multiple_directors_shared": 0.1, "dormant": 0.1}
SHELL_NETWORK = {"no_employees": 0.2, "minimal_revenue": 0.15, "generic_sni_code": 0.15, "c_o_address": 0.1, "no_annual_reports": 0.15}
SHELL_REGISTRY = {"no_employees": 0.15, "generic_sni": 0.20, "recently_formed": 0.15, "f_skatt_no_vat": 0.25, "single_director": 0.10, "no_revenue": 0.15}
SHELL_TAX = {"no_tax_registrations": 0.5, "f_skatt_no_vat": 0.2, "vat_no_f_skatt": 0.1, "no_employees": 0.15, "ab_no_activity": 0.15, "generic_sni": 0.1, "recently_formed": 0.05}


def factor_score(df: DataFrame, factors: Mapping[str, tuple[Column, float | Column, float]], sanctioned: str = "sanctioned") -> DataFrame:
    """df with `score` and `level`: weighted mean of the factors (condition, score, weight) that hold; 1 if the sanctioned one does; 0 without any."""
    sure = {k: (F.coalesce(c, F.lit(False)), s if isinstance(s, Column) else F.lit(s), w) for k, (c, s, w) in factors.items()}
    total = sum(F.when(c, F.lit(w)).otherwise(0.0) for c, _, w in sure.values())
    summed = sum(F.when(c, s * w).otherwise(0.0) for c, s, w in sure.values())
    score = F.coalesce(F.try_divide(summed, total), F.lit(0.0))
    if sanctioned in sure:
        score = F.when(sure[sanctioned][0], F.lit(1.0)).otherwise(score)
    steady = F.round(score, 9)  # so that a sum such as 0.1 + 0.4 meets its threshold
    return df.withColumn("score", score).withColumn("level", F.when(steady >= 0.9, "very_high").when(steady >= 0.75, "high").when(steady >= 0.5, "medium").otherwise("low"))


def anomaly(x: Column, mean: Column, deviation: Column, floor: float = 0.1) -> Column:
    """z-score with a floor under the deviation."""
    return (x - mean) / F.greatest(deviation, F.lit(floor))


def bankruptcy(distress: Column, counter_risk: Column, failures: Column, changes: Column, employee_trend: Column, revenue_trend: Column, delays: Column, moves: Column, debt: Column, current: Column, margin: Column) -> Column:
    """0.25 contagion + 0.25 directors + 0.30 trajectory + 0.20 (1 - financial health)."""
    contagion = distress * 0.6 + counter_risk * 0.4
    directors = F.least(failures * 0.15, F.lit(0.6)) + F.least(changes * 0.1, F.lit(0.3))
    falling = lambda t: F.when(t < -0.2, 0.2).otherwise(0.0)
    trajectory = _one(falling(employee_trend) + falling(revenue_trend) + F.least(delays * 0.1, F.lit(0.3)) + F.least(moves * 0.05, F.lit(0.2)))
    health = (F.when(debt < 2, F.greatest(F.lit(0.0), 1 - debt)).otherwise(0.0) + _one(current / 2) + F.when(margin > -0.5, 0.5 + margin).otherwise(0.0)) / 3
    return 0.25 * contagion + 0.25 * directors + 0.30 * trajectory + 0.20 * (1 - health)


def failure_rate(sni2: Column) -> Column:
    """Yearly failure rate by two-digit industry."""
    return F.when(sni2.isin("55", "56", "47", "43"), 0.08).when(sni2.isin("70", "82", "64"), 0.05).otherwise(0.03)


def construction(signals: Column, operating: Column, of: int = 11) -> tuple[Column, Column, Column]:
    """(probability, level, confidence) from the number of signals of fraud being built, and of signs that it runs."""
    level = F.when((signals >= 4) & (operating == 0), "critical").when((signals >= 3) & (operating == 0), "high").when(signals >= 2, "medium").otherwise("low")
    return signals / of, level, 1 - 0.1 * (of - signals)

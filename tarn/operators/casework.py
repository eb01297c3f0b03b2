"""Rules of alerts, reports, cases, referrals, reviews and timelines, as columns; routing as a join with a small rule table.

All limits are parameters or fixed values of this file. A null number meets no limit; a null text or flag counts as absent.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weights of patterns in a risk score, for others 0.5.
PATTERN_WEIGHTS = {"structuring": 1.0, "rapid_in_out": 0.8, "velocity_spike": 0.7, "new_counterparty": 0.5, "round_amounts": 0.4, "unusual_time": 0.3, "dormant_reactivation": 0.6}
# From which score a person's alert needs acknowledgement (2) or approval (3).
TIER_2, TIER_3 = 0.5, 0.85
# Per type of alert the bands (severity, least score, least count; None: no such limit) in order, and what is left.
ALERT_BANDS = {
    "shell_network": ((("critical", 0.85, 10), ("high", 0.7, 5), ("medium", 0.5, None)), "low"),
    "registration_mill": ((("critical", 0.8, 20), ("high", 0.6, 10)), "medium"),
    "formation": ((("high", 0.8, None), ("medium", 0.6, None), ("low", 0.5, None)), None),
}
# Case types by the patterns that show them, in order; without any, aml.
CASE_TYPES = (("sanctions", ("sanctions", "sanctioned")), ("pep", ("pep",)), ("ctf", ("terrorism", "ctf")), ("aml", ("structuring", "layering", "smurfing", "round_trip")), ("fraud", ("fraud",)))
# Authority, least amount, least confidence, crime types; in order.
AUTHORITIES = (
    ("EBM", 500_000, 0.7, ("economic_crime", "corporate_fraud", "tax_fraud")),
    ("SKV", 50_000, 0.6, ("tax_fraud", "vat_fraud", "undeclared_income")),
    ("FK", 20_000, 0.6, ("welfare_fraud", "sickness_benefit_fraud", "disability_fraud")),
    ("FIU", 150_000, 0.5, ("money_laundering", "terrorist_financing", "suspicious_transaction")),
    ("IVO", 10_000, 0.6, ("healthcare_fraud", "care_home_fraud")),
    ("POL", 0, 0.7, ("organized_crime", "violence", "narcotics")),
)
# Report priority by worst severity or total amount.
PRIORITIES = (("urgent", "critical", 5_000_000), ("high", "high", 1_000_000), ("medium", "medium", 500_000))
# Severity of a timeline's payments by amount, of its alerts by theirs, and its significant changes.
PAYMENT_BANDS = (("significant", 1_000_000), ("moderate", 100_000), ("minor", 10_000))
ALERT_EVENTS = {"critical": "critical", "high": "significant", "medium": "moderate", "low": "minor"}
SIGNIFICANT_CHANGES = ("ownership_change", "board_change", "address_change", "beneficial_owner_change", "status_change")
# Amount factors of a payment (least amount, score, weight) and channels (types, score, weight).
AMOUNT_FACTORS = ((1_000_000, 0.7, 1.2), (500_000, 0.5, 1.0), (150_000, 0.3, 0.8))
CHANNELS = ((("cash", "crypto", "wire_international", "money_order"), 0.6, 1.1), (("wire_domestic", "check"), 0.3, 0.9))


def _any(*conditions: Column) -> Column:
    """Whether one surely holds."""
    out = F.lit(False)
    for x in conditions:
        out = out | F.coalesce(x, F.lit(False))
    return out


def pattern_risk(patterns: DataFrame, tier_2: float = TIER_2, tier_3: float = TIER_3) -> DataFrame:
    """Of patterns (entity, pattern, confidence, affects_person) per entity: score, tier, n.

    The mean confidence weighted by pattern, and 0.05 a pattern, 0.2 at most, on top; at most 1. Who affects no person is of tier 1.
    """
    weight = F.lit(0.5)
    for name, w in PATTERN_WEIGHTS.items():
        weight = F.when(F.col("pattern") == name, w).otherwise(weight)
    sums = patterns.withColumn("w", weight).groupBy("entity").agg(F.sum(F.col("confidence") * F.col("w")).alias("x"), F.sum("w").alias("w"), F.count("*").alias("n"), F.bool_or(F.coalesce("affects_person", F.lit(False))).alias("affects"))
    score = F.least(F.lit(1.0), F.col("x") / F.col("w") + F.least(F.lit(0.2), F.col("n") * 0.05))
    return sums.withColumn("score", score).select("entity", "score", review_tier(F.round("score", 9), F.col("affects"), tier_2, tier_3).alias("tier"), "n")


def review_tier(score: Column, affects_person: Column, tier_2: float = TIER_2, tier_3: float = TIER_3) -> Column:
    sure = F.coalesce(affects_person, F.lit(False))
    return F.when(~sure, 1).when(score >= tier_3, 3).when(score >= tier_2, 2).otherwise(1)


def may_export(tier: Column, acknowledged_by: Column, decision: Column) -> Column:
    return F.when(tier <= 1, True).when(tier == 2, acknowledged_by.isNotNull()).otherwise(_any(decision == "approved"))


def review_status(tier: Column, acknowledged_by: Column, decision: Column) -> Column:
    """An empty name or decision is none."""
    named = lambda c: _any(c != "")
    second = F.when(named(acknowledged_by), "acknowledged").otherwise("pending_acknowledgment")
    return F.when(tier <= 1, "no_review_needed").when(tier == 2, second).otherwise(F.when(named(decision), F.concat(F.lit("decision_"), decision)).otherwise("pending_approval"))


def alert_severity(kind: str, score: Column, count: Column | None = None) -> Column:
    """Null where a type raises no alert at such a score."""
    limits, rest = ALERT_BANDS[kind]
    out = F.lit(rest).cast("string")
    for name, least, most in reversed(limits):
        out = F.when(_any(score >= least, *([count >= most] if most is not None and count is not None else [])), name).otherwise(out)
    return out


def report_priority(severities: Column, total: Column) -> Column:
    """Of the array of the matches' severities and the whole amount."""
    out = F.lit("low")
    for name, severity, amount in reversed(PRIORITIES):
        out = F.when(_any(F.array_contains(severities, severity), total >= amount), name).otherwise(out)
    return out


def report_type(patterns: Column) -> Column:
    return F.when(_any(F.array_contains(patterns, "terrorist_financing")), "tfar").otherwise("sar")


def case_type(patterns: Column) -> Column:
    """Of the array of the alerts' pattern and alert types."""
    out = F.lit("aml")
    for name, of in reversed(CASE_TYPES):
        out = F.when(_any(F.arrays_overlap(patterns, F.array(*map(F.lit, of)))), name).otherwise(out)
    return out


def authority_rules(spark: SparkSession) -> DataFrame:
    """(crime_type, authority, place, least_amount, least_confidence): a row for each authority and crime type."""
    rows = [(crime, name, place, float(amount), sure) for place, (name, amount, sure, crimes) in enumerate(AUTHORITIES) for crime in crimes]
    return spark.createDataFrame(rows, "crime_type string, authority string, place int, least_amount double, least_confidence double")


def route(cases: DataFrame, rules: DataFrame | None = None, fallback: str = "POL") -> DataFrame:
    """Of cases (id, crime_type, amount, confidence) per id: authority, secondary (up to two, joined by commas), value_met, fiu_report.

    Authorities of the crime type whose least confidence is met are ranked by confidence, 0.2 more where the least amount is met and 0.1 more for
    EBM from 1,000,000, at most 1; of equals the first in the rules. Without any, the case goes to the fallback.
    """
    rules = authority_rules(cases.sparkSession) if rules is None else rules
    met = cases.join(F.broadcast(rules), "crime_type").where("confidence >= least_confidence")  # some rows an authority
    value = F.coalesce(F.col("amount") >= F.col("least_amount"), F.lit(False))
    bonus = F.when(value, 0.2).otherwise(0.0) + F.when((F.col("authority") == "EBM") & (F.col("amount") >= 1_000_000), 0.1).otherwise(0.0)
    score = F.least(F.lit(1.0), F.round(F.col("confidence") + bonus, 9))
    ranked = met.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-score).alias("s"), "place", "authority", value.alias("met")))).alias("x"))  # as many as there are rules for a crime
    out = cases.join(ranked, "id", "left")
    fiu = (F.col("amount") >= 150_000) & F.col("crime_type").isin("money_laundering", "suspicious_transaction") & F.col("x").isNotNull()
    second = F.array_join(F.transform(F.slice("x", 2, 2), lambda r: r["authority"]), ",")
    first = F.get("x", F.lit(0))
    return out.select("id", F.coalesce(first["authority"], F.lit(fallback)).alias("authority"), F.coalesce(second, F.lit("")).alias("secondary"), F.coalesce(first["met"], F.lit(False)).alias("value_met"), F.coalesce(fiu, F.lit(False)).alias("fiu_report"))


def payment_event(amount: Column) -> Column:
    out = F.lit("info")
    for name, least in reversed(PAYMENT_BANDS):
        out = F.when(amount >= least, name).otherwise(out)
    return out


def alert_event(severity: Column) -> Column:
    """A null severity is low; an unknown one gives info."""
    given = F.coalesce(severity, F.lit("low"))
    out = F.lit("info")
    for name, event in ALERT_EVENTS.items():
        out = F.when(given == name, event).otherwise(out)
    return out


def change_event(kind: Column) -> Column:
    return F.when(_any(kind.isin(*SIGNIFICANT_CHANGES)), "moderate").otherwise("minor")


def payment_factors(amount: Column, kind: Column, sender_risk: Column, receiver_risk: Column, mean: Column, largest: Column) -> Mapping[str, tuple[Column, Column, float]]:
    """Factors (condition, score, weight) of a payment: its amount, its channel, the risk of both sides from 0.5 on, and what is unusual against the sender's earlier payments."""
    out = {}
    above = F.lit(False)
    for least, score, weight in AMOUNT_FACTORS:
        out[f"amount_{least}"] = ((amount >= least) & ~above, F.lit(score), weight)
        above = amount >= least
    for names, score, weight in CHANNELS:
        out[names[0]] = (F.lower(kind).isin(*names), F.lit(score), weight)
    out["sender"], out["receiver"] = (sender_risk >= 0.5, sender_risk, 1.0), (receiver_risk >= 0.5, receiver_risk, 1.0)
    out["unusual"], out["new_high"] = (amount > 5 * mean, F.lit(0.6), 1.0), (amount > 1.5 * largest, F.lit(0.4), 0.8)
    return out


def payment_risk(df: DataFrame, factors: Mapping[str, tuple[Column, Column, float]]) -> DataFrame:
    """df with score and level: the weighted mean of the factors that hold, 0.1 without any."""
    sure = {k: (F.coalesce(c, F.lit(False)), s, w) for k, (c, s, w) in factors.items()}
    total = sum((F.when(c, w).otherwise(0.0) for c, _, w in sure.values()), F.lit(0.0))
    summed = sum((F.when(c, s * w).otherwise(0.0) for c, s, w in sure.values()), F.lit(0.0))
    score = F.coalesce(F.try_divide(summed, total), F.lit(0.1))
    steady = F.round("score", 9)
    return df.withColumn("score", score).withColumn("level", F.when(steady >= 0.75, "very_high").when(steady >= 0.5, "high").when(steady >= 0.25, "medium").otherwise("low"))


def evasion(isolation: Column, compliance: Column, structuring: Column) -> tuple[Column, Column]:
    """(probability, level): 0.4 isolation, 0.3 synthetic compliance, 0.3 structuring."""
    flag = lambda c: F.when(_any(c), 0.3).otherwise(0.0)
    p = F.least(F.lit(1.0), F.coalesce(isolation, F.lit(0.0)) * 0.4 + flag(compliance) + flag(structuring))
    steady = F.round(p, 9)
    return p, F.when(steady > 0.7, "high").when(steady > 0.4, "medium").otherwise("low")


def isolation(directors: Column, lonely_directors: Column, neighbours_at_address: Column, partners: Column, neighbours: Column) -> Column:
    """Mean of four shares: directors without another role (1 without directors), an address of its own 0.5, no business partner 0.3, no neighbour 1 and fewer than three 0.5."""
    z = F.lit(0.0)
    alone = F.when(directors > 0, lonely_directors / directors).otherwise(1.0)
    return (alone + F.when(neighbours_at_address == 0, 0.5).otherwise(z) + F.when(partners == 0, 0.3).otherwise(z) + F.when(neighbours == 0, 1.0).when(neighbours < 3, 0.5).otherwise(z)) / 4


def synthetic_compliance(filings: Column, on_time: Column, little_activity: Column) -> Column:
    """More than five filings, all on time, with little activity."""
    return _any((filings > 5) & (on_time == filings) & little_activity)


def below_threshold(payments: Column, just_below: Column) -> Column:
    """More than five payments of which more than 30 % lie just below the reporting threshold (85 to 100 % of it)."""
    return _any((payments > 5) & (just_below > payments * 0.3))

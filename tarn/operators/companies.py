"""Detectors on companies: events out of wide rows, formation, dormancy, indicators, rotation of directors, likeness of a director's companies.

Dates are compared with a parameter `as_of`, never with the clock. A null date, number or flag meets no rule, but for the employees, of whom unknown means none.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _date(as_of: str) -> Column:
    return F.to_date(F.lit(as_of))


def events_of(companies: DataFrame, key: str, dated: Mapping[str, str]) -> DataFrame:
    """(entity, type, day): an event for each dated column of a wide row that is not null; dated maps columns to event types."""
    each = F.array(*[F.struct(F.lit(kind).alias("type"), F.to_date(c).alias("day")) for c, kind in dated.items()])
    return companies.select(F.col(key).alias("entity"), F.inline(each)).where("day IS NOT NULL")


def rapid_formation(events: DataFrame, start: str = "formed", end: str = "f_skatt_registered", days: int = 30) -> DataFrame:
    """(entity, days, confidence, severity): registered for tax within `days` of formation, the sooner the surer. Of several dates the last counts."""
    x = events.groupBy("entity").agg(F.max(F.when(F.col("type") == start, F.col("day"))).alias("a"), F.max(F.when(F.col("type") == end, F.col("day"))).alias("b"))
    x = x.withColumn("days", F.datediff("b", "a")).where(F.col("days").between(0, days))
    return x.select("entity", "days", (1 - F.col("days") / days).alias("confidence"), F.lit("medium").alias("severity"))


def dormant(companies: DataFrame, directors: Column, formed: Column, as_of: str, years: float = 5) -> DataFrame:
    """Companies of at least `years` years of 365 days with a single director: age, confidence 0.5, severity low."""
    age = F.datediff(_date(as_of), formed) / 365
    return companies.withColumn("age", age).where((F.col("age") >= years) & (directors == 1)).withColumn("confidence", F.lit(0.5)).withColumn("severity", F.lit("low"))


def indicated(companies: DataFrame, flags: Mapping[str, Column], least: int = 3) -> DataFrame:
    """Companies with `least` of the flags: matched (their names in order of flags, joined by commas), confidence (share), severity (high for all, else medium)."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    x = companies.withColumn("flags", names).where(F.size("flags") >= least)
    return x.select("*", F.array_join("flags", ",").alias("matched"), (F.size("flags") / len(flags)).alias("confidence"), F.when(F.size("flags") >= len(flags), "high").otherwise("medium").alias("severity")).drop("flags")


def invoice_factories(companies: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    """Registered for F-tax but not for VAT, no employees, formed within `months`, at a virtual address: of (company, f_skatt, vat, employees, formed, address_type)."""
    fresh = F.col("formed") > F.add_months(_date(as_of), -months)
    return companies.where(F.col("f_skatt") & ~F.coalesce("vat", F.lit(False)) & (F.coalesce("employees", F.lit(0)) == 0) & fresh & (F.col("address_type") == "virtual"))


def reactivated(companies: DataFrame, as_of: str, years: int = 2, months: int = 6) -> DataFrame:
    """Active within the last `months` after more than `years` dormant: of (company, status, status_from, previous_status, previous_from)."""
    slept = F.add_months("previous_from", 12 * years) < F.col("status_from")
    return companies.where((F.col("status") == "active") & (F.col("previous_status") == "dormant") & slept & (F.col("status_from") > F.add_months(_date(as_of), -months)))


def rotating(directorships: DataFrame, most: int = 3, ended: int = 2, share: float = 0.5) -> DataFrame:
    """(company, n, ended): more than `most` directorships, more than `ended` of them over, and more than `share`."""
    x = directorships.groupBy("company").agg(F.count("*").alias("n"), F.count("to_date").alias("ended"))
    return x.where((F.col("n") > most) & (F.col("ended") > ended) & (F.col("ended") / F.col("n") > share))


def change_rates(changes: DataFrame, key: str, as_of: str, days: int = 730, high: float = 2.0) -> DataFrame:
    """(key, changes, added, removed, per_year, high): changes (key, day, change) in the trailing `days`, a year having 365."""
    day = F.col("day")
    recent = changes.where((day >= F.date_sub(_date(as_of), days)) & (day <= _date(as_of)))
    x = recent.groupBy(key).agg(F.count("*").alias("changes"), F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))
    return x.withColumn("per_year", F.col("changes") / (days / 365)).withColumn("high", F.col("per_year") > high)


def rate_summary(rates: DataFrame) -> DataFrame:
    """One row: keys, mean and largest rate, and how many are high."""
    return rates.agg(F.count("*").alias("keys"), F.avg("per_year").alias("mean"), F.max("per_year").alias("largest"), F.count_if("high").alias("n_high"))


def alike(boards: DataFrame, days: int = 30) -> DataFrame:
    """(person, shared_address, same_industry, close_formation, alike) of boards (person, company, address, industry, formed), for persons with two companies at least.

    An address that two companies share, one two-digit industry for all that have any (two at least), or two formations in a row less than `days` apart. Companies count once
    a person; each test is an aggregate or a step to the next row, no list of a person's companies is built.
    """
    b = boards.select("person", "company", "address", F.substring("industry", 1, 2).alias("sector"), "formed").distinct()
    many = b.groupBy("person").agg(F.count_distinct("company").alias("n"), (F.count("address") > F.count_distinct("address")).alias("shared_address"), ((F.count("sector") > 1) & (F.count_distinct("sector") == 1)).alias("same_industry"))
    gap = F.datediff(F.lead("formed").over(Window.partitionBy("person").orderBy("formed", "company")), "formed")
    gaps = b.where("formed IS NOT NULL").withColumn("gap", gap).groupBy("person").agg(F.min("gap").alias("gap"))
    close = F.coalesce(F.col("gap") < days, F.lit(False))
    x = many.where("n >= 2").join(gaps, "person", "left").withColumn("close_formation", close)
    return x.select("person", "shared_address", "same_industry", "close_formation", (F.col("shared_address") | F.col("same_industry") | F.col("close_formation")).alias("alike"))

"""Swedish addresses: parts, cluster keys, virtual offices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Street abbreviations, and names that mark virtual offices.
ABBREVIATIONS = (("gt.", "gatan"), ("gt", "gatan"), ("g.", "gatan"), ("vg.", "vägen"), ("vg", "vägen"), ("v.", "vägen"), ("pl.", "plan"), ("str.", "stråket"), ("all.", "allén"), ("tg.", "torget"), ("t.", "torget"))
VIRTUAL = r"regus|spaces|mindspace|epicenter|convendum|no18|norrsken|the park|work\s*club|kontorshotell|business\s*center|företagshotell"
#: First digit of a postal code to its region.
REGIONS = {"1": "Stockholm", "2": "Skåne", "3": "Halland/Blekinge", "4": "Västra Götaland", "5": "Jönköping/Östergötland", "6": "Värmland/Örebro", "7": "Västmanland/Dalarna", "8": "Gävleborg/Jämtland", "9": "Norrland"}


def postal_code(x: Column) -> Column:
    """Five digits of a postal code, or null."""
    d = F.regexp_replace(x, "[^0-9]", "")
    return F.when((F.length(d) == 5) & (F.substring(d, 1, 1) != "0"), d)


def region(postal: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in REGIONS.items() for v in kv]), F.substring(postal, 1, 1))


def street_of(x: Column) -> Column:
    """Lower-cased street with its abbreviation written out."""
    out = F.lower(F.btrim(x))
    for short, full in ABBREVIATIONS:
        out = F.regexp_replace(out, "(?U)(?<=\\w)" + short.replace(".", "\\.") + "(?=\\s|$)", full)
    return out


def parse(raw: Column) -> Column:
    """Struct (co_name, box, street, number, postal, city, floor, region, virtual)."""
    x = F.btrim(F.coalesce(raw, F.lit("")))
    grab = lambda p, k=1: F.nullif(F.btrim(F.regexp_extract(x, p, k)), F.lit(""))
    co, box = grab("(?i)c/o\\s+([^,]+)"), grab("(?i)\\b(?:post)?box\\s+([0-9]+)")
    postal, city = postal_code(F.regexp_extract(x, "\\b([0-9]{3}\\s?[0-9]{2})\\b", 1)), grab("\\b[0-9]{3}\\s?[0-9]{2}\\s+([^,]+)$")
    floor = grab("(?i)\\b([0-9]+)\\s*tr\\b")
    rest = F.regexp_replace(x, "(?i)c/o\\s+[^,]+,?|\\b(?:post)?box\\s+[0-9]+,?|\\b[0-9]{3}\\s?[0-9]{2}\\b.*$|,?\\s*[0-9]+\\s*tr\\b", "")
    rest = F.btrim(F.regexp_replace(rest, "[,\\s]+$", ""))
    number = F.nullif(F.regexp_extract(rest, "(?i)\\s([0-9]+\\s?[a-z]?)$", 1), F.lit(""))
    street = F.nullif(street_of(F.regexp_replace(rest, "(?i)\\s[0-9]+\\s?[a-z]?$", "")), F.lit(""))
    return F.struct(co.alias("co_name"), box.alias("box"), street.alias("street"), F.upper(number).alias("number"), postal.alias("postal"), city.alias("city"), floor.alias("floor"), region(postal).alias("region"), (co.isNotNull() | box.isNotNull() | x.rlike(f"(?iU){VIRTUAL}")).alias("virtual"))


def cluster_key(parsed: Column) -> Column:
    """Postal code with the box, else with street and number."""
    where = F.when(parsed["box"].isNotNull(), F.concat(F.lit("box"), parsed["box"])).otherwise(F.concat_ws(" ", parsed["street"], parsed["number"]))
    return F.concat_ws("-", F.coalesce(parsed["postal"], F.lit("")), where)


def same(a: Column, b: Column) -> Column:
    return cluster_key(parse(a)) == cluster_key(parse(b))


def display(parsed: Column) -> Column:
    return F.concat_ws(", ", F.concat_ws(" ", F.initcap(parsed["street"]), parsed["number"]), F.concat_ws(" ", parsed["postal"], parsed["city"]))

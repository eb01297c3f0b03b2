"""Names of companies, persons and places, and dates as written. Patterns are Unicode-aware."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lists import ROLES

#: Words for a company's state, its legal form and articles.
STATUS_WORDS = ("I LIKVIDATION", "I KONKURS", "UNDER KONKURS", "UNDER LIKVIDATION", "AVREGISTRERAD")
LEGAL_FORMS = (("AKTIEBOLAGET", "AB"), ("AKTIEBOLAG", "AB"), ("HANDELSBOLAGET", "HB"), ("HANDELSBOLAG", "HB"), ("KOMMANDITBOLAGET", "KB"), ("KOMMANDITBOLAG", "KB"), ("EKONOMISK FÖRENING", "EF"))
SHORT_FORMS = "AB|HB|KB|EF"
ARTICLES = "THE|DEN|DET|DE"
ACCENTED, PLAIN = "åäöéèêëáàâçñüïíìîóòôúùûßÅÄÖÉÈÊËÁÀÂÇÑÜÏÍÌÎÓÒÔÚÙÛ", "aaoeeeeaaacnuiiiiooouuusAAOEEEEAAACNUIIIIOOOUUU"
TITLES = ("mr", "mrs", "ms", "dr", "prof", "herr", "fru", "fröken")
MONTHS = ("januari", "februari", "mars", "april", "maj", "juni", "juli", "augusti", "september", "oktober", "november", "december")


def company_name(name: Column) -> Column:
    """Struct (normalized, base, legal_form, status) of an upper-cased name without status, legal form, marks and articles."""
    x = F.upper(F.btrim(F.coalesce(name, F.lit(""))))
    status_words = "|".join(STATUS_WORDS)
    status = F.regexp_extract(x, f"(?U)\\b({status_words})\\b", 1)
    x = F.regexp_replace(x, f"(?U)\\(?\\b({status_words})\\b\\)?", "")
    full = F.coalesce(*[F.when(x.rlike(f"(?U)\\b{f}\\b"), F.lit(s)) for f, s in LEGAL_FORMS])
    short = F.regexp_extract(x, f"(?U)\\b({SHORT_FORMS})\\b\\s*$", 1)
    form = F.coalesce(full, F.when(short != "", short))
    words = "|".join(f for f, _ in LEGAL_FORMS)
    base = F.when(full.isNotNull(), F.regexp_replace(x, f"(?U)\\b({words})\\b", "")).otherwise(F.regexp_replace(x, f"(?U)\\b({SHORT_FORMS})\\b\\s*$", ""))
    base = F.btrim(F.regexp_replace(F.regexp_replace(base, "(?U)[^\\w\\s']", " "), "(?U)\\s+", " "))
    base = F.regexp_replace(F.regexp_replace(base, f"^({ARTICLES}) ", ""), f" ({ARTICLES})$", "")
    return F.struct(F.btrim(F.concat_ws(" ", base, form)).alias("normalized"), base.alias("base"), form.alias("legal_form"), F.when(status != "", status).alias("status"))


def strip_accents(x: Column) -> Column:
    """Latin letters without their marks."""
    return F.translate(x, ACCENTED, PLAIN)


def person_name(name: Column, nicknames: Mapping[str, str] | None = None) -> Column:
    """Lower-cased, accents and marks gone, white space collapsed, suffixes dropped, nicknames replaced."""
    x = F.lower(strip_accents(name))
    x = F.btrim(F.regexp_replace(F.regexp_replace(x, "[^a-z\\s-]", " "), "\\s+", " "))
    x = F.regexp_replace(x, "\\s+(jr|sr|ii|iii)$", "")
    if not nicknames:
        return x
    table = F.create_map(*[F.lit(v) for kv in nicknames.items() for v in kv])
    return F.array_join(F.transform(F.split(x, " "), lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def watchlist_name(name: Column) -> Column:
    """Lower-cased, titles before a name and punctuation gone, so that a hyphen joins its parts."""
    x = F.regexp_replace(F.lower(name), "(?U)\\b(" + "|".join(TITLES) + ")\\.?\\s+", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(x, "(?U)[^\\w\\s]", ""), "(?U)\\s+", " "))


def name_contains(name: Column, words: Sequence[str]) -> Column:
    return name.rlike("(?iU)(" + "|".join(words) + ")")


def register_name(name: Column) -> Column:
    """Upper-cased without company suffixes and marks, as leaked registers are matched."""
    x = F.regexp_replace(F.upper(name), "\\b(LTD|LIMITED|INC|CORP|LLC|AB|SA)\\b\\.?", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(x, "(?U)[^\\w\\s]", " "), "\\s+", " "))


def date_of(x: Column) -> Column:
    """ISO date, else 'd month yyyy' in Swedish; null otherwise."""
    swedish = F.lower(F.btrim(x))
    month = F.regexp_extract(swedish, "^[0-9]{1,2} ([a-zåäö]+) [0-9]{4}$", 1)
    number = F.element_at(F.create_map(*[F.lit(v) for k, m in enumerate(MONTHS) for v in (m, f"{k + 1:02d}")]), month)
    day, year = F.lpad(F.regexp_extract(swedish, "^([0-9]{1,2}) ", 1), 2, "0"), F.regexp_extract(swedish, "([0-9]{4})$", 1)
    return F.coalesce(F.try_to_date(F.btrim(x), "yyyy-MM-dd"), F.try_to_date(F.concat_ws("-", year, number, day), "yyyy-MM-dd"))


def role_of(role: Column, roles: Sequence[tuple[str, str]] = ROLES, default: str | None = "UNKNOWN") -> Column:
    """The class of an exactly equal role, else of the first one, in order, that occurs in it, else the default; null for null."""
    x = F.lower(F.btrim(role))
    return F.when(x.isNotNull(), F.coalesce(*[F.when(x == k, F.lit(v)) for k, v in roles], *[F.when(F.contains(x, F.lit(k)), F.lit(v)) for k, v in roles], F.lit(default)))

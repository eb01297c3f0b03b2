"""Swedish identifiers: check digits, organisation and personal numbers, classes, masks, keyed digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn(digits: Column) -> Column:
    """Check digit of a digit string: every second digit from the first is doubled, its digits summed. Null for anything else."""
    numbers = F.transform(F.split(digits, ""), lambda d: d.cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return F.when(digits.rlike("^[0-9]+$"), F.pmod(10 - total % 10, F.lit(10)))


def _safe_luhn(digits: Column) -> Column:
    return luhn(F.when(digits.rlike("^[0-9]+$"), digits).otherwise(F.lit("0")))


def orgnr_digits(raw: Column) -> Column:
    """Ten digits of an organisation number as written, or null: with or without a hyphen, blanks around, and a century prefix of 16."""
    x = F.btrim(raw)
    ten = F.regexp_extract(x, r"^(?:16)?([0-9]{6})-?([0-9]{4})$", 1)
    return F.when(x.rlike(r"^(?:16)?[0-9]{6}-?[0-9]{4}$"), F.concat(ten, F.regexp_extract(x, r"^(?:16)?([0-9]{6})-?([0-9]{4})$", 2)))


def organisation_number(raw: Column) -> Column:
    """Struct (valid, number, type): third and fourth digits at least 20, check digit right; type is the first digit."""
    n = orgnr_digits(raw)
    valid = n.isNotNull() & (F.substring(n, 3, 2) >= "20") & (_safe_luhn(F.substring(n, 1, 9)).cast("string") == F.substring(n, 10, 1))
    ok = F.coalesce(valid, F.lit(False))
    return F.struct(ok.alias("valid"), F.when(ok, n).alias("number"), F.when(ok, F.substring(n, 1, 1)).alias("type"))


def format_orgnr(number: Column, prefix: bool = False) -> Column:
    return F.concat(F.lit("16" if prefix else ""), F.substring(number, 1, 6), F.lit("-"), F.substring(number, 7, 4))


PNR = r"^([0-9]{2})?([0-9]{6})([-+]?)([0-9]{4})$"


def personal_number(raw: Column, as_of: Column) -> Column:
    """Struct (valid, number of 12 digits, birth, gender, coordination). The century of a ten-digit number follows as_of; + adds a hundred years of age.

    A coordination number has 60 added to its day. Eleven digits, impossible dates and births after as_of are invalid.
    """
    x = F.btrim(raw)
    part = lambda k: F.regexp_extract(x, PNR, k)
    body, sign, tail = part(2), part(3), part(4)
    short_year = F.when(body != "", F.substring(body, 1, 2)).otherwise("00").cast("int")
    now = F.year(as_of)
    guess = F.floor(now / 100) * 100 + short_year
    guess = F.when(guess > now, guess - 100).otherwise(guess)
    year = F.when(part(1) != "", F.concat(part(1), F.substring(body, 1, 2)).cast("string")).otherwise((guess - F.when(sign == "+", 100).otherwise(0)).cast("string"))
    day = F.when(body != "", F.substring(body, 5, 2)).otherwise("00").cast("int")
    coordination = day > 60
    birth = F.try_to_date(F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.substring(body, 3, 2), F.lit("-"), F.lpad(F.when(coordination, day - 60).otherwise(day).cast("string"), 2, "0")), "yyyy-MM-dd")
    nine = F.concat(body, F.substring(tail, 1, 3))
    good = x.rlike(PNR) & birth.isNotNull() & (birth <= as_of) & (_safe_luhn(nine).cast("string") == F.substring(tail, 4, 1))
    ok = F.coalesce(good, F.lit(False))
    gender = F.when(F.when(tail != "", F.substring(tail, 3, 1)).otherwise("0").cast("int") % 2 == 1, "M").otherwise("F")
    return F.struct(ok.alias("valid"), F.when(ok, F.concat(F.substring(F.lpad(year, 4, "0"), 1, 2), body, tail)).alias("number"), F.when(ok, birth).alias("birth"), F.when(ok, gender).alias("gender"), F.when(ok, coordination).alias("coordination"))


def classify(raw: Column, as_of: Column) -> Column:
    """PNR, SNR (coordination) or ORG; null if it is none of them."""
    p = personal_number(raw, as_of)
    return F.when(p["valid"] & p["coordination"], "SNR").when(p["valid"], "PNR").when(organisation_number(raw)["valid"], "ORG")


def mask(identifier: Column, shown: int = 4) -> Column:
    """All but the last `shown` characters as stars."""
    return F.concat(F.regexp_replace(F.substring(identifier, F.lit(1), F.greatest(F.length(identifier) - shown, F.lit(0))), ".", "*"), F.right(identifier, F.lit(shown)))


def candidate_ids(start: Column, count: int) -> Column:
    """Ten-digit numbers from a nine-digit start on, each with its check digit."""
    bodies = F.transform(F.sequence(start.cast("long"), start.cast("long") + count - 1), lambda n: F.lpad(n.cast("string"), 9, "0"))
    return F.transform(bodies, lambda b: F.concat(b, luhn(b).cast("string")))


def blind_index(column: Column, key: bytes) -> Column:
    """Hexadecimal HMAC-SHA-256 of the digits and letters of an identifier, upper-cased."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    message = F.upper(F.regexp_replace(column, "[^0-9A-Za-z]", "")).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def anonymous_name(name: Column, salt: str = "") -> Column:
    return F.concat(F.lit("ANON-"), F.substring(F.sha2(F.concat(F.lit(salt), name), 256), 1, 16))

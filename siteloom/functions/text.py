"""Validators and string functions as Column expressions; null means rejected."""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteloom.functions import fixed

_BLANKS = " \t\r\n\f\x0b"


def strip(c: Column, chars: str = _BLANKS) -> Column:
    return F.btrim(c, F.lit(chars))


def filled(c: Column) -> Column:
    """Null for the empty string too."""
    return F.nullif(c, F.lit(""))


def collapsed(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def matched(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null if there is none."""
    return filled(F.regexp_extract(c, pattern, group))


def clean_text(c: Column) -> Column:
    return filled(strip(collapsed(c), " ,;\t\r\n"))


def valid_email(c: Column, context: Column | None = None) -> Column:
    email = F.lower(strip(c))
    ok = email.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z") & ~email.rlike("|".join(fixed.EMAIL_REJECTS))
    if context is not None:
        around = F.coalesce(F.lower(context), F.lit(""))
        cue = around.rlike("|".join(re.escape(x) for x in fixed.EMAIL_EXAMPLE_CUES))
        ok = ok & ~(cue & F.contains(around, email))
    return F.when(ok, email)


def valid_phone(c: Column) -> Column:
    phone = collapsed(strip(c))
    return F.when(F.length(digits(phone)).between(7, 15) & (F.length(phone) >= 7), phone)


def valid_registration(c: Column) -> Column:
    number = F.upper(matched(strip(c, " :.-,#/\t\r\n"), r"(?i)^([A-Z]{0,2}[0-9]{5,8}|[A-Z0-9\-]{4,15})"))
    return F.when(number.rlike("[0-9]"), number)


def valid_vat(c: Column) -> Column:
    raw = strip(matched(strip(c, " :.-,#/\t\r\n"), r"(?i)^([A-Z]{0,2}\s*[0-9\s\.\-]{6,16})"))
    return F.when(F.length(digits(raw)).between(6, 15), strip(F.upper(collapsed(raw)), " ,.-"))


def uk_postcode(c: Column) -> Column:
    found = matched(F.upper(collapsed(strip(c))), r"\b([A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2})\b")
    code = F.replace(found, F.lit(" "), F.lit(""))
    return F.concat(F.substr(code, F.lit(1), F.length(code) - 3), F.lit(" "), F.right(code, F.lit(3)))


def valid_address(c: Column) -> Column:
    address = collapsed(strip(c, " ,;-"))
    place = (
        address.rlike("[0-9]")
        | address.rlike(rf"(?iu)\b({fixed.STREET_WORDS})\b")
        | address.rlike(r"\b([A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}|\d{5}(?:-\d{4})?|[A-Z]\d[A-Z]\s*\d[A-Z]\d|\d{4,5})\b")
    )
    ok = F.length(address).between(10, 300) & place & ~address.rlike(rf"(?i)\b({fixed.ADDRESS_BOILERPLATE})\b")
    return F.when(ok, address)


def clean_address(c: Column) -> Column:
    """Tokens of an address without repeats, up to the first that belongs to something else; a leading label goes."""
    tokens = F.transform(
        F.filter(F.split(c, r"[,|\n]"), lambda t: strip(t) != ""), lambda t: strip(t, " \t\r\n,;")
    )
    stops = "(?iu)" + "|".join(rf"\b{p}\b" for p in fixed.ADDRESS_STOPS)

    def step(a: Column, t: Column) -> Column:
        over = a["over"] | F.lower(t).isin(fixed.ADDRESS_STOP_TOKENS) | t.rlike(stops)
        new = ~F.array_contains(F.transform(a["kept"], lambda k: F.lower(k)), F.lower(t)) | (F.length(t) > 20)
        return F.struct(over.alias("over"), F.when(~over & new, F.array_append(a["kept"], t)).otherwise(a["kept"]).alias("kept"))

    zero = F.struct(F.lit(False).alias("over"), F.array().cast("array<string>").alias("kept"))
    joined = F.array_join(F.aggregate(tokens, zero, step)["kept"], ", ")
    label = r"(?i)^(address|registered office|head office|location)\s*[:\-]?\s*"
    return strip(F.regexp_replace(joined, label, ""), " ,;")


def without_suffixes(c: Column) -> Column:
    """A name without its corporate suffixes, tried one after the other: a fold, as plans compare nested trims very slowly."""
    patterns = F.array(*(F.lit(rf"(?i),?\s+{re.escape(suffix)}\z") for suffix in fixed.CORPORATE_SUFFIXES))
    return F.aggregate(patterns, c, lambda name, p: strip(F.regexp_replace(name, p, F.lit(""))))


def company_number(c: Column) -> Column:
    """UK company number: known prefix and six digits, or eight digits; anything else as it is."""
    number = F.upper(F.regexp_replace(filled(c), r"\s+", ""))
    prefix, tail = F.regexp_extract(number, "^([A-Z]{2})([0-9]+)$", 1), F.regexp_extract(number, "^([A-Z]{2})([0-9]+)$", 2)

    def padded(x: Column, n: int) -> Column:
        return F.when(F.length(x) >= n, x).otherwise(F.lpad(x, n, "0"))

    return (
        F.when(prefix.isin(fixed.UK_PREFIXES), F.concat(prefix, padded(tail, 6)))
        .when(number.rlike("^[0-9]+$"), padded(number, 8))
        .otherwise(number)
    )


def comparable_name(c: Column, rules: list[tuple[str, str]]) -> Column:
    name = strip(collapsed(F.regexp_replace(F.upper(strip(c)), r"(?U)[^\w\s]", " ")))
    for pattern, replacement in rules:
        name = F.regexp_replace(name, "(?U)" + pattern, replacement)
    return strip(collapsed(name))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def country(c: Column) -> Column:
    plain = F.regexp_replace(F.lower(strip(c)), r"[.,;]+\z", "")
    aliases = _map(fixed.COUNTRY_ALIASES)
    found = F.coalesce(F.try_element_at(aliases, plain), F.try_element_at(aliases, F.replace(plain, F.lit("."), F.lit(""))))
    return F.coalesce(found, F.when(plain != "", F.initcap(strip(c))))


def country_in_text(c: Column) -> Column:
    text = F.lower(c)
    out = F.lit(None).cast("string")
    for name in (fixed.US, fixed.UK):
        out = F.when(F.contains(text, F.lit(name.lower())), name).otherwise(out)
    # aliases of one country that follow each other are one pattern
    for name, aliases in reversed([(n, list(a)) for n, a in groupby(fixed.COUNTRY_ALIASES, fixed.COUNTRY_ALIASES.get)]):
        out = F.when(text.rlike(rf"\b(?:{'|'.join(map(re.escape, aliases))})\b"), name).otherwise(out)
    return out


def state_in_text(c: Column) -> Column:
    """Two-letter state: by full name, longest first, else by an abbreviation in address context.

    All names are one pattern: no name ends in what another begins with, and one inside another is the shorter.
    """
    names = sorted(fixed.US_STATES, key=lambda n: (-len(n), n))
    states = {n.lower(): fixed.US_STATES[n] for n in names}
    said = F.regexp_extract_all(F.lower(c), F.lit(rf"\b({'|'.join(states)})\b"), F.lit(1))
    first = lambda said: F.get(F.filter(F.array(*(F.lit(n) for n in states)), lambda n: F.array_contains(said, n)), F.lit(0))
    named = F.get(F.transform(F.array(said), lambda x: F.when(F.size(x) > 0, F.try_element_at(_map(states), first(x)))), F.lit(0))
    short = F.regexp_extract_all(c, F.lit(r"(?m)(?:,\s*|\(\s*|\b)([A-Z]{2})(?:\s+\d{5}|\s*[,)\s]|$)"), F.lit(1))
    known = F.filter(short, lambda s: s.isin(list(fixed.US_STATES.values())))
    return F.coalesce(named, F.get(known, F.lit(0)))


def ny_phone(c: Column) -> Column:
    number = digits(c)
    area = F.when(F.startswith(number, F.lit("1")) & (F.length(number) >= 4), F.substr(number, F.lit(2), F.lit(3)))
    area = F.coalesce(area, F.when(F.length(number) >= 3, F.substr(number, F.lit(1), F.lit(3))))
    return F.coalesce(area.isin(fixed.NY_AREA_CODES), F.lit(False))


def country_of_host(c: Column) -> Column:
    host = F.split_part(F.split_part(F.lower(c), F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1))
    out = F.lit(None).cast("string")
    for ending, name in reversed(fixed.COUNTRY_ENDINGS.items()):
        out = F.when(F.endswith(host, F.lit(ending)), name).otherwise(out)
    return out

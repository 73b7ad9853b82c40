"""Cleaning and normalising of strings as columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.nicknames import NICKNAMES

# Titles and suffixes that a name loses, and address abbreviations in their order.
TITLES = ("mr", "mrs", "ms", "dr", "prof", "rev")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md")
ADDRESS_WORDS = (
    (r"\bst\b", "street"), (r"\bave\b", "avenue"), (r"\bav\b", "avenue"), (r"\bblvd\b", "boulevard"), (r"\bdr\b", "drive"),
    (r"\brd\b", "road"), (r"\bln\b", "lane"), (r"\bct\b", "court"), (r"\bpl\b", "place"), (r"\bpkwy\b", "parkway"),
    (r"\bapt\b", "apartment"), (r"\bapts\b", "apartments"), (r"\b#\b", ""), (r"\.", ""), (",", ""),
)
# Strings that a CSV reader takes for null.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def squeeze(c: Column) -> Column:
    """Without white space at the ends; runs inside become one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean(c: Column) -> Column:
    """What loading does to a string: null and 'nan' become empty, lower case, squeezed."""
    low = squeeze(F.lower(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(low == "nan", F.lit("")).otherwise(low)


def normalize_string(c: Column) -> Column:
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def normalize_email(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)^\s+|\s+$", "")


def normalize_phone(c: Column) -> Column:
    """Digits only, without the leading 1 of eleven."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def normalize_address(c: Column) -> Column:
    return squeeze(reduce(lambda x, r: F.regexp_replace(x, *r), ADDRESS_WORDS, normalize_email(c)))


def title_case(c: Column) -> Column:
    """The first letter of every run of letters in upper case, the rest in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")


def normalize_name(c: Column, nicknames: Mapping[str, str] = NICKNAMES) -> Column:
    """Without a title and a suffix, nicknames replaced once, in title case."""
    lookup = F.create_map(*[F.lit(x) for pair in (dict(nicknames) or {"": ""}).items() for x in pair])
    parts = F.filter(F.split(normalize_string(c), " "), lambda p: p != "")
    parts = F.when(F.get(parts, F.lit(0)).isin(*TITLES), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    cut = (F.size(parts) > 1) & F.get(parts, F.size(parts) - 1).isin(*SUFFIXES)
    parts = F.when(cut, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return title_case(F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(lookup, p), p)), " "))


def normalize(kind: str, c: Column) -> Column:
    """The normal form of a column of a semantic type; numbers and dates stay as they are."""
    if kind == "phone":
        return normalize_phone(c)
    if kind == "email":
        return normalize_email(c)
    if kind == "string_name":
        return normalize_name(c)
    if kind == "string_general":
        return normalize_string(c)
    return c

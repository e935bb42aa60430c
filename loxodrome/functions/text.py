"""Names, contacts and addresses, normalised for comparison."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def folded(text: Column) -> Column:
    """Trimmed, white space collapsed, lower case."""
    return F.lower(F.btrim(F.regexp_replace(text, r"\s+", " ")))


def normalize_name(name: Column, *, ascii_only: bool = False) -> Column:
    """NFKC, trimmed, white space collapsed, lower case; null becomes empty.  ``ascii_only`` skips NFKC and stays in the JVM."""
    text = F.coalesce(name, F.lit(""))
    return folded(text if ascii_only else _nfkc(text))


def distinct_values(*arrays: Column) -> Column:
    """Sorted distinct trimmed texts of all arrays, without blanks."""
    whole = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    return F.array_sort(F.array_distinct(F.filter(F.transform(whole, F.trim), lambda x: x != "")))


def phone_keys(phones: Column) -> Column:
    """Domestic numbers (0 and 9 or 10 digits) of texts split at semicolons; +81 becomes 0, full-width digits plain."""
    wide = "０１２３４５６７８９＋（）－　"
    parts = F.flatten(F.transform(F.coalesce(phones, F.array().cast("array<string>")), lambda x: F.split(F.translate(x, wide, "0123456789+()- "), ";")))
    plain = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, r"[\s()\-‐‑–ー]", ""), r"^\+81", "0"))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda x: x.rlike("^0[0-9]{9,10}$"))))


def domain_keys(urls: Column) -> Column:
    """Hosts, lower case, without www. and a closing dot."""
    hosts = F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda x: F.lower(F.regexp_extract(F.when(x.contains("://"), x).otherwise(F.concat(F.lit("https://"), x)), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)", 1)))
    fit = F.filter(hosts, lambda x: x.contains("."))
    return F.array_sort(F.array_distinct(F.transform(fit, lambda x: F.regexp_replace(F.regexp_replace(x, r"^www\.", ""), r"\.+$", ""))))


def evidence(left: Column, right: Column) -> Column:
    """Two key sets: unavailable if one is empty, supporting if they meet, else conflicting."""
    empty = (F.coalesce(F.size(left), F.lit(0)) <= 0) | (F.coalesce(F.size(right), F.lit(0)) <= 0)
    return F.when(empty, "unavailable").when(F.arrays_overlap(left, right), "supporting").otherwise("conflicting")


def address_evidence(left: Column, right: Column) -> Column:
    """Of arrays of maps: disjoint 7-digit postcodes conflict, an equal free form supports."""

    def parts(side: Column, *keys: str) -> Column:
        found = F.flatten(F.transform(F.coalesce(side, F.array().cast("array<map<string,string>>")), lambda m: F.array(*[m[k] for k in keys])))
        return F.filter(F.transform(found, folded), lambda x: F.coalesce(x != "", F.lit(False)))

    def codes(side: Column) -> Column:
        return F.filter(F.transform(parts(side, "postcode", "addr:postcode"), lambda x: F.regexp_replace(x, r"[-\s]", "")), lambda x: x.rlike("^[0-9]{7}$"))

    def some(side: Column) -> Column:
        return F.coalesce(F.exists(side, lambda m: F.exists(F.map_values(m), lambda v: F.coalesce(F.trim(v) != "", F.lit(False)))), F.lit(False))

    a, b = codes(left), codes(right)
    free_a, free_b = (parts(s, "freeform", "address", "addr:full") for s in (left, right))
    disjoint = (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
    return F.when(disjoint, "conflicting").when(F.arrays_overlap(free_a, free_b), "supporting").when(some(left) & some(right), "not_comparable").otherwise("unavailable")


def from_provider(sources: Column, provider: str) -> Column:
    """Whether an array of structs (provider, dataset) names the provider, in any case."""
    return F.coalesce(F.exists(sources, lambda s: (F.lower(s["provider"]) == provider) | (F.lower(s["dataset"]) == provider)), F.lit(False))


def present(values: Column) -> Column:
    """Whether an array has a text that isn't blank."""
    return F.coalesce(F.exists(values, lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), F.lit(False))


def display_line(line: Column) -> Column:
    """Without the number that some line names begin with."""
    return F.regexp_replace(F.coalesce(line, F.lit("")), r"^\d+号線(?=.)", "")


def _ratio(a: str | None, b: str | None) -> float | None:
    if not a or not b:
        return None
    if a == b:
        return 1.0
    both = (difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in ((a, b), (b, a)))
    return sum(both) / 2


@F.pandas_udf(T.DoubleType())
def name_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Mean Ratcliff-Obershelp ratio of both directions; null if a name is empty."""
    return pd.Series([_ratio(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")

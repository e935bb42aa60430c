"""Checks that stop a run instead of letting a wrong table pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class QualityError(ValueError):
    """A gate was not passed."""


def require_columns(df: DataFrame, columns: Mapping[str, str], forbidden: Sequence[str] = ()) -> DataFrame:
    """``df``, if it has these columns with these types and none of the forbidden ones."""
    types = dict(df.dtypes)
    wrong = {c: (t, types.get(c)) for c, t in columns.items() if types.get(c) != T._parse_datatype_string(t).simpleString()}
    bad = [c for c in forbidden if c in types]
    if wrong or bad:
        raise QualityError(f"schema differs: {wrong}, not allowed: {bad}")
    return df


def counters(df: DataFrame, key: str, conditions: Mapping[str, Column]) -> DataFrame:
    """One row: rows, distinct ids, null ids, and rows that break each condition (null breaks it)."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("ids"), F.count_if(F.col(key).isNull()).alias("null_ids"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()])


def gate(df: DataFrame, key: str, conditions: Mapping[str, Column], expected: int | None = None) -> DataFrame:
    """``df``, if ids are unique and not null, every row meets the conditions, and the number of rows is as expected."""
    row = counters(df, key, conditions).first().asDict()
    broken = {k: v for k, v in row.items() if k not in ("rows", "ids") and v}
    if row["rows"] != row["ids"] + row["null_ids"] or broken or (expected is not None and row["rows"] != expected):
        raise QualityError(f"gate not passed: {row}, expected rows: {expected}")
    return df


def conflicts(df: DataFrame, key: str) -> DataFrame:
    """Ids that stay more than once after equal rows are merged."""
    return df.distinct().groupBy(key).agg(F.count("*").alias("versions")).where("versions > 1")


def truncated(df: DataFrame, key: str, limit: int) -> tuple[DataFrame, bool]:
    """The first ``limit`` rows by id, and whether there are more."""
    if not 1 <= limit:
        raise ValueError("limit must be at least 1")
    probe = df.orderBy(key).limit(limit + 1)
    return probe.orderBy(key).limit(limit), probe.count() > limit


def conserved(parts: DataFrame, whole: DataFrame, by: Sequence[str], column: str, tolerance: float = 0.0) -> DataFrame:
    """Groups in which the sum over the parts differs from the whole by more than ``tolerance``."""
    sums = parts.groupBy(*by).agg(F.sum(column).alias("_parts"))
    joined = whole.select(*by, F.col(column).alias("_whole")).join(sums, list(by), "full")
    return joined.where(F.abs(F.coalesce("_whole", F.lit(0)) - F.coalesce("_parts", F.lit(0))) > tolerance)


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule (a null counts as kept), with the rule's name."""
    broken = F.filter(F.array(*[F.when(~c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("rule", F.explode(broken))


def first_reason(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """``df`` with the first reason that holds (null: none), as a chain of filters would find it."""
    chain = None
    for name, c in reasons.items():
        chain = F.when(c, name) if chain is None else chain.when(c, name)
    return df.withColumn("reason", chain)


def redacted(message: str, secrets: Sequence[str]) -> str:
    """A message without secrets: each, and its percent-encoded form, is replaced; longer ones first, so none leaves a part behind."""
    from urllib.parse import quote

    known = {form for s in secrets if s for form in (s, quote(s, safe=""))}
    for form in sorted(known, key=lambda x: (-len(x), x)):
        message = message.replace(form, "[redacted]")
    return message

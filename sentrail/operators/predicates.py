"""Predicates and projections as column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A file glob (* ? [set]) as an anchored Java regex."""
    out = ""
    for ch in glob:
        out += {"*": ".*", "?": "."}.get(ch) or (re.escape(ch) if ch not in "[]" else ch)
    return f"(?i)^{out}$"


def excluded(c: Column, globs: Sequence[str]) -> Column:
    """Whether a name matches any of the globs; null matches none."""
    return F.coalesce(reduce(lambda a, b: a | b, [c.rlike(glob_regex(g)) for g in globs]), F.lit(False))


def one_of(c: Column, names: Sequence[str]) -> Column:
    """Membership regardless of case; null is in no set."""
    return F.coalesce(F.lower(c).isin([n.lower() for n in names]), F.lit(False))


def first_match(c: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first substring, in the order given, that stands in the text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    whole = None
    for needle, label in rules:
        hit = low.contains(needle.lower())
        whole = F.when(hit, F.lit(label)) if whole is None else whole.when(hit, F.lit(label))
    return F.lit(default) if whole is None else whole.otherwise(default)


def in_work_hours(ts: Column, first: int = 9, last: int = 18) -> Column:
    """Monday to Friday, first <= hour < last."""
    return F.weekday(ts).between(0, 4) & (F.hour(ts) >= first) & (F.hour(ts) < last)


def or_else(a: Column, b: Column) -> Column:
    """a if it is neither null nor empty, else b."""
    return F.coalesce(F.when(a.cast("string") != "", a), b)


def table_filter(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column matches the pattern regardless of case; a leading ! keeps the others (nulls too)."""
    wanted = not pattern.startswith("!")
    hit = F.coalesce(F.col(column).cast("string").rlike("(?i)" + pattern.lstrip("!")), F.lit(False))
    return df.filter(hit if wanted else ~hit)


def between_open(c: Column, above: object = None, below: object = None) -> Column:
    """Strictly above and strictly below; an absent bound holds for all."""
    ok = F.lit(True)
    if above is not None:
        ok = ok & (c > F.lit(above))
    if below is not None:
        ok = ok & (c < F.lit(below))
    return ok


def only_if_any(df: DataFrame, condition: DataFrame) -> DataFrame:
    """df if the condition has a row, else no rows."""
    one = condition.limit(1).select(F.lit(1).alias("_one"))
    return df.withColumn("_one", F.lit(1)).join(one, "_one", "left_semi").drop("_one")


def search(df: DataFrame, query: str, fields: dict[str, str], text: Sequence[str], tags: Sequence[str] = ()) -> DataFrame:
    """Rows that meet a search line of `field:value` tokens and free patterns.

    Values of one field listed in tags are alternatives; all other tokens must hold. A free pattern must
    match one of the text columns, regardless of case. An unknown field matches nothing.
    """
    any_of: dict[str, list[Column]] = {}
    ok = F.lit(True)
    for token in query.split():
        field, sep, value = token.partition(":")
        if sep and field in fields:
            hit = F.coalesce(F.lower(F.col(fields[field]).cast("string")) == value.lower(), F.lit(False))
            if field in tags:
                any_of.setdefault(field, []).append(hit)
            else:
                ok = ok & hit
        elif sep:
            ok = F.lit(False)
        else:
            ok = ok & reduce(lambda a, b: a | b, [F.coalesce(F.col(t).cast("string").rlike("(?i)" + token), F.lit(False)) for t in text])
    for hits in any_of.values():
        ok = ok & reduce(lambda a, b: a | b, hits)
    return df.filter(ok)

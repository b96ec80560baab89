"""Scalar functions: paths, text, hashes, formats and vectors as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The building blocks of grok patterns.
GROK = {"INT": r"[+-]?\d+", "NUMBER": r"[+-]?\d+(?:\.\d+)?", "WORD": r"\w+", "NOTSPACE": r"\S+", "DATA": r".*?", "GREEDYDATA": r".*", "IP": r"\d{1,3}(?:\.\d{1,3}){3}", "PATH": r"(?:/[^\s/]+)+", "HOSTNAME": r"[A-Za-z0-9.\-]+", "URIHOST": r"[A-Za-z0-9.\-]+(?::\d+)?"}


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def dirname(path: Column) -> Column:
    """All before the last separator; '' where there is none."""
    return F.regexp_extract(path, r"^(.*)[/\\]", 1)


def path_part(path: Column, i: int) -> Column:
    """Component i from 0, from the end if negative; null where there is none."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda p: p != "")
    return F.try_element_at(parts, F.lit(i + 1 if i >= 0 else i))


def joint_hash(content: Column, version: Column) -> Column:
    return F.sha2(F.concat(content, F.lit("||"), version), 256)


def hash_choice(text: Column, choices: int) -> Column:
    """A number below `choices` that depends on the text alone."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % choices).cast("int")


def humanize(n: Column) -> Column:
    """Bytes in the largest decimal unit that gives at least 1, one decimal place."""
    c = F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B")))
    for unit, size in (("kB", 1e3), ("MB", 1e6), ("GB", 1e9)):
        c = c.when(n < size * 1000, F.concat(F.format_string("%.1f", F.round(n / size, 1)), F.lit(" " + unit)))
    return c.otherwise(F.concat(F.format_string("%.1f", F.round(n / 1e12, 1)), F.lit(" TB")))


def transform_regex(c: Column, replacements: dict[str, str]) -> Column:
    """Several patterns replaced one after the other."""
    for pattern, by in replacements.items():
        c = F.regexp_replace(c, pattern, by)
    return c


def named_groups(c: Column, pattern: str) -> Column:
    """The pattern's named groups as a struct of text; null where the pattern doesn't match."""
    names = [m.group(1) for m in re.finditer(r"\(\?<([A-Za-z]\w*)>", pattern)]
    index = {m.group(1): i for i, m in enumerate(re.finditer(r"(?<!\\)\((?:\?<([A-Za-z]\w*)>|(?!\?))", pattern), 1) if m.group(1)}
    return F.when(c.rlike(pattern), F.struct(*[F.regexp_extract(c, pattern, index[n]).alias(n) for n in names]))


def grok(c: Column, pattern: str) -> Column:
    """A grok pattern as named_groups; %{X:name:int} casts, unknown names raise an error."""
    casts: dict[str, str] = {}

    def part(m: re.Match[str]) -> str:
        kind, name, cast = m.group(1), m.group(2), m.group(3)
        if kind not in GROK:
            raise ValueError(f"no grok pattern {kind}")
        if name and cast:
            casts[name] = {"int": "long", "float": "double"}.get(cast, "string")
        return f"(?<{name}>{GROK[kind]})" if name else f"(?:{GROK[kind]})"

    regex = re.sub(r"%\{(\w+)(?::(\w+))?(?::(\w+))?\}", part, pattern)
    groups = named_groups(c, regex)
    names = re.findall(r"\(\?<([A-Za-z]\w*)>", regex)
    return F.when(groups.isNotNull(), F.struct(*[groups[n].try_cast(casts.get(n, "string")).alias(n) for n in names]))


def render(template: str, values: dict[str, Column]) -> Column:
    """{{name}} and {name} filled with columns; unknown names become empty, blanks are collapsed."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*\}\}|\{(\w+)\}", template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(values.get(m.group(1) or m.group(2), F.lit("")).cast("string"), F.lit(""))]
        at = m.end()
    parts.append(F.lit(template[at:]))
    return F.trim(F.regexp_replace(F.concat(*parts), r"\s+", " "))


def multi_hot(values: Column, vocabulary: list[str]) -> Column:
    return F.array(*[F.array_contains(values, v).cast("double") for v in vocabulary])


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def binomial_tail(n: int, p: Column) -> Column:
    """P(more than half of n independent votes are right) at right-vote probability p."""
    from math import comb

    total = F.lit(0.0)
    for k in range(n // 2 + 1, n + 1):
        total = total + comb(n, k) * F.pow(p, k) * F.pow(1 - p, n - k)
    return total

"""Canonical spellings of names, numbers and levels, as JVM-side column expressions.

Nulls stay null. Text that names nothing known gives null (level, machine) or its folded form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width ASCII forms, ideographic and no-break space, built from their rule (offset 0xFEE0).
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　 "
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + "  "
_INVISIBLE = "​‌‍⁠﻿­"

# The project's own level names, in rising order.
LEVEL_NAMES = {"L1": "公开", "L2": "内部", "L3": "机密", "L4": "绝密"}
LEVELS = tuple(LEVEL_NAMES)


def fold(c: Column) -> Column:
    """Narrow full-width forms, drop invisible marks, trim blanks of any kind, lower case."""
    full = F.regexp_replace(F.translate(c, _WIDE + _INVISIBLE, _NARROW), r"^\s+|\s+$", "")
    # Most values are plain ASCII without blanks: one test spares them the rest.
    return F.lower(F.when(c.rlike("^[!-~]*$"), c).otherwise(full))


def name_key(c: Column) -> Column:
    """A name spelt freely: folded, inner separators as one underscore; '' becomes null."""
    k = F.regexp_replace(fold(c), r"[\s\-]+", "_")
    return F.when(k != "", k)


def type_key(c: Column) -> Column:
    """An event type such as file.archive: folded, any separator as one dot; '' becomes null."""
    k = F.regexp_replace(fold(c), r"[\s_/:>\-.]+", ".")
    return F.when(k != "", k)


def machine_key(c: Column) -> Column:
    """Letters and number of a machine name: VM-41, vm0041.desk.example give vm:41; else null."""
    f = fold(c)
    key = F.regexp_replace(f, r"^([a-z]+)[-_ ]*0*([0-9]+)(?:\.[a-z0-9.\-]*)?$", "$1:$2")
    return F.when(key != f, key)


def level_key(c: Column) -> Column:
    """L1 to L4 however written (l2, Level 2, LEVEL_2, the level's own name); else null."""
    f = fold(c)
    number = F.regexp_extract(f, r"^(?:level|l)[\s_\-]*([1-4])$", 1)
    named = reduce(lambda acc, kv: acc.when(f.rlike(f"^{kv[1]}级?(?:[（(]?l{kv[0][1]}[)）]?)?$"), F.lit(kv[0])), LEVEL_NAMES.items(), F.when(number != "", F.concat(F.lit("L"), number)))
    return named


def _percent_decoded(c: Column) -> Column:
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.when(c.contains("%"), F.coalesce(decoded, c)).otherwise(c)


def target_key(event_type: Column, target: Column) -> Column:
    """What a target names: file name, mail address, host and path, device or program.

    event_type is a canonical base type. Null stays null and equals only null.
    """
    return folded_target_key(event_type, fold(target))


def folded_target_key(event_type: Column, target: Column) -> Column:
    """target_key of text that is folded already."""
    f = F.regexp_replace(target, r"^[\"'<\s]+|[\"'>;,\s]+$", "")
    leaf = F.regexp_extract(F.regexp_replace(_percent_decoded(f), r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    mail = F.regexp_extract(f, r"([^\s<>:;,\"']+@[^\s<>;,\"']+)", 1)
    page = _percent_decoded(F.regexp_replace(F.regexp_replace(f, r"^[a-z][a-z0-9+.\-]*://", ""), r"[?#].*$", ""))
    page = F.regexp_replace(F.regexp_replace(page, r"^([^/]*?):(?:80|443)(?=/|$)", "$1"), r"/{2,}", "/")
    page = F.regexp_replace(page, r"/$", "")
    device = F.regexp_replace(leaf, r"[\s_\-]+", "_")
    return (
        F.when(target.isNull(), None)
        .when(event_type == "email", F.when(mail != "", mail).otherwise(f))
        .when(event_type == "http", page)
        .when(event_type == "device", device)
        .otherwise(F.trim(leaf))
    )

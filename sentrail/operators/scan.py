"""Pattern scans over texts: many patterns, a bounded number of hits each, with offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pattern_hits(df: DataFrame, row_id: str, text: str, patterns: dict[str, str], hits: int = 1, context: int = 0, backward: bool = False) -> DataFrame:
    """row_id, rule, hit_no, start, found, around: the first `hits` matches of each pattern in each text.

    Offsets count characters from 0. Patterns are Python regexes, or bytes in hex after '0x'. Null texts
    have no hits; a pattern that matches the empty string hits nowhere. backward counts hits from the end.
    """
    compiled = {n: re.compile(re.escape(bytes.fromhex(p[2:]).decode("utf-8")) if p.startswith("0x") else p) for n, p in patterns.items()}
    rows = df.select(F.col(row_id).alias("row"), F.col(text).alias("text")).filter("text IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, t in zip(pdf["row"], pdf["text"]):
                for name, p in compiled.items():
                    n = 0
                    for m in reversed(list(p.finditer(t))) if backward else p.finditer(t):
                        if m.end() == m.start():
                            continue
                        out.append((row, name, n, m.start(), m.group(), t[max(0, m.start() - context) : m.end() + context]))
                        n += 1
                        if n >= hits:
                            break
            yield pd.DataFrame(out, columns=["row", "rule", "hit_no", "start", "found", "around"])

    return rows.mapInPandas(run, f"row {dict(rows.dtypes)['row']}, rule string, hit_no int, start int, found string, around string").withColumnRenamed("row", row_id)

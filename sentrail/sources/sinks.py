"""Writers: JSON lines, CSV, append-only audit log, exports, per-index batches, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line; non-ASCII text stays as it is, null fields are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", "true").csv(path)


def append_audit(df: DataFrame, path: str, ts: str) -> None:
    """Add rows to a log partitioned by UTC day; nothing written before is touched."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").json(path)


def export(df: DataFrame, path: str, columns: list[str] | None = None, zone: str | None = None, form: str = "json") -> None:
    """A column subset as JSON lines or CSV; timestamps shown in the given zone."""
    out = df.select(*(columns or df.columns))
    if zone:
        for name, kind in out.dtypes:
            if kind == "timestamp":
                out = out.withColumn(name, F.date_format(F.from_utc_timestamp(name, zone), "yyyy-MM-dd'T'HH:mm:ss"))
    writer = out.write.mode("overwrite")
    writer.option("header", "true").csv(path) if form == "csv" else writer.json(path)


def write_indexed(df: DataFrame, path: str, index: str, rows_per_file: int = 1_000_000) -> None:
    """Rows under one folder per index value; files of bounded size, so a hot index is many files."""
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy(index).json(path)


def with_sender(df: DataFrame, sender: str, trusted: bool = False) -> DataFrame:
    """Pushed rows carry their sender; only trusted ones may name another."""
    return df if trusted and "_sender" in df.columns else df.withColumn("_sender", F.lit(sender))


def append_series(df: DataFrame, path: str, name: str, key: str) -> None:
    """A named series of a timeline: rows with a time, ordered within their files."""
    df.filter(F.col(key).isNotNull()).withColumn("series", F.lit(name)).sortWithinPartitions(key).write.mode("append").parquet(path)

"""Readers of files: JSON lines, labelled sequence files, path lists, CSV, texts, archives, folder snapshots."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str, keep_broken: bool = False) -> DataFrame:
    """One object a line by a declared schema. Broken lines are dropped, or kept in column _broken."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    df = lines.select(F.from_json("value", f"{schema}, _broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r")).select("r.*")
    return df if keep_broken else df.filter("_broken IS NULL").drop("_broken")


def read_labelled(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """JSON files under one folder per label; the folder's name becomes column `label_dir`."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").json(root)
    return df.withColumn("label_dir", F.element_at(F.split(F.input_file_name(), "/"), -2))


def read_long_records(spark: SparkSession, root: str, text: str, least_chars: int = 50) -> DataFrame:
    """Lines that are JSON objects whose text has at least least_chars characters; others are skipped."""
    lines = spark.read.option("recursiveFileLookup", "true").text(root).filter("trim(value) <> ''")
    body = F.get_json_object("value", f"$.{text}")
    return lines.withColumn("text", body).filter(F.length("text") >= least_chars).select("value", "text")


def read_path_labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'path number' (the path may hold blanks) as path and label; other lines are skipped."""
    p = r"^(.*) (\d+)\s*$"
    return spark.read.text(path).filter(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 1).alias("path"), F.regexp_extract("value", p, 2).cast("int").alias("label"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; without a schema all columns are text."""
    r = spark.read.option("header", "true")
    return (r.schema(schema) if schema else r).csv(path)


def snapshot(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, name, size, modified of every file below root; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_texts(spark: SparkSession, root: str, glob: str = "*", least: int = 0) -> DataFrame:
    """path and whole text of files, bytes that are not UTF-8 replaced; of .docx and .xlsx files the text inside.

    A broken one of these gives an empty text.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [office_text(p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"])]})

    return df.select("path", "content").mapInPandas(decoded, "path string, text string").filter(F.length("text") >= least)


def office_text(path: str, raw: bytes) -> str:
    """Text of a file by its name: paragraphs of .docx, cells of .xlsx (a line a row), else the bytes as UTF-8."""
    kind = path.lower().rpartition(".")[2]
    if kind not in ("docx", "xlsx"):
        return raw.decode("utf-8", "replace")
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            texts = lambda node: "".join(x.text or "" for x in node.iter() if x.tag.endswith("}t"))
            if kind == "docx":
                return "\n".join(texts(p) for p in ElementTree.fromstring(z.read("word/document.xml")).iter() if p.tag.endswith("}p"))
            shared = [texts(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
            lines = []
            for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
                for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if r.tag.endswith("}row")):
                    value = lambda c: next((x.text or "" for x in c if x.tag.endswith("}v")), texts(c))
                    lines.append("\t".join(shared[int(value(c))] if c.get("t") == "s" else value(c) for c in row))
            return "\n".join(lines)
    except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError):
        return ""


def find_nocase(spark: SparkSession, root: str, path: str) -> DataFrame:
    """Files below root whose path ends in `path`, whatever the case."""
    return snapshot(spark, root).filter(F.lower("path").endswith("/" + path.lower().lstrip("/")))


def read_ranges(df: DataFrame, content: str, ranges: list[tuple[int | None, int]]) -> DataFrame:
    """Binary content put together from (offset, length) ranges, a length alone (offset None) being that many zero bytes."""
    parts = [F.unhex(F.lit("00" * n)) if at is None else F.substring(content, at + 1, n) for at, n in ranges]
    return df.withColumn(content, F.concat(*parts))


def read_zip_members(spark: SparkSession, root: str, most_bytes: int = 1 << 30) -> DataFrame:
    """path, member, content, note of all files in zip archives below root, archives in archives to any depth.

    member joins nested names by '!'. A broken archive gives one row with a null content and the note
    'broken'; a member that would take its file beyond most_bytes of unpacked content (a bomb) gives one with
    the note 'too large'. Archives are unpacked one member at a time, without recursion.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(root)

    def members(raw: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
        todo, left = [("", raw)], most_bytes
        while todo:
            prefix, body = todo.pop()
            try:
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        if info.file_size > left:
                            yield prefix + info.filename, None, "too large"
                            continue
                        content = z.read(info)
                        left -= len(content)
                        if info.filename.lower().endswith(".zip"):
                            todo.append((f"{prefix}{info.filename}!", content))
                        else:
                            yield prefix + info.filename, content, None
            except zipfile.BadZipFile:
                yield prefix.rstrip("!"), None, "broken"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                for member, body, note in members(bytes(raw)):
                    yield pd.DataFrame({"path": [path], "member": [member], "content": [body], "note": [note]})

    return df.select("path", "content").mapInPandas(run, "path string, member string, content binary, note string")


def documents_from(*parts: DataFrame) -> DataFrame:
    """Tables with text in `text`, `content` or `summary` as one table of text, level and origin; null texts and levels are dropped."""
    from sentrail.operators.relational import chain

    some = []
    for p in parts:
        texts = [F.col(c).cast("string") for c in ("text", "content", "summary") if c in p.columns]
        some.append(p.select(F.coalesce(*texts).alias("text"), F.col("level").cast("string").alias("level")))
    return chain(*some).filter("text IS NOT NULL AND level IS NOT NULL").withColumnRenamed("_part", "origin")


def merge_config(base: dict, *files: dict) -> dict:
    """Settings of several files over a base: a later key replaces an earlier one, tables are merged key by key."""
    out = dict(base)
    for f in files:
        for k, v in f.items():
            out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def unpack(df: DataFrame, content: str, layout: str, names: list[str], offset: int = 0) -> DataFrame:
    """Numbers at fixed places of binary content (layout as in Python's struct) as double or long columns.

    Null or too short content gives nulls.
    """
    size = struct.calcsize(layout)
    kinds = ["double" if c in "efd" else "long" for c in layout.lstrip("<>=!@") if c.isalpha() and c != "x"]
    @F.pandas_udf(f"struct<{', '.join(f'{n}: {k}' for n, k in zip(names, kinds))}>".replace(": long", ": bigint"))
    def read(raw: pd.Series) -> pd.DataFrame:
        rows = [struct.unpack_from(layout, r, offset) if r is not None and len(r) >= offset + size else (None,) * len(names) for r in raw]
        return pd.DataFrame(rows, columns=names).astype({n: "Int64" if k == "long" else "float64" for n, k in zip(names, kinds)})

    return df.withColumn("_u", read(content)).select(*df.columns, *[F.col(f"_u.{n}").alias(n) for n in names])

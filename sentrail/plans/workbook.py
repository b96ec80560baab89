"""Named, parameterised queries that build on each other: lazy and fixed tables, calls, text queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrail.session import cut


class Workbook:
    """Tables and queries by name.

    let(name, f): f(book, **args) is run at each use. fixed(name, f): run once per set of arguments and
    cut, so later uses read what was computed. query(text, **args): SQL in which {name} stands for a table
    of the book. call(name, **args) adds the name as column _source.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._lazy: dict[str, Callable[..., DataFrame]] = {}
        self._fixed: set[str] = set()
        self._done: dict[tuple, DataFrame] = {}

    def let(self, name: str, f: Callable[..., DataFrame]) -> Workbook:
        self._lazy[name] = f
        self._fixed.discard(name)
        return self

    def fixed(self, name: str, f: Callable[..., DataFrame]) -> Workbook:
        self.let(name, f)
        self._fixed.add(name)
        return self

    def use(self, name: str, **args: object) -> DataFrame:
        if name not in self._lazy:
            raise KeyError(f"no query {name}")
        if name not in self._fixed:
            return self._lazy[name](self, **args)
        key = (name, *sorted(args.items()))
        if key not in self._done:
            self._done[key] = cut(self._lazy[name](self, **args))
        return self._done[key]

    def call(self, name: str, **args: object) -> DataFrame:
        return self.use(name, **args).withColumn("_source", F.lit(name))

    def query(self, text: str, tables: dict[str, DataFrame] | None = None, **args: object) -> DataFrame:
        """SQL text with {table} placeholders and :name parameters; values are bound, never pasted."""
        named = {n: self.use(n) for n in self._lazy if "{" + n + "}" in text} | (tables or {})
        return self.spark.sql(text, args=args or None, **named)

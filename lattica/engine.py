"""The engine: statements over registered tables as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession

from lattica.errors import ValidationError
from lattica.operators.flatten import flatten
from lattica.operators.slices import Slice, apply_slice
from lattica.plans.lower import lower, wrapping
from lattica.plans.parser import parse
from lattica.plans.tree import Select, paths
from lattica.sources.catalog import Catalog
from lattica.streaming.control import Running, pages


class Engine:
    """Runs statements.

    ``exact_quantiles``: quantile and qvc with interpolation, at the cost of state that grows with the distinct values
    of a group; otherwise over rows by the values of the quantile's rank, at the cost of a second pass over the rows.
    ``sql_having``: HAVING before ORDER and LIMIT. ``may_read``: asked for each table that a statement names.
    """

    def __init__(self, spark: SparkSession, exact_quantiles: bool = False, sql_having: bool = False, may_read: Callable[[str], bool] | None = None, timeout: float = 600.0):
        self.spark, self.exact_quantiles, self.sql_having, self.timeout = spark, exact_quantiles, sql_having, timeout
        self.catalog = Catalog(spark, may_read)

    def plan(self, statement: str | Select) -> DataFrame:
        """The statement as a DataFrame; nothing runs."""
        tree = self._tree(statement)
        with wrapping(self.spark):
            df = self.catalog.source(tree.source, paths(tree))
        return self._lowered(df, tree)

    sql = plan

    def _tree(self, statement: str | Select) -> Select:
        tree = parse(statement) if isinstance(statement, str) else statement
        if tree.source is None:
            raise ValidationError("FROM is missing")
        return tree

    def _lowered(self, df: DataFrame, tree: Select) -> DataFrame:
        return lower(df, tree, self.exact_quantiles, self.sql_having)

    def sliced(self, statement: str, table: str, s: Slice) -> DataFrame:
        return self.plan(apply_slice(statement, table, s))

    def pages(self, statement: str | Select, size: int = 1000) -> Iterator[list[Row]]:
        """The rows of a statement in pages; the driver holds one partition of the result at a time."""
        return pages(self.plan(statement), size)

    def submit(self, statement: str | Select, timeout: float | None = None, on_update: Callable[[list[Row], float], None] | None = None, path: str | None = None) -> Running:
        """Run a statement in the background.

        ``on_update`` gets partial results: the rows of the statement over the first part of the table, the first two,
        four and so on, each with the share of the parts; together they cost no more than the whole once again.
        ``path``: where the rows are written instead of being handed over.
        """
        tree, before = self._tree(statement), []
        if on_update is not None:
            parts = self.catalog.prefixes(tree.source.table)
            total = self.catalog.part_count(tree.source.table)
            for k, df in enumerate(parts):
                with wrapping(self.spark):
                    df = flatten(df, tree.source.flatten) if tree.source.flatten else df
                before.append((2**k / total, self._lowered(df, tree)))
        return Running(self.spark, self.plan(tree), timeout or self.timeout, before=before, on_update=on_update, path=path)

    def prepare_flatten(self, table: str, field: str) -> None:
        self.catalog.prepare_flatten(table, field)

"""The tables that statements can name."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from lattica.errors import AccessError, ValidationError
from lattica.operators.flatten import flatten, pruned
from lattica.plans.parser import parse
from lattica.plans.tree import STRING, Path, Source
from lattica.sources import ingest
from lattica.sources.metadata import merge_schemas, table_fields
from lattica.sources.schema import Field


class Catalog:
    """Registered tables, their flattened forms, and who may read them."""

    def __init__(self, spark: SparkSession, may_read: Callable[[str], bool] | None = None, flat_mb: float = 4096.0):
        self.spark, self.may_read, self.flat_mb = spark, may_read, flat_mb
        self._parts: dict[str, list[DataFrame]] = {}
        self._flat: dict[tuple[str, str], DataFrame] = {}
        #: The files that a part is read from as they are, by the part.
        self._files: dict[int, tuple[DataFrame, str | Sequence[str]]] = {}

    def register(self, name: str, df: DataFrame) -> None:
        """Make ``df`` the table ``name``. Fields must have value types, or be structs or arrays of such."""
        table_fields(df.schema)
        self.drop(name, missing_ok=True)
        self._parts[name] = [df]

    def add(self, name: str, df: DataFrame) -> None:
        """Add rows to a table. All parts of a table must agree on the type of a field."""
        merge_schemas([*(p.schema for p in self._parts.get(name, [])), df.schema])
        self._forget_flat(name)
        self._parts.setdefault(name, []).append(df)

    def load(self, name: str, kind: str, path: str | Sequence[str], types: Mapping[str, str] | None = None, default_type: str = STRING) -> None:
        df = ingest.read(self.spark, kind, path, types, default_type)
        self.add(name, df)
        if kind == "parquet" and not types:
            self._files[id(df)] = df, path

    def remove_part(self, name: str, df: DataFrame) -> None:
        self._parts[name] = [p for p in self._parts[name] if p is not df]
        self._files.pop(id(df), None)
        self._forget_flat(name)
        if not self._parts[name]:
            del self._parts[name]

    def drop(self, name: str, missing_ok: bool = False) -> None:
        if name not in self._parts and not missing_ok:
            raise ValidationError(f"there is no table {name}")
        self._forget_flat(name)
        for p in self._parts.pop(name, []):
            self._files.pop(id(p), None)

    def _forget_flat(self, name: str) -> None:
        for key in [k for k in self._flat if k[0] == name]:
            self._flat.pop(key).unpersist()

    def tables(self) -> list[str]:
        return sorted(self._parts)

    def table(self, name: str) -> DataFrame:
        if name not in self._parts:
            raise ValidationError(f"there is no table {name}")
        if self.may_read is not None and not self.may_read(name):
            raise AccessError(f"no access to table {name}")
        parts = self._parts[name]
        return parts[0] if len(parts) == 1 else ingest.united(parts)

    def part_count(self, name: str) -> int:
        return len(self._parts[name])

    def prefixes(self, name: str) -> list[DataFrame]:
        """The table's first part, first two, four and so on, short of all of them."""
        self.table(name)
        parts, out, n = self._parts[name], [], 1
        while n < len(parts):
            out.append(parts[0] if n == 1 else ingest.united(parts[:n]))
            n *= 2
        return out

    def fields(self, name: str) -> list[Field]:
        return table_fields(self.table(name).schema)

    def _reduced(self, name: str, wanted: list[list[str]]) -> DataFrame:
        """The table of which only the wanted fields are read, at any depth, where its parts are Parquet files.

        Catalyst cuts nested fields through one explode only; a schema given to the reader cuts them all.
        """
        parts = []
        for p in self._parts[name]:
            known = self._files.get(id(p))
            parts.append(self.spark.read.schema(pruned(p.schema, wanted)).parquet(*([known[1]] if isinstance(known[1], str) else known[1])) if known else p)
        return parts[0] if len(parts) == 1 else ingest.united(parts)

    def source(self, source: Source, wanted: list[Path] | None = None) -> DataFrame:
        """The rows of a source; ``wanted``: the paths that are read of it."""
        df = self.table(source.table)
        if source.flatten is None:
            return df
        key = (source.table, str(source.flatten))
        if key not in self._flat:
            flat = flatten(df, source.flatten)
            if wanted is None or not any(id(p) in self._files for p in self._parts[source.table]):
                return flat
            names = [[name for name, _ in p.steps] for p in [*wanted, source.flatten]]
            return flatten(self._reduced(source.table, names), source.flatten)
        self._flat[key] = found = self._flat.pop(key)  # the last used comes last
        return found

    def prepare_flatten(self, name: str, field: str) -> None:
        """Keep the flattened table, in memory and then on disk, for later statements.

        Those used longest ago make room when the tables kept are estimated at over ``flat_mb``; a table that is
        estimated at more by itself is not kept, and is flattened anew by each statement.
        """
        path = parse(f"select x from flatten({name}, {field})").source.flatten
        assert isinstance(path, Path)
        key = (name, str(path))
        if key in self._flat:
            return
        df = flatten(self.table(name), path)
        if self.flat_mb <= 0 or self._estimated_mb(df) > self.flat_mb:
            return
        while self._flat and sum(map(self._estimated_mb, self._flat.values())) + self._estimated_mb(df) > self.flat_mb:
            self._flat.pop(next(iter(self._flat))).unpersist()
        self._flat[key] = df.persist(StorageLevel.MEMORY_AND_DISK)

    def _estimated_mb(self, df: DataFrame) -> float:
        """Spark's own estimate; a quarter of what there is where it has none."""
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 2**20
        return size if size < 2**40 else self.flat_mb / 4

"""A folder of Parquet tables with keys.

A table is the folder ``<name>.parquet``, Hive-partitioned where its metadata say so. Keys,
alternate keys, partitioning and any other attributes are in a JSON file beside its
data, and what is on disk wins over what a writer brings. All file work goes through
Hadoop's file systems, so a store may lie on any of them.

No plan overwrites what it reads: rewritten tables and partitions are staged and moved.
"""

from __future__ import annotations

import functools
import json
import uuid
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from .folders import settle_at

_SIDECAR = "_attributes.json"


class KeyConflict(ValueError):
    """Rows that a table's keys don't allow together."""


class ReadOnly(PermissionError):
    """A write to a store that was opened for reading."""


def concat(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The rows of several Parquet tables, columns by name; null where a table lacks one."""
    if not paths:
        raise ValueError("no paths")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (spark.read.parquet(p) for p in paths))


class ParquetStore:
    #: Files have so many rows at most (0: any number).
    rows_per_file = 0

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        at = self._fs_path(self.path)
        self._fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if self._fs.exists(at) and self._fs.getFileStatus(at).isFile():
            raise FileExistsError(f"{path} is a file")
        if not self._fs.exists(at):
            if read_only:
                raise FileNotFoundError(path)
            self._fs.mkdirs(at)

    # files

    def table_path(self, name: str) -> str:
        return f"{self.path}/{name}.parquet"

    def _at(self, path: str):
        return self._fs_path(path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(self.table_path(name)))

    def list_tables(self) -> list[str]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at(self.path)))
        return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))

    def _move(self, source: str, target: str) -> None:
        """Renames a folder; OSError where the file system says that it didn't."""
        self._fs.mkdirs(self._at(target).getParent())
        if not self._fs.rename(self._at(source), self._at(target)):
            raise OSError(f"{source} can't be moved to {target}")

    def _swap(self, moves: Sequence[tuple[str | None, str]]) -> None:
        """Puts staged folders (None: nothing) to where others may be. If one can't be moved, all are put
        back as they were; only then, or when all are in place, do old ones go."""
        away = f"{self.path}/.old-{uuid.uuid4().hex[:12]}"
        done: list[tuple[str, str]] = []
        try:
            for i, (staged, target) in enumerate(moves):
                if self._fs.exists(self._at(target)):
                    self._move(target, f"{away}/{i}")
                    done.append((target, f"{away}/{i}"))
                if staged is not None:
                    self._move(staged, target)
                    done.append((staged, target))
        except BaseException:
            for source, target in reversed(done):
                self._move(target, source)
            self._fs.delete(self._at(away), True)
            raise
        self._fs.delete(self._at(away), True)

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(self.table_path(name)), True)

    # attributes

    def metadata(self, name: str) -> dict[str, object]:
        """The table's attributes; an empty dict if it has none."""
        at = self._at(f"{self.table_path(name)}/{_SIDECAR}")
        if not self._fs.exists(at):
            return {}
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put_metadata(self, folder: str, attributes: dict[str, object]) -> None:
        stream = self._fs.create(self._at(f"{folder}/{_SIDECAR}"), True)
        try:
            stream.write(bytearray(json.dumps(attributes).encode()))
        finally:
            stream.close()

    def _merged_metadata(self, name: str, given: dict[str, object], df: DataFrame) -> dict[str, object]:
        plain = {}
        for k, v in given.items():
            if isinstance(v, (str, int, float, bool, type(None))) or (isinstance(v, (list, tuple)) and all(isinstance(x, (str, int, float, bool)) for x in v)):
                plain[k] = list(v) if isinstance(v, tuple) else v
            else:
                warnings.warn(f"attribute {k} of {name} isn't atomic and isn't kept", stacklevel=4)
        held = self.metadata(name) if self.exists(name) else {}
        for k in held.keys() & plain.keys():
            if held[k] != plain[k]:
                warnings.warn(f"attribute {k} of {name} is {held[k]} on disk, which wins over {plain[k]}", stacklevel=4)
        out = plain | held
        for k in ("keys", "alternate", "partitions", "maps"):
            unknown = set(out.get(k) or []) - set(df.columns)
            if unknown and not held:
                raise ValueError(f"{name} has no columns {sorted(unknown)} for its {k}")
        return out

    # reading

    def read(self, name: str) -> DataFrame:
        """The whole table; partition columns have the types they were written with."""
        if not self.exists(name):
            raise KeyError(f"no table {name}")
        schema = self.metadata(name).get("schema")
        reader = self.spark.read
        if schema:
            reader = reader.schema(T.StructType.fromJson(json.loads(schema)))
        return reader.parquet(self.table_path(name))

    def fetch(self, name: str, cols: Sequence[str] | None = None, where: str | None = None, limit: int | None = None, in_order: bool = False) -> DataFrame:
        """Columns by name, filtered, limited; ``in_order``: of its keys, for presentation (by all columns if it has none)."""
        return self._fetched(self.read(name), name, cols, where, limit, in_order)

    def _fetched(self, df: DataFrame, name: str, cols: Sequence[str] | None, where: str | None, limit: int | None, in_order: bool) -> DataFrame:
        if where is not None:
            df = df.where(where)
        if in_order:
            df = df.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in self.metadata(name).get("keys") or df.columns])
        if cols is not None:
            df = df.select(*[F.col(f"`{c}`") for c in cols])
        return df if limit is None else df.limit(limit)

    def rows(self, name: str, **fetched) -> list[dict[str, object]]:
        """What :meth:`fetch` gives, as dictionaries; the values of map columns in the types that their strings stand for."""
        maps = set(self.metadata(name).get("maps") or [])
        return [{k: scalar.typed_map(v) if k in maps else v for k, v in r.asDict().items()} for r in self.fetch(name, **fetched).collect()]

    def row_count(self, name: str) -> int:
        return self.read(name).count() if self.exists(name) else 0

    def column_max(self, name: str, column: str):
        """The largest value, 0 of an absent or empty table."""
        found = self.read(name).agg(F.max(column)).first()[0] if self.exists(name) else None
        return 0 if found is None else found

    def register_views(self) -> None:
        for name in self.list_tables():
            self.read(name).createOrReplaceTempView(name)

    def query(self, sql: str) -> DataFrame:
        """Any SQL over the tables by their names."""
        self.register_views()
        return self.spark.sql(sql)

    # writing

    def _writable(self, allowed: bool = False) -> None:
        if self.read_only and not allowed:
            raise ReadOnly(f"{self.path} was opened for reading")

    def _frame(self, x: DataFrame | str, maps: Sequence[str] = ()) -> DataFrame:
        """A frame or the view of that name; columns that are to be maps as maps of strings, whatever holds their pairs."""
        df = self.spark.table(x) if isinstance(x, str) else x
        return df.withColumns({c: scalar.string_map(F.col(c), df.schema[c].dataType) for c in maps if c in df.columns})

    def _write(self, df: DataFrame, folder: str, attributes: dict[str, object], mode: str = "error") -> None:
        w = df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", self.rows_per_file)
        if attributes.get("partitions"):
            w = w.partitionBy(*attributes["partitions"])
        w.parquet(folder)

    def _check_unique(self, df: DataFrame, name: str, attributes: dict[str, object]) -> None:
        for k in ("keys", "alternate"):
            cols = attributes.get(k)
            if cols and df.groupBy(*cols).count().filter("count > 1").limit(1).count():
                raise KeyConflict(f"{name}: duplicate {cols}")

    def commit(self, x: DataFrame | str, name: str, method: str = "overwrite", *, quiet: bool = False, settled: bool = False, **attributes) -> int:
        """Writes rows; how many the table (overwrite), the addition (append) or the touched
        partitions (upsert) then have.

        Attributes: ``keys``, ``alternate``, ``partitions``, ``maps``, and any atomic values.
        A first write is an overwrite; an upsert without keys is an append. Rows are computed once: an
        upsert, which reads them several times, settles them first, unless they are ``settled``.
        """
        held = self.metadata(name) if self.exists(name) else {}
        df = self._frame(x, held.get("maps") or attributes.get("maps") or ())
        if method not in ("overwrite", "append", "upsert"):
            raise ValueError(f"unknown method {method}")
        exists = self.exists(name)
        attributes = self._merged_metadata(name, attributes, df)
        keys = [*attributes.get("keys", []), *attributes.get("alternate", [])]
        parts = attributes.get("partitions") or []
        if not exists:
            method = "overwrite"
        elif method == "upsert" and not keys:
            method = "append"
        self._writable(method == "append" and bool(parts))
        if method == "append" and keys and not quiet:
            warnings.warn(f"{name} has keys, which an append doesn't check", stacklevel=2)
        if method == "overwrite":
            return self._overwrite(df, name, attributes)
        if method == "append":
            return self._append(df, name, attributes)
        return (self._merge if settled else self._upsert)(df, name, attributes, keys, parts)

    def _overwrite(self, df: DataFrame, name: str, attributes: dict[str, object]) -> int:
        staged = f"{self.path}/.staged-{uuid.uuid4().hex[:12]}"
        parts = attributes.get("partitions") or []
        order = [c for c in df.columns if c not in parts] + list(parts)
        attributes = attributes | {"schema": df.select(*order).schema.json()}
        try:
            self._write(df, staged, attributes)
            self._put_metadata(staged, attributes)
            self._swap([(staged, self.table_path(name))])
        finally:
            self._fs.delete(self._at(staged), True)
        return self.row_count(name)

    def _aligned(self, df: DataFrame, name: str) -> tuple[DataFrame, T.StructType]:
        """``df`` with the table's columns in its types, nulls where it has none, and its own extra ones."""
        held = self.read(name).schema
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in held]
        extra = [f for f in df.schema if f.name not in held.names]
        return df.select(*cols, *[f.name for f in extra]), T.StructType([*held, *extra])

    def _append(self, df: DataFrame, name: str, attributes: dict[str, object]) -> int:
        df, schema = self._aligned(df, name)
        df = df.select(*schema.names)
        staged = f"{self.path}/.staged-{uuid.uuid4().hex[:12]}"
        try:  # staged first, as the rows may come from the table itself
            self._write(df, staged, {})
            rows = self.spark.read.schema(df.schema).parquet(staged)
            n = rows.count()
            self._write(rows, self.table_path(name), attributes, "append")
        finally:
            self._fs.delete(self._at(staged), True)
        self._put_metadata(self.table_path(name), attributes | {"schema": schema.json()})
        return n

    def _upsert(self, new: DataFrame, name: str, attributes: dict[str, object], keys: list[str], parts: list[str]) -> int:
        new, settled = settle_at(new, "upsert")
        try:
            return self._merge(new, name, attributes, keys, parts)
        finally:
            self._fs.delete(self._at(settled), True)

    def _merge(self, new: DataFrame, name: str, attributes: dict[str, object], keys: list[str], parts: list[str]) -> int:
        missing = [k for k in keys if k not in new.columns]
        if missing:
            raise ValueError(f"rows for {name} lack the keys {missing}")
        old = self.read(name)
        given = set(new.columns)
        filled, schema = self._aligned(new, name)
        if parts:
            old = old.join(F.broadcast(filled.select(*parts).distinct()), parts, "left_semi")
        kept = [c for c in old.columns if c not in given]
        if kept:  # matched rows keep what the new rows don't bring
            back = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in kept])
            filled = filled.join(back, keys, "left").select(*[F.col(f"_old_{c}").alias(c) if c in kept else F.col(c) for c in schema.names])
        merged = old.join(new.select(*keys), keys, "left_anti").unionByName(filled, allowMissingColumns=True).select(*schema.names)
        staged = f"{self.path}/.staged-{uuid.uuid4().hex[:12]}"
        try:
            self._write(merged, staged, attributes)
            result = self.spark.read.schema(schema).parquet(staged)
            self._check_unique(result, name, attributes)
            n = result.count()
            if parts:
                others = self.read(name).join(F.broadcast(result.select(*parts).distinct()), parts, "left_anti")
                alt = attributes.get("alternate")
                if alt and others.join(result.select(*alt), alt, "left_semi").limit(1).count():
                    raise KeyConflict(f"{name}: duplicate {alt}")
                self._swap([(f"{staged}/{leaf}", f"{self.table_path(name)}/{leaf}") for leaf in self._leaves(staged, len(parts))])
            else:
                self._put_metadata(staged, attributes)
                self._swap([(staged, self.table_path(name))])
        finally:
            self._fs.delete(self._at(staged), True)
        self._put_metadata(self.table_path(name), attributes | {"schema": schema.json()})
        return n

    def _leaves(self, folder: str, depth: int, at: str = "") -> list[str]:
        """The partitions of a written table, by their paths."""
        if not depth:
            return [at]
        below = (s.getPath().getName() for s in self._fs.listStatus(self._at(f"{folder}/{at}" if at else folder)) if s.isDirectory())
        return [x for n in below for x in self._leaves(folder, depth - 1, f"{at}/{n}" if at else n)]

    def delete_from(self, name: str, where: str | None = None) -> int:
        """Removes rows, or without ``where`` the table; how many. A row whose condition is null goes as well.
        Of a partitioned table only the partitions that lose rows are rewritten."""
        self._writable()
        if not self.exists(name):
            return 0
        if where is None:
            before = self.row_count(name)
            self.drop(name)
            return before
        attributes, goes = self.metadata(name), ~F.coalesce(F.expr(f"not ({where})"), F.lit(False))
        parts = attributes.get("partitions") or []
        df = self.read(name)
        lost = df.where(goes).groupBy(*parts).agg(F.count("*").alias("n"), F.lit(1).alias("some")).collect()
        n = sum(r["n"] for r in lost)
        if not n:
            return 0
        if not parts:
            self._overwrite(df.where(~goes), name, {k: v for k, v in attributes.items() if k != "schema"})
            return n
        touched = self.spark.createDataFrame([tuple(r[p] for p in parts) for r in lost], T.StructType([df.schema[p] for p in parts]))
        same = functools.reduce(Column.__and__, [df[p].eqNullSafe(touched[p]) for p in parts])
        staged = f"{self.path}/.staged-{uuid.uuid4().hex[:12]}"
        path_of = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        try:
            self._write(df.join(F.broadcast(touched), same, "left_semi").where(~goes), staged, attributes)
            kept = set(self._leaves(staged, len(parts)))
            text = touched.select(*[F.col(p).cast("string") for p in parts]).collect()
            leaves = ["/".join(path_of(p, r[p]) for p in parts) for r in text]
            self._swap([(f"{staged}/{leaf}" if leaf in kept else None, f"{self.table_path(name)}/{leaf}") for leaf in leaves])
        finally:
            self._fs.delete(self._at(staged), True)
        return n

"""Facts about rows, brought to where the rows are read: no text shuffles.

A row is named by where it is stored: ``_key``, a hash of its file and of its block of BLOCK
rows, and ``_at``, its index in the file. Unlike numbers that follow the partitions of a
scan, these stay when executors are lost and the scan is cut otherwise. What isn't a plain scan
of Parquet files is written to the shared folder first.

Facts (``_key``, ``_at`` and any columns, a row for each row at most) are written in buckets by
``_key``, sorted; a task that comes to a block reads what its bucket holds of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import anonymous, qualified, scratch, stash

BLOCK = 1 << 17
#: Row groups are small, so that a block's rows are read without those of others.
GROUP_BYTES = 1 << 20


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only selects from one Parquet table."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.getClass().getSimpleName() == "LogicalRelation" and node.relation().getClass().getSimpleName() == "HadoopFsRelation" and node.relation().fileFormat().toString() == "Parquet"


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with anonymous columns, ``_key`` and ``_at``."""
    d = anonymous(docs)
    if not _is_scan(d):
        d, _ = stash(d, "located")
    at = F.col("_metadata.row_index")
    return d.select("*", F.xxhash64("_metadata.file_path", F.floor(at / BLOCK)).alias("_key"), at.alias("_at"))


def part_files(spark: SparkSession, path: str) -> dict[int, str]:
    """The files of a table by the partition that wrote them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    names = [s.getPath().getName() for s in listed]
    return {int(n.split("-")[1]): f"{qualified(spark, path)}/{n}" for n in names if n.startswith("part-")}


@dataclass
class Facts:
    """A written table of facts."""

    files: dict[int, str]
    buckets: int

    def bucket(self) -> Column:
        return F.pmod(F.hash("_key"), F.lit(self.buckets))

    def reader(self) -> Reader:
        return Reader(self.files)


class Reader:
    """Finds facts in a task; keeps the block that it is in."""

    def __init__(self, files: dict[int, str]):
        self._files, self._held = files, None

    def _block(self, key: int, bucket: int) -> pa.Table | None:
        if self._held is None or self._held[0] != key:
            table = None
            if bucket in self._files:
                system, path = fs.FileSystem.from_uri(self._files[bucket])
                table = pq.read_table(path, filesystem=system, filters=[("_key", "=", key)])
            self._held = key, table if table is not None and table.num_rows else None
        return self._held[1]

    def find(self, key: np.ndarray, bucket: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Table]]:
        """Block by block: the rows that have facts, and these, in the same order."""
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
        for i, j in zip(cuts, [*cuts[1:], len(key)]):
            table = self._block(int(key[i]), int(bucket[i]))
            if table is not None:
                held = table["_at"].to_numpy()
                where = np.minimum(np.searchsorted(held, at[i:j]), len(held) - 1)
                has = np.flatnonzero(held[where] == at[i:j])
                if len(has):
                    yield has + i, table.take(pa.array(where[has]))


def facts(df: DataFrame, name: str) -> Facts:
    """Writes ``df`` (_key, _at, ...) to the shared folder, in as many buckets as a shuffle has partitions."""
    spark = df.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch(spark, name)
    df.repartition(n, "_key").sortWithinPartitions("_key", "_at").write.option("parquet.block.size", GROUP_BYTES).option("maxRecordsPerFile", 0).parquet(path)
    return Facts(part_files(spark, path), n)


def told(found: Facts, returns: str, each: Callable[..., pd.Series | pd.DataFrame], *columns: str) -> Column:
    """A column made by ``each(has, table, n, *columns)`` for batches of n located rows: ``has`` are those
    with facts, ``table`` the facts in the same order (None if there are none)."""

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        reader = found.reader()
        for key, bucket, at, *rest in parts:
            held = list(reader.find(key.to_numpy(), bucket.to_numpy(), at.to_numpy()))
            has = np.concatenate([h for h, _ in held]) if held else np.empty(0, dtype=np.int64)
            yield each(has, pa.concat_tables([t for _, t in held]) if held else None, len(key), *rest)

    return F.pandas_udf(run, returns).asNondeterministic()("_key", found.bucket(), "_at", *columns)

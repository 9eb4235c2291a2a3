"""Folders for tables that all executors must reach."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Only where it is unset and all is on one machine a temporary
    folder, recorded in the session; on a cluster its executors couldn't reach it: RuntimeError."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="landweave-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system; a missing one is fine."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle_at(df: DataFrame, name: str = "settled") -> tuple[DataFrame, str]:
    """Written to the shared folder and read again, and where; the folder goes when Python exits, if not before."""
    spark, path = df.sparkSession, fresh_folder(df.sparkSession, name)
    df.write.parquet(path)

    def tidy() -> None:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass

    atexit.register(tidy)
    return spark.read.schema(df.schema).parquet(path), path


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage of loops."""
    return settle_at(df, name)[0]

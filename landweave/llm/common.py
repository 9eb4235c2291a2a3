"""Shared plumbing of the training-data operators.

Every operator reads the columns it needs by exact name (:func:`pick`), so extra
columns, also such that differ from ours only in case, never get in the way, and
keeps temporary tables in the folder that all executors share (:func:`stash`).
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables as Parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where the session names none and all is on one machine (tests), a temporary folder is
    made and recorded in the session; on a cluster its executors couldn't reach it: RuntimeError.
    """
    named = spark.conf.get(_CONF, None)
    if not named:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            named = made.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            named = "file://" + tempfile.mkdtemp(prefix="landweave-")
        else:
            raise RuntimeError(f"{_CONF} must name a folder that all executors share")
        spark.conf.set(_CONF, named)
    return named.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI that other libraries read as well: a path without a scheme lies in Hadoop's default file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system; a missing one is fine."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under :func:`shared_dir`, deleted when Python exits."""
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"

    def tidy() -> None:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass

    atexit.register(tidy)
    return path


def stash(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    Cuts lineage: what is read afterwards survives the loss of any executor.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of ARROW_BYTES at most, unless the session says otherwise: a batch is held
    several times over, in the JVM outside its heap and in Python, by every task."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(ARROW_BYTES))


def anonymous(df: DataFrame) -> DataFrame:
    """``df`` with its columns renamed by position: ``_in0``, ``_in1``, ... Every operator begins here."""
    bounded_batches(df.sparkSession)
    return df.toDF(*[f"_in{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """The anonymous name of the column that is called exactly ``name``."""
    return f"_in{df.columns.index(name)}"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns of exactly these names; ambiguous neighbours do no harm."""
    plain = anonymous(df)
    return plain.select(*[F.col(place(df, n)).alias(n) for n in names])

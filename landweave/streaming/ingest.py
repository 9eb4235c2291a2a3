"""An extension: observations that arrive as a stream are upserted batch by batch.

Each batch goes through the keyed upsert, so a batch that is delivered again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.database import LandDatabase
from ..schemas import TABLES


def ingest(db: LandDatabase, stream: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upserts a stream into a table; of rows of one key in a batch that with the largest ``seq`` (if there is
    such a column) stays."""
    keys = list(TABLES[table].keys)

    def upsert(batch: DataFrame, _: int) -> None:
        if "seq" in batch.columns:
            w = Window.partitionBy(*keys).orderBy(F.col("seq").desc())
            batch = batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "seq")
        else:
            batch = batch.dropDuplicates(keys)
        db.put(table, batch)

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Transition potentials: calibration to target rates, model choice, prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import score_of


def adjusted_potentials(potentials: DataFrame, rates: DataFrame, id_period_post: int) -> DataFrame:
    """Potentials of one period scaled to their rates: each transition's mean becomes its rate, then
    a cell whose sum exceeds 1 is scaled down to 1. Potentials without a rate vanish."""
    p = potentials.where(F.col("id_period_post") == id_period_post)
    r = rates.where(F.col("id_period") == id_period_post).select("id_trans", "rate")
    # Transitions are few and have a row for every cell: their means come from a combining aggregation
    # and go to the rows by broadcast, as a window would bring all cells of a transition to one task.
    means = p.groupBy("id_trans").agg(F.avg("value").alias("mean")).join(r, "id_trans")
    scaled = p.join(F.broadcast(means), "id_trans").withColumn("value", F.when(F.col("mean") > 0, F.col("value") * F.col("rate") / F.col("mean")).otherwise(0.0))
    total = F.sum("value").over(Window.partitionBy("id_coord"))
    return scaled.withColumn("total", total).select("id_trans", "id_period_post", "id_coord", F.when(F.col("total") > 1, F.col("value") / F.col("total")).otherwise(F.col("value")).alias("value"))


def best_models(models: DataFrame, score: str, maximize: bool = True, numeric: bool = True) -> DataFrame:
    """Per run and transition the model with the best score; a missing score is last, ties go to the
    smaller learner_id. ``numeric=False`` compares the strings as they are stored."""
    s = score_of(F.col("crossval_score"), score, numeric)
    order = s.desc_nulls_last() if maximize else s.asc_nulls_last()
    w = Window.partitionBy("id_run", "id_trans").orderBy(order, "learner_id")
    return models.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, group: str, by: str, k: int, tie: str) -> DataFrame:
    """The k rows of each group with the largest ``by``."""
    w = Window.partitionBy(group).orderBy(F.col(by).desc_nulls_last(), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def missing_models(trans_meta: DataFrame, models: DataFrame) -> DataFrame:
    """Viable transitions without a model."""
    return trans_meta.where("is_viable").select("id_trans").join(models.select("id_trans").distinct(), "id_trans", "left_anti")

"""Transitions between land-use classes: detection, metadata, observed and extrapolated rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import TABLES


def transitions(lulc: DataFrame) -> DataFrame:
    """Each cell's class in two consecutive periods, changed or not. A cell that lacks a period is in no
    pair with it, which a lag over the cell's rows would not see."""
    prev = lulc.select("id_coord", (F.col("id_period") + 1).alias("id_period"), F.col("id_lulc").alias("id_lulc_anterior"))
    curr = lulc.select("id_coord", "id_period", F.col("id_lulc").alias("id_lulc_posterior"))
    return curr.join(prev, ["id_coord", "id_period"]).select("id_coord", "id_period", "id_lulc_anterior", "id_lulc_posterior")


def transition_meta(trans: DataFrame, min_cardinality_abs: int | None = None, min_frequency_rel: float | None = None, exclude_anterior: Sequence[int] = (), exclude_posterior: Sequence[int] = ()) -> DataFrame:
    """How often each change happens, relative to all changes and to all pairs, and whether it is viable.

    With both thresholds a change is viable that meets either. Ids follow the order of
    (anterior, posterior).
    """
    pairs = trans.groupBy("id_lulc_anterior", "id_lulc_posterior").agg(F.count("*").alias("cardinality"))
    pairs = pairs.withColumn("all_pairs", F.sum("cardinality").over(Window.partitionBy()))
    changes = pairs.where("id_lulc_anterior <> id_lulc_posterior")
    n = F.col("cardinality").cast("double")
    low = F.lit(False)
    tests = []
    if min_cardinality_abs is not None:
        tests.append(F.col("cardinality") < min_cardinality_abs)
    if min_frequency_rel is not None:
        tests.append(F.col("frequency_rel") < min_frequency_rel)
    if tests:
        low = tests[0] if len(tests) == 1 else tests[0] & tests[1]
    if exclude_anterior:
        low = low | F.col("id_lulc_anterior").isin(list(exclude_anterior))
    if exclude_posterior:
        low = low | F.col("id_lulc_posterior").isin(list(exclude_posterior))
    out = changes.withColumn("frequency_rel", n / F.sum("cardinality").over(Window.partitionBy())).withColumn("frequency_abs", n / F.col("all_pairs"))
    out = out.withColumn("id_trans", F.row_number().over(Window.orderBy("id_lulc_anterior", "id_lulc_posterior"))).withColumn("is_viable", ~low)
    return TABLES["trans_meta_t"].cast(out.drop("all_pairs"))


def observed_rates(trans: DataFrame, meta: DataFrame, id_run: int) -> DataFrame:
    """Per period the share of an anterior class, unchanged cells included, that takes each listed transition."""
    if id_run is None:
        raise ValueError("observed rates need a run")
    n = trans.groupBy("id_period", "id_lulc_anterior", "id_lulc_posterior").agg(F.count("*").alias("count"))
    n = n.withColumn("total", F.sum("count").over(Window.partitionBy("id_period", "id_lulc_anterior")))
    ids = F.broadcast(meta.select("id_trans", "id_lulc_anterior", "id_lulc_posterior"))
    out = n.join(ids, ["id_lulc_anterior", "id_lulc_posterior"])
    return TABLES["trans_rates_t"].cast(out.select(F.lit(id_run).alias("id_run"), "id_period", "id_trans", "count", (F.col("count").cast("double") / F.col("total")).alias("rate")))


def extrapolate_rates(observed: DataFrame, periods: DataFrame, coord_count: int) -> DataFrame:
    """The linear trend of each transition's rates at the extrapolated periods, not below 0; a single
    observation stays as it is. Counts are rounded half to even."""
    y, x = F.col("rate").cast("double"), F.col("id_period").cast("double")
    fit = observed.groupBy("id_run", "id_trans").agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.avg(y).alias("m"))
    future = periods.where("is_extrapolated and id_period > 0").select("id_period")
    rate = F.greatest(F.lit(0.0), F.coalesce(F.col("a"), F.col("m")) + F.coalesce(F.col("b"), F.lit(0.0)) * F.col("id_period"))
    out = fit.crossJoin(F.broadcast(future)).select("id_run", "id_period", "id_trans", rate.alias("rate"))
    return TABLES["trans_rates_t"].cast(out.withColumn("count", F.rint(F.col("rate") * coord_count)))


def rates_for_export(rates: DataFrame, meta: DataFrame, id_period: int) -> DataFrame:
    """Viable transitions of a period under the names that the external allocator reads."""
    viable = meta.where("is_viable").select("id_trans", "id_lulc_anterior", "id_lulc_posterior")
    return rates.where(F.col("id_period") == id_period).join(F.broadcast(viable), "id_trans").select(F.col("id_lulc_anterior").alias("From*"), F.col("id_lulc_posterior").alias("To*"), F.col("rate").alias("Rate"))


def full_transition_predictors(pred_meta: DataFrame, trans_meta: DataFrame, id_run: int = 0) -> DataFrame:
    """Every predictor for every viable transition."""
    pairs = pred_meta.select("id_pred").crossJoin(F.broadcast(trans_meta.where("is_viable").select("id_trans")))
    return TABLES["trans_preds_t"].cast(pairs.withColumn("id_run", F.lit(id_run)))


def recode(samples: DataFrame, lulc_meta: DataFrame, column: str = "src_class") -> DataFrame:
    """Source classes to land-use classes."""
    long = lulc_meta.select("id_lulc", F.explode("src_classes").alias(column))
    return samples.join(F.broadcast(long), column)


def predictors_by_transition(trans_preds: DataFrame) -> DataFrame:
    """(id_trans, id_preds): each transition's predictors in order."""
    return trans_preds.select("id_trans", "id_pred").distinct().groupBy("id_trans").agg(F.sort_array(F.collect_list("id_pred")).alias("id_preds"))

"""Design matrices: long predictor values to wide rows for training and for inference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.transitions import transitions


def wide(values: DataFrame, id_preds: Sequence[int], *keys: str) -> DataFrame:
    """One column id_pred_<n> for each of ``id_preds``, null where a key has no value."""
    return values.groupBy(*keys).pivot("id_pred", list(id_preds)).agg(F.first("value")).select(*keys, *[F.col(f"`{i}`").alias(f"id_pred_{i}") for i in id_preds])


def typed_predictors(df: DataFrame, meta: list[dict], ordered: bool = False) -> DataFrame:
    """Predictor columns in their types: numbers, booleans, levels of factors by 1-based code (the
    codes themselves with ``ordered``); nulls become the fill value."""
    out = {}
    for m in meta:
        name = f"id_pred_{m['id_pred']}"
        if name not in df.columns:
            continue
        c, kind, fill = F.col(name), m["data_type"], m["fill_value"]
        if kind in ("factor", "ordered") and not ordered:
            levels = F.array(*[F.lit(x) for x in m["factor_levels"] or []]).cast("array<string>")
            c = F.try_element_at(levels, F.when(c >= 1, c.cast("int")))
            filled = F.lit(fill)
        else:
            as_type = {"int": "int", "bool": "boolean", "factor": "int", "ordered": "int"}.get(kind, "double")
            c = c.cast(as_type)
            filled = F.lit(fill).try_cast(as_type)
        out[name] = F.coalesce(c, filled) if fill is not None else c
    return df.withColumns(out)


def observed_before_last(periods: DataFrame) -> DataFrame:
    """The observed periods but the last."""
    seen = periods.where("not is_extrapolated")
    return seen.withColumn("next", F.lead("id_period").over(Window.orderBy("id_period"))).where("next is not null").select("id_period")


def static_by_period(pred_data: DataFrame, periods: DataFrame) -> DataFrame:
    """(id_period, id_coord, id_pred, value): static values in every observed period but the last."""
    every = observed_before_last(periods).where("id_period >= 1")
    return pred_data.where("id_period = 0").select("id_coord", "id_pred", "value").crossJoin(F.broadcast(every)).select("id_period", "id_coord", "id_pred", "value")


def long_predictors(pred_data: DataFrame, periods: DataFrame) -> DataFrame:
    """(id_period, id_coord, id_pred, value): dynamic values, and static ones in every observed period but the last."""
    return pred_data.where("id_period > 0").select("id_period", "id_coord", "id_pred", "value").unionByName(static_by_period(pred_data, periods))


def values_of_cells(pred_data: DataFrame, cells: DataFrame, *periods: int) -> DataFrame:
    """The values that ``cells`` (id_coord) have in the given periods."""
    return pred_data.where(F.col("id_period").isin(*periods)).join(cells.select("id_coord"), "id_coord", "left_semi")


def training_matrices(lulc: DataFrame, pred_data: DataFrame, periods: DataFrame, trans: DataFrame, id_preds: Sequence[int]) -> DataFrame:
    """Of every transition in ``trans`` (id_trans, id_lulc_anterior, id_lulc_posterior; a row a pair of classes): the
    cells of its anterior class by observed period, whether each takes it into the next period, and
    the predictors: dynamic ones of that period, static ones (period 0) in every one.

    One plan for all: lulc and predictors are read once, static values are pivoted once by cell, and only
    those of cells that some transition can take.
    """
    trans = F.broadcast(trans.select("id_trans", "id_lulc_anterior", F.col("id_lulc_posterior").alias("target")))
    pairs = transitions(lulc).withColumn("id_period", F.col("id_period") - 1).join(F.broadcast(observed_before_last(periods)), "id_period", "left_semi")
    labels = pairs.join(trans, "id_lulc_anterior").select("id_trans", "id_coord", "id_period", (F.col("id_lulc_posterior") == F.col("target")).alias("did_transition"))
    wanted = pred_data.where(F.col("id_pred").isin(list(id_preds))).join(labels.select("id_coord").distinct(), "id_coord", "left_semi")
    static = wide(wanted.where("id_period = 0"), id_preds, "id_coord")
    dynamic = wide(wanted.where("id_period > 0"), id_preds, "id_coord", "id_period")
    names = [f"id_pred_{i}" for i in id_preds]
    d = labels.join(static, "id_coord", "left").join(dynamic.select("id_coord", "id_period", *[F.col(n).alias(f"_{n}") for n in names]), ["id_coord", "id_period"], "left")
    return d.select("id_trans", "id_coord", "id_period", "did_transition", *[F.coalesce(f"_{n}", n).alias(n) for n in names])


def training_matrix(lulc: DataFrame, pred_data: DataFrame, periods: DataFrame, anterior: int, posterior: int, id_preds: Sequence[int]) -> DataFrame:
    """The training matrix of one transition."""
    return training_matrices(lulc, pred_data, periods, _one(lulc, anterior, posterior), id_preds).drop("id_trans")


def _one(like: DataFrame, anterior: int, posterior: int) -> DataFrame:
    return like.sparkSession.createDataFrame([(0, anterior, posterior)], "id_trans int, id_lulc_anterior int, id_lulc_posterior int")


def inference_matrices(lulc: DataFrame, pred_data: DataFrame, trans: DataFrame, preds: Mapping[int, Sequence[int]], id_period_anterior: int) -> DataFrame:
    """Of every transition the cells of its anterior class in a period, with their predictors of that period, or
    static ones; ``preds`` are the predictors by id_trans. Cells without any of a transition's predictors
    vanish from it; a dynamic value is preferred to a static one."""
    id_preds = sorted({i for own in preds.values() for i in own})
    cells = lulc.where(F.col("id_period") == id_period_anterior).join(F.broadcast(trans.select("id_trans", F.col("id_lulc_anterior").alias("id_lulc"))), "id_lulc").select("id_trans", "id_coord")
    values = values_of_cells(pred_data.where(F.col("id_pred").isin(id_preds)), cells, 0, id_period_anterior)
    values = values.groupBy("id_coord", "id_pred").agg(F.max_by("value", "id_period").alias("value"))
    d = cells.join(wide(values, id_preds, "id_coord"), "id_coord").select("id_trans", "id_coord", *[f"id_pred_{i}" for i in id_preds])
    some = F.lit(False)
    for t, own in preds.items():
        if own:
            some = some | ((F.col("id_trans") == t) & F.coalesce(*[f"id_pred_{i}" for i in own]).isNotNull())
    return d.where(some)


def inference_matrix(lulc: DataFrame, pred_data: DataFrame, anterior: int, id_preds: Sequence[int], id_period_anterior: int) -> DataFrame:
    """The inference matrix of one transition."""
    return inference_matrices(lulc, pred_data, _one(lulc, anterior, anterior), {0: list(id_preds)}, id_period_anterior).drop("id_trans")

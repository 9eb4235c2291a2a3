"""Pairs of points within a distance, and predictors that count neighbours by class.

A raw distance predicate would compare all pairs. Points are put in squares of the
maximal distance, one side is copied to the nine squares around its own, and an
equi-join on the square leaves only the distance filter. The sides are sorted and merged: the size
of compressed points would let Spark broadcast millions of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import concat_skipping_nulls, cut
from ..schemas import TABLES

BREAKS = (0.0, 100.0, 500.0, 1000.0)


def neighbor_pairs(coords: DataFrame, max_distance: float, breaks: Sequence[float] | None = None) -> DataFrame:
    """Both directions of every pair of different points at most ``max_distance`` apart, with the
    distance and its class (left-closed intervals, the last one closed)."""
    if max_distance <= 0:
        raise ValueError("max_distance must be positive")
    square = lambda c: F.floor(F.col(c) / F.lit(float(max_distance)))
    a = coords.select(F.col("id_coord").alias("id_coord_origin"), F.col("lon").alias("x"), F.col("lat").alias("y"), square("lon").alias("gx"), square("lat").alias("gy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = coords.select(F.col("id_coord").alias("id_coord_neighbor"), F.col("lon").alias("x2"), F.col("lat").alias("y2"), square("lon").alias("gx"), square("lat").alias("gy"), around.alias("d"))
    b = b.select("id_coord_neighbor", "x2", "y2", (F.col("gx") + F.col("d.i")).alias("gx"), (F.col("gy") + F.col("d.j")).alias("gy"))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    pairs = a.hint("merge").join(b.hint("merge"), ["gx", "gy"]).where((F.col("id_coord_origin") != F.col("id_coord_neighbor")) & (dx * dx + dy * dy <= F.lit(float(max_distance) ** 2)))
    distance = F.sqrt(dx * dx + dy * dy)
    return TABLES["neighbors_t"].cast(pairs.select("id_coord_origin", "id_coord_neighbor", distance.alias("distance"), (cut(distance, list(map(float, breaks))) if breaks else F.lit(None)).alias("distance_class")))


def predictor_meta(lulc_meta: DataFrame, neighbors: DataFrame, first_id: int) -> DataFrame:
    """A predictor for each class and each distance class that occurs, numbered from ``first_id``."""
    classes = neighbors.where("distance_class is not null").select("distance_class").distinct()
    grid = lulc_meta.select("id_lulc", F.col("name").alias("lulc_name")).crossJoin(F.broadcast(classes))
    out = grid.select(
        (F.row_number().over(Window.orderBy("id_lulc", "distance_class")) + (first_id - 1)).alias("id_pred"),
        concat_skipping_nulls(F.lit("id_lulc_"), F.col("id_lulc").cast("string"), F.lit("_dist_"), "distance_class").alias("name"),
        concat_skipping_nulls(F.lit("Neighbours of class "), "lulc_name", F.lit(" at "), "distance_class").alias("pretty_name"),
        F.lit("Number of neighbours of a class within a distance class").alias("description"), F.lit(None).alias("orig_format"), F.lit(None).alias("sources"),
        F.lit("count").alias("unit"), F.lit(None).alias("factor_levels"), F.lit("int").alias("data_type"), F.lit("0").alias("fill_value"),
    )
    return TABLES["pred_meta_t"].cast(out)


def parse_predictor_names(pred_meta: DataFrame) -> DataFrame:
    """(id_pred, id_lulc, distance_class) of the neighbour predictors, read off their names."""
    name = F.col("name")
    found = pred_meta.where(name.like("id\\_lulc\\_%\\_dist\\_%"))
    return found.select("id_pred", F.regexp_extract(name, r"^id_lulc_(\d+)_dist_(.+)$", 1).try_cast("int").alias("id_lulc"), F.regexp_extract(name, r"^id_lulc_(\d+)_dist_(.+)$", 2).alias("distance_class"))


def neighbor_counts(neighbors: DataFrame, lulc: DataFrame, predictors: DataFrame, id_run: int) -> DataFrame:
    """How many neighbours of each class at each distance a cell has in each period, as predictor
    values. A cell without any has no row: the predictor's fill value stands for it."""
    seen = neighbors.select(F.col("id_coord_origin").alias("origin"), F.col("id_coord_neighbor").alias("id_coord"), "distance_class")
    n = seen.join(lulc.select("id_coord", "id_period", "id_lulc"), "id_coord").groupBy("origin", "id_period", "id_lulc", "distance_class").agg(F.count("*").alias("value"))
    out = n.join(F.broadcast(predictors.select("id_pred", "id_lulc", "distance_class")), ["id_lulc", "distance_class"])
    return TABLES["pred_data_t"].cast(out.select(F.lit(id_run).alias("id_run"), "id_period", "id_pred", F.col("origin").alias("id_coord"), "value"))

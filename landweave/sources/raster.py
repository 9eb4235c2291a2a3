"""Rasters and polygons against points, without a spatial library.

A raster is a table (row, col, layer, value) with an origin and a resolution; a polygon is a
table (id, attributes, ring) whose ring is a list of points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell_of(lon: Column, lat: Column, xmin: float, ymax: float, resolution: float) -> tuple[Column, Column]:
    """Row and column, from 0 at the top left, of the cell that holds a point."""
    return F.floor((F.lit(float(ymax)) - lat) / resolution).cast("int"), F.floor((lon - F.lit(float(xmin))) / resolution).cast("int")


def extract_raster(raster: DataFrame, coords: DataFrame, xmin: float, ymax: float, resolution: float, na_omit: bool = True) -> DataFrame:
    """(id_coord, layer, value) of every point and layer: an equi-join on the cell."""
    row, col = cell_of(F.col("lon"), F.col("lat"), xmin, ymax, resolution)
    points = coords.select("id_coord", row.alias("row"), col.alias("col"))
    if na_omit:
        return points.join(raster.where("value is not null"), ["row", "col"]).select("id_coord", "layer", "value")
    layers = raster.select("layer").distinct()
    return points.crossJoin(F.broadcast(layers)).join(raster, ["row", "col", "layer"], "left").select("id_coord", "layer", "value")


def _inside(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting over the ring's edges: inside if a ray to the right crosses an odd number of them."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, F.when(i == n, F.lit(1)).otherwise(i + 1)).alias("b")))

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.when(by != ay, by - ay) + ax)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def extract_polygons(polygons: DataFrame, coords: DataFrame, attributes: Sequence[str], square: float) -> DataFrame:
    """(id_coord, id, attribute, value) of every polygon that holds a point; where polygons overlap a
    point has rows of each. Points and the squares that a polygon's bounds touch are joined on squares."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    grid = lambda c: F.floor(c / square)
    spread = polygons.select("id", *attributes, "ring", F.explode(F.sequence(grid(F.array_min(xs)), grid(F.array_max(xs)))).alias("gx"), ys.alias("_y"))
    spread = spread.withColumn("gy", F.explode(F.sequence(grid(F.array_min("_y")), grid(F.array_max("_y")))))
    points = coords.select("id_coord", "lon", "lat", grid(F.col("lon")).alias("gx"), grid(F.col("lat")).alias("gy"))
    hit = points.join(spread, ["gx", "gy"]).where(_inside(F.col("lon"), F.col("lat"), F.col("ring")))
    return hit.select("id_coord", "id", *[F.col(a).cast("string").alias(a) for a in attributes]).unpivot(["id_coord", "id"], list(attributes), "attribute", "value")


def tabular_to_raster(data: DataFrame, coords: DataFrame, value: str, resolution: float | None = None) -> DataFrame:
    """(layer, row, col, value): the table's other columns name the layers, as column_value pairs joined by
    underscores. Without a resolution it is the smallest distance between neighbouring coordinates."""
    others = [c for c in data.columns if c not in ("id_coord", value)]
    name = F.concat_ws("_", *[F.concat_ws("_", F.lit(c), F.col(c).cast("string")) for c in others]) if others else F.lit(value)
    edge = coords.agg(F.min("lon"), F.max("lat")).first()
    if resolution is None:
        gap = lambda c: coords.select(c).distinct().select((F.lead(c).over(Window.orderBy(c)) - F.col(c)).alias("g")).agg(F.min("g")).first()[0]
        found = [g for g in (gap("lon"), gap("lat")) if g]
        if not found:
            raise ValueError("the resolution can't be told from one point")
        resolution = min(found)
    row, col = cell_of(F.col("lon"), F.col("lat"), edge[0] - resolution / 2, edge[1] + resolution / 2, resolution)
    return data.withColumn("layer", name).join(coords.select("id_coord", row.alias("row"), col.alias("col")), "id_coord").select("layer", "row", "col", F.col(value).alias("value"))

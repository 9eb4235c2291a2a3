"""Constructors of the base tables: grid, periods, and metadata from nested specifications."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import TABLES


def square_grid(spark: SparkSession, extent: tuple[float, float, float, float], resolution: float) -> DataFrame:
    """Cell centres of a grid over (xmin, xmax, ymin, ymax), ids from 1 row by row from the top left."""
    xmin, xmax, ymin, ymax = map(float, extent)
    if resolution <= 0 or xmax <= xmin or ymax <= ymin:
        raise ValueError("the extent and the resolution must be positive")
    cols, rows = round((xmax - xmin) / resolution), round((ymax - ymin) / resolution)
    i = F.col("id")
    out = spark.range(cols * rows).select(
        (i + 1).cast("int").alias("id_coord"),
        (F.lit(xmin) + (i % cols + 0.5) * resolution).alias("lon"),
        (F.lit(ymax) - (F.floor(i / cols) + 0.5) * resolution).alias("lat"),
    )
    return TABLES["coords_t"].cast(out.withColumn("elevation", F.lit(None)).withColumn("geom_polygon", F.lit(None)))


def _years(length: str) -> int:
    found = re.fullmatch(r"P(\d+)Y", length)
    if not found:
        raise ValueError(f"{length!r} isn't a duration in years such as P10Y")
    return int(found[1])


def periods(spark: SparkSession, length: str, start_observed: str, end_observed: str, end_extrapolated: str) -> DataFrame:
    """Consecutive periods from 1, the last ending at ``end_extrapolated``, and the static period 0."""
    years = _years(length)
    starts = spark.sql(f"select posexplode(sequence(date'{start_observed}', date'{end_extrapolated}', interval {years} year)) as (i, start_date)")
    w = Window.orderBy("i")
    end = F.coalesce(F.date_sub(F.lead("start_date").over(w), 1), F.lit(end_extrapolated).cast("date"))
    out = starts.select((F.col("i") + 1).alias("id_period"), "start_date", end.alias("end_date"), (F.col("start_date") > F.lit(end_observed).cast("date")).alias("is_extrapolated"))
    static = spark.sql(f"select 0 as id_period, date'{end_observed}' as start_date, date'{end_observed}' as end_date, false as is_extrapolated")
    return TABLES["periods_t"].cast(static.unionByName(out))


def _rows(spark: SparkSession, table: str, rows: list[dict]) -> DataFrame:
    spec = TABLES[table]
    return spark.createDataFrame([tuple(r.get(n) for n, _ in spec.columns) for r in rows], spec.schema)


def lulc_meta(spark: SparkSession, spec: Mapping[str, Mapping]) -> DataFrame:
    """Classes in the order given, numbered from 1; the pretty name defaults to the name."""
    return _rows(spark, "lulc_meta_t", [{"id_lulc": i, "name": name, "pretty_name": s.get("pretty_name", name), "description": s.get("description"), "src_classes": [int(x) for x in s.get("src_classes", [])]} for i, (name, s) in enumerate(spec.items(), 1)])


def pred_meta(spark: SparkSession, spec: Mapping[str, Mapping]) -> DataFrame:
    """Predictors in the order given, numbered from 1."""
    rows = []
    for i, (name, s) in enumerate(spec.items(), 1):
        sources = [(x.get("url"), x.get("md5sum")) for x in s.get("sources") or []]
        fill = s.get("fill_value")
        rows.append(
            {k: s.get(k) for k in ("description", "orig_format", "unit", "data_type")}
            | {"id_pred": i, "name": name, "pretty_name": s.get("pretty_name", name), "sources": sources, "factor_levels": list(s["factor_levels"]) if s.get("factor_levels") else None, "fill_value": None if fill is None else str(fill)}
        )
    return TABLES["pred_meta_t"].validate(_rows(spark, "pred_meta_t", rows))


def intrv_meta(spark: SparkSession, spec: Mapping[str, Mapping], id_run: int = 0) -> DataFrame:
    """Interventions in the order given, numbered from 1."""
    rows = []
    for i, (name, s) in enumerate(spec.items(), 1):
        rows.append({
            "id_run": id_run, "id_intrv": i, "name": name, "pretty_name": s.get("pretty_name", name), "description": s.get("description"), "pre_allocation": bool(s.get("pre_allocation", True)),
            "id_period_list": [int(x) for x in s.get("id_period_list", [])], "id_trans_list": [int(x) for x in s.get("id_trans_list", [])],
            "sources": [(x.get("url"), x.get("md5sum")) for x in s.get("sources") or []], "params": {k: str(v) for k, v in (s.get("params") or {}).items()},
        })
    return _rows(spark, "intrv_meta_t", rows)


def infer_data_type(df: DataFrame, column: str = "value") -> str:
    """int, float, bool or factor, by the column's type."""
    kind = dict(df.dtypes)[column]
    return {"boolean": "bool", "string": "factor", "double": "float", "float": "float"}.get(kind, "int")


def check_periods(wanted: Sequence[int], known: Sequence[int]) -> list[int]:
    """Periods to simulate: integers, known, without gaps."""
    out = sorted(int(p) for p in wanted if not isinstance(p, str))
    if len(out) != len(wanted) or not out:
        raise ValueError("id_periods must be numbers")
    if out != list(range(out[0], out[-1] + 1)):
        raise ValueError("id_periods must be contiguous")
    if set(out) - set(known):
        raise ValueError(f"unknown periods {sorted(set(out) - set(known))}")
    return out


def unnest(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """A row for each element of a list column; fields of structs become columns. Rows of null or empty lists vanish."""
    out = df.select(*keep, F.explode(column).alias("_e"))
    nested = dict(out.dtypes)["_e"].startswith("struct")
    return out.select(*keep, "_e.*") if nested else out.withColumnRenamed("_e", column.removesuffix("es") if column.endswith("classes") else column)


def today() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S UTC")


def extent(coords: DataFrame) -> DataFrame:
    """The box that holds all coordinates."""
    return coords.agg(F.min("lon").alias("xmin"), F.max("lon").alias("xmax"), F.min("lat").alias("ymin"), F.max("lat").alias("ymax"))


def coords_minimal(coords: DataFrame) -> DataFrame:
    return coords.select("id_coord", "lon", "lat")

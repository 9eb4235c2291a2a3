"""Run lineage: a run sees its own rows and those of the runs it descends from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lineage(runs: DataFrame, id_run: int) -> list[int]:
    """The run, its parent, and so on to the root. The table of runs is small by nature: one row a scenario."""
    parents = {r["id_run"]: r["parent_id_run"] for r in runs.select("id_run", "parent_id_run").collect()}
    out: list[int] = []
    at = id_run
    while at is not None:
        if at not in parents:
            raise ValueError(f"run {at} isn't known")
        if at in out:
            raise ValueError(f"run {at} descends from itself")
        out.append(at)
        at = parents[at]
    return out


def orphans(runs: DataFrame) -> DataFrame:
    """(id_run, parent_id_run) of the runs whose parent isn't among ``runs``."""
    known = runs.select(F.col("id_run").alias("parent_id_run"))
    return runs.where("parent_id_run is not null").join(known, "parent_id_run", "left_anti").select("id_run", "parent_id_run")


def lineages(runs: DataFrame) -> DataFrame:
    """(origin, id_run, distance) of every run: itself at 0, its parent at 1, and so on."""
    return runs.sparkSession.sql(
        "with recursive l(origin, id_run, distance) as (select id_run, id_run, 0 from {runs} union all select l.origin, r.parent_id_run, l.distance + 1 from l join {runs} r on r.id_run = l.id_run where r.parent_id_run is not null) select cast(origin as int) origin, cast(id_run as int) id_run, cast(distance as int) distance from l",
        runs=runs,
    )


def validate_runs(runs: DataFrame) -> DataFrame:
    """Ids unique, a base run 0, every parent known."""
    if runs.groupBy("id_run").count().where("count > 1").limit(1).count():
        raise ValueError("duplicate id_run")
    if not runs.where("id_run = 0").limit(1).count():
        raise ValueError("base run 0 is missing")
    lost = sorted(r["id_run"] for r in orphans(runs).collect())
    if lost:
        raise ValueError(f"runs {lost} have unknown parents")
    return runs


def distance(line: list[int]):
    """How many generations away the run of a row is, from 1."""
    return F.array_position(F.array(*[F.lit(i) for i in line]), F.col("id_run"))


def closest_runs(df: DataFrame, line: list[int], *slices: str) -> DataFrame:
    """(slices, id_run): of each slice the closest run of the line that has any row of it."""
    seen = df.where(F.col("id_run").isin(line)).select(*slices, "id_run").distinct()
    return seen.groupBy(*slices).agg(F.min_by("id_run", distance(line)).alias("id_run"))


def visible(df: DataFrame, line: list[int] | None, shadow: bool = False) -> DataFrame:
    """The rows of ``df`` that the run ``line[0]`` sees.

    Of tables with id_period the closest run that has any row of a slice (id_period, and
    id_pred if there is one) hides that slice of all others. Other tables show the rows of
    all runs of the line, unless ``shadow`` asks for the closest run of each key.
    """
    if line is None or "id_run" not in df.columns:
        return df
    if len(line) == 1:
        return df.where(F.col("id_run") == line[0])
    seen = df.where(F.col("id_run").isin(line))
    if "id_period" in df.columns:
        slices = [c for c in ("id_period", "id_pred") if c in df.columns]
    elif shadow:
        slices = [c for c in ("id_trans", "id_pred", "id_intrv", "learner_id", "id_coord") if c in df.columns]
    else:
        return seen
    return seen.join(closest_runs(seen, line, *slices), [*slices, "id_run"], "left_semi")


def predictor_presence(runs: DataFrame, periods: DataFrame, pred_meta: DataFrame, pred_data: DataFrame, id_run: int) -> DataFrame:
    """For each run of the lineage, period and predictor: are there rows for it (dynamic), or for
    period 0 (static), in that run; in any run of the line; and in any period."""
    spark = runs.sparkSession
    line = lineage(runs, id_run)
    ids = spark.createDataFrame([(i, d) for d, i in enumerate(line)], "id_run int, distance int")
    has = pred_data.where(F.col("id_run").isin(line)).select("id_run", "id_period", "id_pred").distinct().withColumn("has", F.lit(True))
    grid = periods.select("id_period").crossJoin(F.broadcast(ids)).crossJoin(F.broadcast(pred_meta.select("id_pred", "name")))
    static = has.where("id_period = 0").select("id_run", "id_pred", F.col("has").alias("static"))
    out = grid.join(has, ["id_run", "id_period", "id_pred"], "left").join(static, ["id_run", "id_pred"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    by_period, by_pred = Window.partitionBy("id_period", "id_pred"), Window.partitionBy("id_pred")
    return out.select(
        "id_run", "distance", "id_period", "id_pred", "name", yes("has").alias("has_dynamic"), yes("static").alias("has_static"),
        F.bool_or(yes("has")).over(by_period).alias("dynamic_in_line"), F.bool_or(yes("static")).over(by_period).alias("static_in_line"),
        F.bool_or(yes("has")).over(by_pred).alias("in_any_period"), F.bool_or(yes("has") | yes("static")).over(by_period).alias("available"),
    )

"""Patches of a class on a raster and the parameters of their allocation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import interpolate
from ..schemas import TABLES
from ..sources.folders import settle
from .graph import components

#: Elongation to isometry, ascending in elongation.
CURVE = [(0.17, 2.0), (0.171, 1.5), (0.172, 1.2), (0.32, 1.0), (0.328, 0.75), (0.333, 0.5), (0.334, 0.25), (0.34, 0.0)]
TILE = 1024
AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def elongation(n: Column, r: Column, c: Column, rr: Column, cc: Column, rc: Column) -> Column:
    """1 - sqrt(smaller / larger) of the eigenvalues of the second central moments, from a patch's count
    and its sums of row, column, row^2, column^2, row * column. One cell, or none in extent: 0."""
    srr, scc, src = rr / n - (r / n) * (r / n), cc / n - (c / n) * (c / n), rc / n - (r / n) * (c / n)
    mid, half = (srr + scc) / 2, F.sqrt(F.greatest(F.lit(0.0), (srr - scc) * (srr - scc) / 4 + src * src))
    low, high = F.greatest(F.lit(0.0), mid - half), mid + half
    return F.when((n <= 1) | (srr + scc <= 0) | (high <= 0), 0.0).otherwise(1 - F.sqrt(low / F.when(high > 0, high)))


def isometry(e: Column, clamp: bool = True) -> Column:
    """The patcher's isometry for an elongation."""
    return interpolate(e, CURVE, clamp)


def label_components(row: np.ndarray, col: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A number for each cell, the same for cells of one value that touch, also at corners: the index of
    the component's first cell. Labels sink along all edges at once and jump to their labels' labels."""
    n = len(row)
    label = np.arange(n, dtype=np.int64)
    if not n:
        return label
    width = int(col.max()) - int(col.min()) + 3
    key = (row.astype(np.int64) - int(row.min())) * width + (col.astype(np.int64) - int(col.min()) + 1)
    order = np.argsort(key, kind="stable")
    held = key[order]
    a, b = [], []
    for step in (1, width - 1, width, width + 1):  # right, and the three below
        at = np.minimum(np.searchsorted(held, key + step), n - 1)
        other = order[at]
        touch = (held[at] == key + step) & (value[other] == value)
        a.append(np.flatnonzero(touch))
        b.append(other[touch])
    a, b = np.concatenate(a), np.concatenate(b)
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, x[apart], low[apart])
        np.minimum.at(label, y[apart], low[apart])
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def patches(cells: DataFrame, *group: str, tile: int = TILE) -> DataFrame:
    """``cells`` (group columns, row, col, value) with the patch of each cell, a number that is the same for
    cells of one value that touch.

    Tiles are labelled in parallel; what touches across their borders are edges between tiles' patches,
    whose connected components join them. So a raster of any size is labelled without being in one task.
    """
    keys = list(group)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        first = label_components(pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["value"].to_numpy())
        row, col = pdf["row"].to_numpy(dtype=np.int64)[first], pdf["col"].to_numpy(dtype=np.int64)[first]
        return pdf.assign(first=row * (1 << 32) + col)

    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    d = cells.where("value is not null").select(*keys, F.col("row").cast("int"), F.col("col").cast("int"), F.col("value").cast("int"), at("row").alias("ti"), at("col").alias("tj"))
    schema = ", ".join(f"`{n}` {t}" for n, t in d.dtypes) + ", first long"
    d = settle(d.groupBy(*keys, "ti", "tj").applyInPandas(label, schema).withColumn("node", F.xxhash64(*keys, "first")), "labelled")
    inner = lambda c: F.pmod(F.col(c), F.lit(tile)).between(1, tile - 2)
    border = d.where(~(inner("row") & inner("col"))).select(*keys, "row", "col", "value", "ti", "tj", "node")
    ahead = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("d")
    near = border.select(*keys, "value", "row", "col", F.col("ti").alias("ti2"), F.col("tj").alias("tj2"), F.col("node").alias("a"), ahead)
    near = near.select(*keys, "value", (F.col("row") + F.col("d.i")).alias("row"), (F.col("col") + F.col("d.j")).alias("col"), "ti2", "tj2", "a")
    edges = border.join(near, [*keys, "value", "row", "col"]).where("ti <> ti2 or tj <> tj2").select("a", F.col("node").alias("b")).distinct()
    joined = components(edges)
    return d.join(joined, "node", "left").select(*keys, "row", "col", "value", F.coalesce("label", "node").alias("patch"))


def class_stats(labelled: DataFrame, *group: str, cell_size: float = 1.0) -> DataFrame:
    """Of each class: number of patches, mean and sample variance of their areas (null for one patch),
    mean elongation."""
    r, c = F.col("row").cast("double"), F.col("col").cast("double")
    per = labelled.groupBy(*group, "value", "patch").agg(F.count("*").cast("double").alias("n"), F.sum(r).alias("r"), F.sum(c).alias("c"), F.sum(r * r).alias("rr"), F.sum(c * c).alias("cc"), F.sum(r * c).alias("rc"))
    per = per.withColumn("area", F.col("n") * cell_size * cell_size).withColumn("e", elongation(*(F.col(x) for x in ("n", "r", "c", "rr", "cc", "rc"))))
    return per.groupBy(*group, "value").agg(F.count("*").cast("int").alias("patch_count"), F.avg("area").alias("patch_area_mean"), F.var_samp("area").alias("patch_area_variance"), F.avg("e").alias("patch_elongation_mean"))


def around(cells: DataFrame) -> DataFrame:
    """Every cell once for each of the nine cells of its 3 x 3 window: their places are r2 and c2. So a focal
    operation is an equi-join."""
    d = cells.withColumn("d", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND])))
    return d.withColumn("r2", F.col("row") + F.col("d.i")).withColumn("c2", F.col("col") + F.col("d.j")).drop("d")


def focal_sum(cells: DataFrame, value: str, *group: str) -> DataFrame:
    """(group, row, col, total, n): of each cell's 3 x 3 window, itself included, the sum of values and the number of cells
    that have one."""
    keys = list(group)
    held = cells.where(F.col(value).isNotNull()).select(*keys, F.col("row").alias("r2"), F.col("col").alias("c2"), F.col(value).alias("v"))
    near = around(cells.select(*keys, "row", "col")).join(held, [*keys, "r2", "c2"], "left")
    return near.groupBy(*keys, "row", "col").agg(F.sum("v").alias("total"), F.count("v").alias("n"))


def classify_all(maps: DataFrame, trans: DataFrame, *group: str) -> DataFrame:
    """The cells of ``maps`` (group, row, col, anterior, posterior) that take a transition of ``trans`` (id_trans,
    id_lulc_anterior, id_lulc_posterior; a row a pair of classes), each an expander (one of its eight neighbours
    already has the class), a patcher (none has) or, where all its neighbours take the transition
    themselves, neither. Only neighbours of such cells are looked up, for all transitions at once.
    """
    keys = list(group)
    ends = F.broadcast(trans.select("id_trans", F.col("id_lulc_anterior").alias("anterior"), F.col("id_lulc_posterior").alias("posterior")))
    taken = maps.join(ends, ["anterior", "posterior"]).select(*keys, "id_trans", "row", "col", F.col("anterior").alias("start"), F.col("posterior").alias("end"))
    held = maps.select(*keys, F.col("row").alias("r2"), F.col("col").alias("c2"), "anterior", "posterior")
    # A neighbour counts with whether it had the class; those that take the transition say nothing.
    same = F.coalesce((F.col("anterior") == F.col("start")) & (F.col("posterior") == F.col("end")), F.lit(False))
    had = F.when(~same, (F.col("anterior") == F.col("end")).cast("int"))
    found = around(taken).join(held, [*keys, "r2", "c2"], "left").groupBy(*keys, "id_trans", "row", "col").agg(F.sum(had).alias("near"))
    return found.select(*keys, "id_trans", "row", "col", F.when(F.col("near") >= 1, "expander").when(F.col("near") == 0, "patcher").alias("kind"))


def _one(like: DataFrame, from_class: int, to_class: int) -> DataFrame:
    return like.sparkSession.createDataFrame([(0, from_class, to_class)], "id_trans int, id_lulc_anterior int, id_lulc_posterior int")


def classify_cells(maps: DataFrame, from_class: int, to_class: int, *group: str) -> DataFrame:
    """The same of one transition."""
    return classify_all(maps, _one(maps, from_class, to_class), *group).drop("id_trans")


def alloc_params_all(maps: DataFrame, trans: DataFrame, *group: str) -> DataFrame:
    """Per group and transition the parameters; without any such cell sizes and fractions are 0."""
    keys = [*group, "id_trans"]
    kinds = classify_all(maps, trans, *group)
    shares = kinds.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("kind") == "expander").alias("e"), F.count_if(F.col("kind") == "patcher").alias("p"))
    stats = class_stats(patches(kinds.where("kind = 'patcher'").withColumn("value", F.lit(1)), *keys), *keys).drop("value", "patch_count")
    every = trans.select("id_trans")
    every = maps.select(*group).distinct().crossJoin(F.broadcast(every)) if group else every
    out = every.join(shares, keys, "left").join(stats, keys, "left")
    none = F.coalesce(F.col("n"), F.lit(0.0)) == 0
    zero = lambda c: F.when(none, 0.0).otherwise(c)
    return out.select(
        *keys, zero(F.col("patch_area_mean")).alias("mean_patch_size"), zero(F.col("patch_area_variance")).alias("patch_size_variance"), F.col("patch_elongation_mean").alias("patch_elongation"),
        zero(isometry(F.col("patch_elongation_mean"))).alias("patch_isometry"), zero(F.col("e") / F.col("n")).alias("frac_expander"), zero(F.col("p") / F.col("n")).alias("frac_patcher"),
    )


def alloc_params(maps: DataFrame, from_class: int, to_class: int, *group: str) -> DataFrame:
    """Per group the parameters of one transition."""
    return alloc_params_all(maps, _one(maps, from_class, to_class), *group).drop("id_trans")


def mean_params(params: DataFrame) -> DataFrame:
    """Means over periods of each transition's parameters; what is missing doesn't count."""
    cols = ["mean_patch_size", "patch_size_variance", "patch_elongation", "patch_isometry", "frac_expander", "frac_patcher"]
    return params.groupBy("id_trans").agg(*[F.avg(F.nanvl(F.col(c), F.lit(None))).alias(c) for c in cols])


def perturbed_params(means: DataFrame, n_perturbations: int = 5, sd: float = 0.05, seed: int = 1, run_ids: Sequence[int] | None = None) -> DataFrame:
    """Run 1 has the means, each further run a normal deviate on frac_expander, kept in [0, 1]."""
    ids = list(run_ids or range(1, n_perturbations + 2))
    if len(ids) < n_perturbations + 1:
        raise ValueError(f"{n_perturbations} perturbations need {n_perturbations + 1} runs")
    runs = means.sparkSession.createDataFrame([(i, k > 0) for k, i in enumerate(ids[: n_perturbations + 1])], "id_run int, moved boolean")
    # Box-Muller on hashes of (seed, run, transition): the same at any partitioning.
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id_run", "id_trans"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    deviate = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2)) * sd
    moved = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("frac_expander") + F.when(F.col("moved"), deviate).otherwise(0.0)))
    out = means.crossJoin(F.broadcast(runs)).withColumn("frac_expander", moved).withColumn("frac_patcher", F.when(F.col("moved"), 1 - F.col("frac_expander")).otherwise(F.col("frac_patcher")))
    return TABLES["alloc_params_t"].cast(out.withColumn("similarity", F.lit(None)).drop("moved"))


def export_params(params: DataFrame) -> DataFrame:
    """What the external allocator takes: fractions off the ends, gaps filled."""
    return params.withColumns({
        "frac_expander": F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("frac_expander"))),
        "mean_patch_size": F.coalesce("mean_patch_size", F.lit(1.0)), "patch_size_variance": F.coalesce("patch_size_variance", F.lit(0.0)), "patch_isometry": F.coalesce("patch_isometry", F.lit(1.0)),
    })


def patch_params(params: DataFrame) -> DataFrame:
    """The parameters under the names of the built-in allocator."""
    return params.select("id_run", "id_trans", F.col("mean_patch_size").alias("area_mean"), F.col("patch_size_variance").alias("area_var"), F.col("patch_elongation").alias("elongation"), "frac_expander", "frac_patcher")

"""Comparison of maps: change maps, fuzzy similarity in tiles, summaries of ensembles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256


def change_map(cells: DataFrame, from_class: int | None = None, to_class: int | None = None) -> DataFrame:
    """``cells`` (..., init, final) with ``change``: 1 where the given transition happened, or for no
    transition the final class where the class changed; null elsewhere."""
    if (from_class is None) != (to_class is None):
        raise ValueError("give both classes of a transition or neither")
    if from_class is not None:
        return cells.withColumn("change", F.when((F.col("init") == from_class) & (F.col("final") == to_class), 1))
    return cells.withColumn("change", F.when(F.col("init") != F.col("final"), F.col("final")))


def weights(window: int, decay: str = "exponential", divisor: float = 2.0) -> np.ndarray:
    """Weights of a square window by distance to its centre."""
    if window <= 0 or window % 2 == 0:
        raise ValueError("the window must be a positive odd number")
    h = window // 2
    d = np.hypot(*np.meshgrid(np.arange(-h, h + 1), np.arange(-h, h + 1)))
    return np.exp(-d / divisor) if decay == "exponential" else np.ones_like(d)


def _focal(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted sums over windows; x is padded by half a window."""
    n, k = x.shape, len(w)
    out = np.zeros((n[0] - k + 1, n[1] - k + 1))
    for i in range(k):
        for j in range(k):
            out += w[i, j] * x[i : i + out.shape[0], j : j + out.shape[1]]
    return out


def tile_similarity(a: np.ndarray, b: np.ndarray, w: np.ndarray, categories: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For padded maps (NaN: no class) the similarity of each inner cell as seen from a and from b."""
    h = len(w) // 2
    total = np.zeros((a.shape[0] - 2 * h, a.shape[1] - 2 * h))
    known = [_focal((~np.isnan(m)).astype(float), w) for m in (a, b)]
    full = w.sum()
    for cat in categories:
        fa, fb = (np.divide(_focal((m == cat).astype(float), w), k, out=np.zeros_like(k), where=k > 0) for m, k in zip((a, b), known))
        total += np.minimum(fa, fb)
    total[(known[0] < full - 1e-9) | (known[1] < full - 1e-9)] = np.nan  # a gap in the window leaves it open
    inner = slice(h, -h or None)
    return (np.where(np.isnan(m[inner, inner]), np.nan, total) for m in (a, b))


def similarity_cells(cells: DataFrame, n_rows: int, n_cols: int, *group: str, window: int = 11, decay: str = "exponential", divisor: float = 2.0, tile: int = TILE) -> DataFrame:
    """(group, row, col, sim_a, sim_b) of every cell of two maps: cells has group, row, col, a, b.

    The maps go through in tiles, each with a margin of half a window from its neighbours, so
    a map of any size is compared in parallel and little is copied. Beyond the edge the border goes on.
    """
    keys, h, w = list(group), window // 2, weights(window, decay, divisor)
    spots = F.array_distinct(F.array(*[F.struct(F.floor((F.col("row") + i) / tile).cast("int").alias("ti"), F.floor((F.col("col") + j) / tile).cast("int").alias("tj")) for i in (-h, 0, h) for j in (-h, 0, h)]))
    last = F.struct(F.lit((n_rows - 1) // tile).alias("ti"), F.lit((n_cols - 1) // tile).alias("tj"))
    spread = cells.select(*keys, "row", "col", F.col("a").cast("double"), F.col("b").cast("double"), F.explode(spots).alias("t")).where((F.col("t.ti") >= 0) & (F.col("t.tj") >= 0) & (F.col("t.ti") <= last["ti"]) & (F.col("t.tj") <= last["tj"]))
    spread = spread.select(*keys, "row", "col", "a", "b", "t.ti", "t.tj")
    cats = cells.select(F.explode(F.array("a", "b")).alias("c")).where("c is not null").distinct()
    categories = sorted(int(r[0]) for r in cats.collect())
    if not categories:
        raise ValueError("the maps have no categories")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["ti"].iloc[0]) * tile, int(pdf["tj"].iloc[0]) * tile
        r1, c1 = min(r0 + tile, n_rows), min(c0 + tile, n_cols)
        rows, cols = np.clip(np.arange(r0 - h, r1 + h), 0, n_rows - 1), np.clip(np.arange(c0 - h, c1 + h), 0, n_cols - 1)
        lo_r, lo_c = rows[0], cols[0]
        maps = []
        for m in ("a", "b"):
            x = np.full((rows[-1] - lo_r + 1, cols[-1] - lo_c + 1), np.nan)
            x[pdf["row"] - lo_r, pdf["col"] - lo_c] = pdf[m]
            maps.append(x[np.ix_(rows - lo_r, cols - lo_c)])
        sa, sb = tile_similarity(*maps, w, categories)
        own = pdf[(pdf["row"] >= r0) & (pdf["row"] < r1) & (pdf["col"] >= c0) & (pdf["col"] < c1)]
        at = own["row"] - r0, own["col"] - c0
        return own[[*keys, "row", "col"]].assign(sim_a=sa[at], sim_b=sb[at])

    kinds = dict(spread.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"row {kinds['row']}, col {kinds['col']}, sim_a double, sim_b double"])
    return spread.groupBy(*keys, "ti", "tj").applyInPandas(one, schema).withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in ("sim_a", "sim_b")})


def fuzzy_similarity(cells: DataFrame, n_rows: int, n_cols: int, *group: str, ignore_na: bool = True, **options) -> DataFrame:
    """Per group the mean similarity both ways and the smaller of the two. Cells without a similarity (no class, or a
    gap in the window) don't count; without ``ignore_na`` a mean over a map that has any is null."""
    sims = similarity_cells(cells, n_rows, n_cols, *group, **options)
    mean = lambda c: F.avg(c) if ignore_na else F.when(F.count(c) == n_rows * n_cols, F.avg(c))
    found = sims.groupBy(*group).agg(mean("sim_a").alias("mean_a"), mean("sim_b").alias("mean_b"))
    return found.withColumn("similarity", F.when(F.col("mean_a").isNotNull() & F.col("mean_b").isNotNull(), F.least("mean_a", "mean_b")))


def transition_similarities(cells: DataFrame, trans: DataFrame, n_rows: int, n_cols: int, *group: str, **options) -> DataFrame:
    """Of observed and simulated changes (cells: group, row, col, init, obs, sim), for every transition in ``trans``
    (id_trans, id_lulc_anterior, id_lulc_posterior; a row a pair of classes): the fuzzy similarity, and the
    numbers of cells; null where neither map has the change. All transitions are groups of one job."""
    keys = [*group, "id_trans"]
    d = cells.crossJoin(F.broadcast(trans.select("id_trans", "id_lulc_anterior", "id_lulc_posterior")))
    mask = lambda c: F.coalesce((F.col("init") == F.col("id_lulc_anterior")) & (F.col(c) == F.col("id_lulc_posterior")), F.lit(False)).cast("int")
    d = d.select(*keys, "row", "col", mask("obs").alias("a"), mask("sim").alias("b"))
    counts = d.groupBy(*keys).agg(F.sum("a").alias("n_observed"), F.sum("b").alias("n_simulated"))
    joined = counts.join(fuzzy_similarity(d, n_rows, n_cols, *keys, **options), keys)
    return joined.withColumn("similarity", F.when((F.col("n_observed") > 0) | (F.col("n_simulated") > 0), F.col("similarity")))


def transition_similarity(cells: DataFrame, from_class: int, to_class: int, n_rows: int, n_cols: int, *group: str, **options) -> DataFrame:
    """The same of one transition."""
    one = cells.sparkSession.createDataFrame([(0, from_class, to_class)], "id_trans int, id_lulc_anterior int, id_lulc_posterior int")
    return transition_similarities(cells, one, n_rows, n_cols, *group, **options).drop("id_trans")


def ensemble_summary(simulated: DataFrame, initial: DataFrame) -> DataFrame:
    """Per cell over all runs: how many changed it, the share, and the most frequent class (the lowest of
    equally frequent ones)."""
    n = simulated.groupBy("id_coord", "id_lulc").agg(F.count("*").alias("n"))
    mode = n.groupBy("id_coord").agg(F.max_by("id_lulc", F.struct("n", -F.col("id_lulc"))).alias("mode_lulc"), F.sum("n").alias("n_runs"))
    changed = simulated.join(initial.select("id_coord", F.col("id_lulc").alias("first_lulc")), "id_coord").groupBy("id_coord", "first_lulc").agg(F.count_if(F.col("id_lulc") != F.col("first_lulc")).alias("n_changed"))
    return mode.join(changed, "id_coord").select("id_coord", "first_lulc", "n_runs", "n_changed", (F.col("n_changed").cast("double") / F.col("n_runs")).alias("p_changed"), "mode_lulc")


def class_shares(cells: DataFrame, value: str = "id_lulc") -> DataFrame:
    """(value, n_cells, share) of a map's classes; the total is that of one row a class."""
    n = cells.groupBy(value).agg(F.count("*").alias("n_cells"))
    total = n.agg(F.sum("n_cells").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(value, "n_cells", (F.col("n_cells").cast("double") / F.col("total")).alias("share"))

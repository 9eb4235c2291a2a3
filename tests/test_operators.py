"""Known results of single operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from landweave.functions import scalar
from landweave.operators import allocate, build, models, neighbors, patches, potential, transitions, validate
from landweave.plans import design
from landweave.plans.lineage import lineage, validate_runs, visible
from landweave.sources.download import download_and_verify


def test_lineage(spark):
    runs = spark.createDataFrame([(0, None), (1, 0), (2, 1)], "id_run int, parent_id_run int")
    assert [lineage(runs, i) for i in (0, 1, 2)] == [[0], [1, 0], [2, 1, 0]]
    with pytest.raises(ValueError, match="999"):
        lineage(runs, 999)
    with pytest.raises(ValueError, match="unknown parents"):
        validate_runs(spark.createDataFrame([(0, None), (1, 7)], "id_run int, parent_id_run int"))


def test_a_run_with_one_row_hides_the_whole_slice(spark, rows):
    d = spark.createDataFrame([(0, 1, 1, 5), (0, 1, 2, 6), (1, 1, 1, 9), (0, 2, 1, 7)], "id_run int, id_period int, id_coord int, id_lulc int")
    assert rows(visible(d, [1, 0]), "id_run", "id_period", "id_coord") == [(0, 2, 1), (1, 1, 1)]


def test_neighbors_of_five_points(spark, rows):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 10.0), (3, 0.0, 20.0), (4, 100.0, 0.0), (5, 200.0, 0.0)], "id_coord int, lon double, lat double")
    assert rows(neighbors.neighbor_pairs(points, 15), "id_coord_origin", "id_coord_neighbor", "distance") == [(1, 2, 10.0), (2, 1, 10.0), (2, 3, 10.0), (3, 2, 10.0)]
    classed = neighbors.neighbor_pairs(points, 25, [0, 15, 30])
    assert classed.count() == 6 and classed.select("distance_class").distinct().count() == 2


def test_neighbors_are_symmetric_and_complete(spark):
    rng = np.random.default_rng(3)
    xy = rng.uniform(-50, 50, (80, 2))
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id_coord int, lon double, lat double")
    found = {(r[0], r[1]) for r in neighbors.neighbor_pairs(points, 13.0).collect()}
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    assert found == {(i, j) for i, j in zip(*np.nonzero(d <= 13.0)) if i != j}


def test_labels_and_cut(spark, rows):
    assert scalar.interval_labels([0, 100, 500, 1000]) == ["[0,100)", "[100,500)", "[500,1e+03]"]
    d = spark.createDataFrame([(0.0,), (100.0,), (1000.0,), (1000.1,)], "x double").select("x", scalar.cut(F.col("x"), [0.0, 100.0, 500.0, 1000.0]))
    assert [r[1] for r in rows(d)] == ["[0,100)", "[100,500)", "[500,1e+03]", None]


def test_extrapolation(spark):
    obs = spark.createDataFrame([(0, 1, 1, 0.1), (0, 2, 1, 0.2), (0, 1, 2, 0.3), (0, 2, 2, 0.2), (0, 2, 3, 0.4)], "id_run int, id_period int, id_trans int, rate double")
    periods = spark.createDataFrame([(0, False), (1, False), (2, False), (3, True), (4, True)], "id_period int, is_extrapolated boolean")
    found = {(r["id_trans"], r["id_period"]): r["rate"] for r in transitions.extrapolate_rates(obs, periods, 100).collect()}
    wanted = {(1, 3): 0.3, (1, 4): 0.4, (2, 3): 0.1, (2, 4): 0.0, (3, 3): 0.4, (3, 4): 0.4}
    assert found.keys() == wanted.keys() and all(abs(found[k] - v) < 1e-9 for k, v in wanted.items())
    assert transitions.extrapolate_rates(obs, periods.where("not is_extrapolated"), 100).count() == 0


def test_viability_needs_both_thresholds_failed(spark):
    t = spark.createDataFrame([(1, 1, 1, 2)] * 6 + [(1, 1, 2, 1)] * 2 + [(1, 1, 1, 1)] * 2, "id_coord int, id_period int, id_lulc_anterior int, id_lulc_posterior int")
    both = {(r[1], r[2]): r["is_viable"] for r in transitions.transition_meta(t, 3, 0.2).collect()}
    assert both == {(1, 2): True, (2, 1): True}
    assert not transitions.transition_meta(t, 3).where("id_lulc_anterior = 2").first()["is_viable"]
    assert transitions.transition_meta(t.where("false")).count() == 0


def test_isometry_is_clamped(spark):
    d = spark.createDataFrame([(0.0,), (0.25,), (1.0,)], "e double")
    assert [round(r[0], 4) for r in d.select(patches.isometry(F.col("e"))).collect()] == [2.0, round(1.2 + (0.25 - 0.172) * (1.0 - 1.2) / (0.32 - 0.172), 4), 0.0]
    assert [r[0] is None for r in d.select(patches.isometry(F.col("e"), clamp=False)).collect()] == [True, False, True]


def _maps(spark, ant, post):
    return spark.createDataFrame([(i, j, int(a), int(b)) for i, (ra, rb) in enumerate(zip(ant, post)) for j, (a, b) in enumerate(zip(ra, rb))], "row int, col int, anterior int, posterior int")


def test_alloc_params(spark):
    ant = np.ones((5, 10), dtype=int)
    ant[0, 0:3] = ant[2, 1] = 2
    post = ant.copy()
    post[1, 0:4] = post[3, 0:3] = post[2, 0] = 2  # 8 cells that touch the class
    post[4, 7:10] = 2  # a patch of its own
    r = patches.alloc_params(_maps(spark, ant, post), 1, 2).first()
    assert (r["mean_patch_size"], r["patch_size_variance"], r["patch_elongation"], r["patch_isometry"]) == (3.0, None, 1.0, 0.0)
    assert abs(r["frac_expander"] - 8 / 11) < 1e-12 and abs(r["frac_patcher"] - 3 / 11) < 1e-12
    none = patches.alloc_params(_maps(spark, ant, ant), 1, 2).first()
    assert none["mean_patch_size"] == 0 and none["frac_expander"] == 0 and none["patch_elongation"] is None


def test_components_against_flood_fill():
    rng = np.random.default_rng(8)
    value = rng.integers(1, 3, (30, 17))
    value[3:20, 5] = 1
    r, c = (x.ravel() for x in np.indices(value.shape))
    keep = rng.random(r.size) < 0.9  # with gaps
    r, c, v = r[keep] - 4, c[keep] + 9, value.ravel()[keep]
    got = patches.label_components(r, c, v)
    at, want = {p: i for i, p in enumerate(zip(r.tolist(), c.tolist()))}, {}
    for i in range(len(r)):
        if i in want:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in want:
                want[k] = i
                todo += [j for d in patches.AROUND if (j := at.get((r[k] + d[0], c[k] + d[1]))) is not None and v[j] == v[i]]
    assert got.tolist() == [want[i] for i in range(len(r))]


def test_tiles_do_not_matter_for_patches(spark):
    rng = np.random.default_rng(11)
    value = rng.integers(1, 3, (20, 23))
    value[2:18, 3], value[10, :] = 1, 1  # a patch through many tiles
    cells = spark.createDataFrame([(g, i, j, int(value[i, j])) for g in (0, 1) for i in range(20) for j in range(23)], "g int, row int, col int, value int")

    def parts(tile):
        found = {}
        for r in patches.patches(cells, "g", tile=tile).collect():
            found.setdefault(r["patch"], set()).add((r["g"], r["row"], r["col"]))
        return sorted(map(sorted, found.values()))

    assert parts(4) == parts(64)


def test_rook_neighbors():
    up, down, left, right = allocate.rook_neighbors(3, 4) + 1
    assert up.tolist() == [0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8] and left.tolist() == [0, 1, 2, 3, 0, 5, 6, 7, 0, 9, 10, 11]
    assert down.tolist() == [5, 6, 7, 8, 9, 10, 11, 12, 0, 0, 0, 0] and right.tolist() == [2, 3, 4, 0, 6, 7, 8, 0, 10, 11, 12, 0]


def test_patch_growth():
    land = allocate.Landscape(np.ones(16, dtype=np.int64), 4, 4)
    n, cells = land.grow(0, 4, 1, 2, np.full(16, 0.8), 0.5, False)
    assert n == 4 and [c + 1 for c in cells] == [1, 2, 5, 3]
    for avoid, wanted in ((False, [2, 2, 2, 2, 2]), (True, [2, 2, 1, 2, 2])):
        land = allocate.Landscape(np.ones(5, dtype=np.int64), 1, 5)
        assert land.grow(0, 2, 1, 2, np.ones(5), 1.0, avoid)[0] == 2
        land.grow(3, 2, 1, 2, np.array([0, 0, 0, 1.0, 0.9]), 1.0, avoid)
        if not avoid:
            land.grow(2, 2, 1, 2, np.ones(5), 1.0, avoid)
        assert land.now.tolist() == wanted


def test_allocation_invariants():
    rng = np.random.default_rng(5)
    cells = np.ones(1600, dtype=np.int64)
    one = lambda p, **k: allocate.Transition(1, 2, np.full(1600, float(p)), **k)
    assert (allocate.allocate(allocate.Landscape(cells, 40, 40), [one(1)], rng, single_cells=True) == 2).all()
    assert (allocate.allocate(allocate.Landscape(cells, 40, 40), [one(0, rate=0.5)], rng, single_cells=False) == 1).all()
    done = allocate.allocate(allocate.Landscape(cells, 40, 40), [one(0.4, area_mean=4, area_var=1, rate=0.3)], rng, single_cells=False)
    assert 0.3 * 1600 * 0.5 < (done == 2).sum() <= np.ceil(0.3 * 1600) + 10


def test_areas():
    rng = np.random.default_rng(0)
    for kind in ("lognormal", "normal"):
        a = [allocate.sample_area(rng, 20, 25, kind) for _ in range(4000)]
        assert abs(np.mean(a) - 20) < 0.5 and abs(np.var(a) - 25) < 4 and min(a) >= 1
    assert allocate.sample_area(rng, float("nan"), 1) == 1 and allocate.sample_area(rng, -3, 1) == 1


def _pair(spark, a, b):
    return spark.createDataFrame([(i, j, None if a[i, j] == 0 else int(a[i, j]), None if b[i, j] == 0 else int(b[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "row int, col int, a int, b int")


def test_fuzzy_similarity(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(1, 3, (10, 10))
    same = validate.fuzzy_similarity(_pair(spark, a, a), 10, 10).first()
    assert abs(same["similarity"] - 1) < 1e-9
    assert validate.fuzzy_similarity(_pair(spark, np.ones((10, 10)), np.full((10, 10), 2)), 10, 10).first()["similarity"] < 0.1
    tiles = [validate.fuzzy_similarity(_pair(spark, a, a.T), 10, 10, window=5, tile=t).first()["similarity"] for t in (4, 64)]
    assert abs(tiles[0] - tiles[1]) < 1e-12  # tiling doesn't matter
    with pytest.raises(ValueError):
        validate.weights(4)


def test_transition_similarity(spark):
    init = np.ones((10, 10), dtype=int)
    obs, sim = init.copy(), init.copy()
    obs[4, 3:8], sim[4, 4:9] = 2, 2
    d = spark.createDataFrame([(i, j, 1, int(obs[i, j]), int(sim[i, j])) for i in range(10) for j in range(10)], "row int, col int, init int, obs int, sim int")
    r = validate.transition_similarity(d, 1, 2, 10, 10).first()
    assert r["n_observed"] == r["n_simulated"] == 5 and r["similarity"] > 0.7
    assert validate.transition_similarity(d, 1, 3, 10, 10).first()["similarity"] is None


def test_change_map_needs_both_classes(spark):
    d = spark.createDataFrame([(1, 2)], "init int, final int")
    with pytest.raises(ValueError):
        validate.change_map(d, 1)


def test_typed_predictors_fill_nulls(spark):
    d = spark.createDataFrame([(1, 1.5, 2.0, 1.0, 2.0), (2, None, None, None, None)], "id_coord int, id_pred_1 double, id_pred_2 double, id_pred_3 double, id_pred_4 double")
    meta = [{"id_pred": 1, "data_type": "float", "fill_value": None, "factor_levels": None}, {"id_pred": 2, "data_type": "int", "fill_value": "7", "factor_levels": None}, {"id_pred": 3, "data_type": "bool", "fill_value": "false", "factor_levels": None}, {"id_pred": 4, "data_type": "factor", "fill_value": None, "factor_levels": ["a", "b"]}]
    assert [tuple(r) for r in design.typed_predictors(d, meta).orderBy("id_coord").collect()] == [(1, 1.5, 2, True, "b"), (2, None, 7, False, None)]


def test_adjusted_potentials(spark):
    pot = spark.createDataFrame([(1, 2, 1, 0.4), (1, 2, 2, 0.4), (2, 2, 1, 0.6), (2, 2, 2, 0.3)], "id_trans int, id_period_post int, id_coord int, value double")
    rates = spark.createDataFrame([(2, 1, 0.2), (2, 2, 0.3)], "id_period int, id_trans int, rate double")
    found = potential.adjusted_potentials(pot, rates, 2)
    means = {r[0]: r[1] for r in found.groupBy("id_trans").avg("value").collect()}
    assert abs(means[1] - 0.2) < 1e-12 and abs(means[2] - 0.3) < 1e-12
    full = potential.adjusted_potentials(pot, rates.withColumn("rate", F.lit(0.9)), 2)
    assert full.groupBy("id_coord").sum("value").where("`sum(value)` > 1.0000001").count() == 0


def test_learners():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (rng.random(600) < 0.05)).astype(int)
    for learner in (models.Tree(), models.Forest(n_trees=10), models.Forest(n_trees=10, gamma=0.9)):
        assert models.auc(y[400:], learner.fit(x[:400], y[:400]).predict(x[400:])) > 0.9
    guided = models.Forest(n_trees=10, gamma=0.9).fit(x, y)
    assert np.argmax(guided.importance) == 0
    assert np.allclose(models.Featureless().fit(x, y).predict(x[:3]), y.mean())
    assert np.allclose(models.balanced_weights(np.array([0, 0, 0, 1])), [2 / 3] * 3 + [2])


def test_failed_fits_are_rows(spark):
    d = spark.createDataFrame([(0, 1, i, i % 2 == 0, float(i)) for i in range(20)], "id_run int, id_trans int, id_coord int, did_transition boolean, x double")
    class_ = models.Tree(max_depth=None)  # type: ignore[arg-type]
    assert models.fit_partial(d, ["x"], class_).first()["learner_id"] == "error"
    assert models.fit_partial(d, ["x"], models.Featureless()).first()["crossval_score"]["classif.auc"] == "0.5"


def test_constructors(spark, rows):
    p = build.periods(spark, "P10Y", "1985-01-01", "2005-01-01", "2015-01-01")
    assert [tuple(map(str, r)) for r in p.orderBy("id_period").collect()][1] == ("1", "1985-01-01", "1994-12-31", "False")
    with pytest.raises(ValueError):
        build.periods(spark, "P1M", "1985-01-01", "2005-01-01", "2015-01-01")
    with pytest.raises(ValueError, match="data_type|invalid"):
        build.pred_meta(spark, {"x": {"data_type": "complex"}})
    assert build.check_periods([3, 4], [1, 2, 3, 4]) == [3, 4]
    for wrong in ([1, 3], [4, 5], []):
        with pytest.raises(ValueError):
            build.check_periods(wrong, [1, 2, 3, 4])


def test_download(tmp_path):
    source = tmp_path / "a.txt"
    source.write_text("hello")
    s = {"url": source.as_uri(), "md5sum": "5d41402abc4b2a76b9719d911017c592"}
    (path,) = download_and_verify([s], str(tmp_path / "cache"))
    source.unlink()
    assert download_and_verify([s], str(tmp_path / "cache")) == [path]  # from the cache
    source.write_text("other")
    with pytest.warns(UserWarning, match="checksum"):
        download_and_verify([s], str(tmp_path / "cache"), overwrite=True)

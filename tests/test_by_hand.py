"""Operators that SQL can't express, held against plain versions of themselves."""

from __future__ import annotations

import math
import pickle
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from landweave.operators import allocate, graph, models, patches, validate
from landweave.plans import external
from landweave.queries import analytics, storage  # noqa: F401 - registers more queries
from landweave.queries.panel import Panel

SF = "/root/testdata/sf0.001"


def test_perturbed_params_by_the_published_hash(spark):
    """Box-Muller on XXH64 of (seed, which, run, transition), each hash the seed of the next."""
    d = spark.createDataFrame([(t, 1.0, 1.0, 0.2, 1.0, t / 10, 1 - t / 10) for t in range(1, 10)], "id_trans int, mean_patch_size double, patch_size_variance double, patch_elongation double, patch_isometry double, frac_expander double, frac_patcher double")

    def uniform(k, run, trans, seed=3):
        h = 42
        for x in (seed, k, run, trans):
            h = xxhash.xxh64_intdigest(struct.pack("<i", x), h)
        return ((h - (1 << 64) if h >> 63 else h) % (1 << 52) + 0.5) / (1 << 52)

    for r in patches.perturbed_params(d, 2, 0.1, seed=3).collect():
        run, t = r["id_run"], r["id_trans"]
        moved = 0 if run == 1 else math.sqrt(-2 * math.log(uniform(1, run, t))) * math.cos(2 * math.pi * uniform(2, run, t)) * 0.1
        assert abs(r["frac_expander"] - min(1, max(0, t / 10 + moved))) < 1e-12 and abs(r["frac_expander"] + r["frac_patcher"] - 1) < 1e-12
    with pytest.raises(ValueError):
        patches.perturbed_params(d, 2, 0.1, run_ids=[1, 2])


def by_hand(before, n_rows, n_cols, trans, rng, avoid):
    """Allocation by patches, cell by cell, with dictionaries and the same draws."""
    now = dict(enumerate(before))
    near = lambda x: [y for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1)) if 0 <= x // n_cols + dr < n_rows and 0 <= x % n_cols + dc < n_cols for y in [x + dr * n_cols + dc]]

    def elongation(cells):
        rc = [divmod(x, n_cols) for x in cells]
        n, r, c = len(rc), [a for a, _ in rc], [b for _, b in rc]
        mr, mc = sum(r) / n, sum(c) / n
        a, b, d = sum(x * x for x in r) / n - mr * mr, sum(x * x for x in c) / n - mc * mc, sum(x * y for x, y in rc) / n - mr * mc
        half = math.sqrt(max(0, (a - b) ** 2 / 4 + d * d))
        high = (a + b) / 2 + half
        return 1 - math.sqrt(max(0, (a + b) / 2 - half) / high) if high > 0 else 0.0

    def grow(pivot, area, t):
        patch = [pivot]
        foreign = lambda x: before[x] == t.from_class and now[x] == t.to_class
        while len(patch) < area:
            border = {y for x in patch for y in near(x)} - set(patch)
            if avoid and any(map(foreign, border)):
                return None, patch
            free = sorted(x for x in border if before[x] == now[x] == t.from_class)
            if not free:
                if avoid:
                    return None, patch
                break
            score = [max(0, t.p[x]) / (abs(elongation([*patch, x]) - t.elongation) + allocate.EPS) for x in free]
            best = max(score)
            patch.append(next(x for x, s in zip(free, score) if s >= best * (1 - 1e-12)))
        if avoid and any(map(foreign, near(patch[-1]))):
            return None, patch
        for x in patch:
            now[x] = t.to_class
        return patch, patch

    for c in sorted({t.from_class for t in trans}):
        own = [t for t in trans if t.from_class == c]
        pool = [x for x in now if before[x] == now[x] == c]
        left, size, failed = [t.rate * len(pool) for t in own], max(1, len(pool) // 100), set()
        while any(x > 0 for x in left):
            pool = [x for x in pool if x not in failed and now[x] == c]
            if not pool:
                break
            state = []
            for x, u in zip(pool, rng.random(len(pool))):
                upto, state_x = 0.0, -1
                for q, t in enumerate(own):
                    upto += (t.p[x] / t.area_mean if t.area_mean > 1 else t.p[x]) if left[q] > 0 else 0.0
                    if u < upto:
                        state_x = q
                        break
                state.append(state_x)
            drawn = np.array([i for i, s in enumerate(state) if s >= 0])
            if not len(drawn):
                break
            tried = 0
            for i in rng.permutation(drawn).tolist():
                q, x = state[i], pool[i]
                if tried >= size:
                    break
                if left[q] <= 0 or x in failed or now[x] != c:
                    continue
                patch, cells = grow(x, allocate.sample_area(rng, own[q].area_mean, own[q].area_var), own[q])
                tried += 1
                if patch:
                    left[q] -= len(patch)
                else:
                    failed.update(cells)
    return [now[x] for x in range(len(before))]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("avoid", [True, False])
def test_allocation_by_hand(spark, seed, avoid):
    rng = np.random.default_rng(seed)
    n_rows, n_cols = 12, 15
    before = rng.integers(1, 4, n_rows * n_cols)
    p = rng.uniform(0, 0.4, (3, len(before)))
    ends, rates = [(1, 2), (1, 3), (2, 1)], (0.15, 0.1, 0.2)
    trans = [allocate.Transition(a, b, p[k], 3.0, 1.5, 0.4, rates[k]) for k, (a, b) in enumerate(ends)]
    wanted = by_hand(before.tolist(), n_rows, n_cols, trans, np.random.default_rng([7, 5]), avoid)
    cells = spark.createDataFrame([(5, i, i // n_cols, i % n_cols, int(v)) for i, v in enumerate(before)], "id_run int, id_coord int, row int, col int, id_lulc int")
    pot = spark.createDataFrame([(5, k + 1, i, float(p[k, i])) for k in range(3) for i in range(len(before))], "id_run int, id_trans int, id_coord int, value double")
    of = spark.createDataFrame([(5, k + 1, a, b, 3.0, 1.5, 0.4, rates[k]) for k, (a, b) in enumerate(ends)], "id_run int, id_trans int, id_lulc_anterior int, id_lulc_posterior int, area_mean double, area_var double, elongation double, rate double")
    got = {r["id_coord"]: r["id_lulc"] for r in allocate.allocate_runs(cells, pot, of, seed=7, avoid=avoid).collect()}
    assert [got[i] for i in range(len(before))] == wanted and wanted != before.tolist()


def test_models_by_hand(spark):
    """Fits of the queries without SQL, on the rows brought to the driver."""
    panel = Panel(spark, SF)
    t, names = storage._labelled(panel)
    pdf = models.stratified(t, 0.7, 1, "id_run", "id_trans", "did_transition").toPandas()
    y, x, train = pdf["did_transition"].to_numpy().astype(int), pdf[names].to_numpy(dtype=float), pdf["is_train"].to_numpy()
    # A tree's rows come in any order; its splits don't depend on it.
    tree = models.Tree(max_depth=4).fit(x[train], y[train])
    p = tree.predict(x[~train])
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y[~train] == 1] for b in p[y[~train] == 0]]
    (found,) = analytics.QUERIES["m1_fit_partial_tree"](spark, SF).collect()
    assert float(found["auc"]) == pytest.approx(np.mean(pairs)) and float(found["acc"]) == pytest.approx(np.mean((p > 0.5) == y[~train]))
    whole = models.fit_full(t, names, learner=models.Tree(max_depth=3)).first()
    assert np.allclose(pickle.loads(whole["learner_full"]).predict(x), models.Tree(max_depth=3).fit(x, y).predict(x))
    scores = {r["feature"]: r["score"] for r in models.filter_scores(t, names, "performance", models.Tree(max_depth=3)).collect()}
    assert set(scores) == set(names) and all(0.2 < s < 0.8 for s in scores.values())
    importance = {r["feature"]: r["score"] for r in analytics.QUERIES["m6_filter_importance"](spark, SF).collect()}
    assert set(importance) == set(names) and all(s >= 0 for s in importance.values()) and max(importance.values()) > 0


def test_a_tree_s_first_cut_by_hand():
    rng = random.Random(3)
    x = np.array([[rng.randrange(20), rng.randrange(20)] for _ in range(200)], dtype=float)
    y = np.array([int(a > 11) ^ (rng.random() < 0.1) for a, _ in x])
    best = max(((sum(y[x[:, f] <= c]) ** 2 / sum(x[:, f] <= c) + sum(y[x[:, f] > c]) ** 2 / sum(x[:, f] > c), f, c) for f in (0, 1) for c in np.unique(x[:, f])[:-1] if 5 <= sum(x[:, f] <= c) <= 195))
    assert models.Tree(max_depth=1).fit(x, y).nodes[0][:2] == (best[1], best[2])


def test_features_of_each_transition(spark):
    rows = [(0, t, i, i % 3 == 0, float(i % 3), float(i % 5)) for t in (1, 2) for i in range(60)]
    d = spark.createDataFrame(rows, "id_run int, id_trans int, id_coord int, did_transition boolean, a double, b double")
    features = {1: ["a"], 2: ["b"]}
    auc = {r["id_trans"]: float(r["crossval_score"]["classif.auc"]) for r in models.fit_partial(d, features, models.Tree()).collect()}
    assert auc[1] == 1.0 and auc[2] < 0.9
    full = models.fit_full(d, features, learner=models.Tree())
    value = {(r["id_trans"], r["id_coord"]): r["value"] for r in models.predict(d, features, full).collect()}
    assert all(value[(1, i)] == (i % 3 == 0) for i in range(60)) and all(value[(2, i)] == pytest.approx(1 / 3) for i in range(60))  # the other feature says nothing
    assert {(r["id_trans"], r["feature"]) for r in models.filter_scores(d, features).collect()} == {(1, "a"), (2, "b")}
    held = models.crossval_predictions(models.fit_partial(d, features, models.Tree())).groupBy("id_trans").count().collect()
    assert {r["id_trans"]: r["count"] for r in held} == {1: 18, 2: 18}


@pytest.mark.parametrize("n_trees", [1, 8])
def test_spread_fits(spark, n_trees):
    """Fits by the cluster are as good as those of a task, and predict missing values alike."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] + 0.5 * (x[:, 1] > 0) > 0.2) ^ (rng.random(800) < 0.05)
    x[rng.random((800, 3)) < 0.05] = np.nan
    rows = [(0, 1, i, bool(y[i]), *(None if np.isnan(v) else float(v) for v in x[i])) for i in range(800)]
    d = spark.createDataFrame(rows, "id_run int, id_trans int, id_coord int, did_transition boolean, a double, b double, c double")
    fitted = models.fit_spread(d.where("id_coord < 500"), ["a", "b", "c"], max_depth=5, n_trees=n_trees)
    value = {r["id_coord"]: r["value"] for r in models.predict(d.where("id_coord >= 500"), ["a", "b", "c"], fitted).collect()}
    local = models.Tree(max_depth=5).fit(x[:500], y[:500].astype(int)).predict(x[500:])
    assert models.auc(y[500:].astype(int), np.array([value[i] for i in range(500, 800)])) > models.auc(y[500:].astype(int), local) - 0.05


def test_components_by_hand(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(1000, i) for i in range(1001, 1200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {x for x in parent if sum(root(y) == root(x) for y in parent) == 1}
    assert found == {x: root(x) for x in parent if x not in alone}


def test_gaps_of_fuzzy_similarity(spark):
    cells = [(i, j, 1 + (i + j) % 2, None if (i, j) == (4, 4) else 1 + (i + j) % 2) for i in range(9) for j in range(9)]
    d = spark.createDataFrame(cells, "row int, col int, a int, b int")
    some, none = validate.fuzzy_similarity(d, 9, 9, window=3).first(), validate.fuzzy_similarity(d, 9, 9, window=3, ignore_na=False).first()
    assert some["similarity"] == pytest.approx(1) and none["similarity"] is None and none["mean_a"] is None
    whole = d.withColumn("b", F.col("a"))
    assert validate.fuzzy_similarity(whole, 9, 9, window=3, ignore_na=False).first()["similarity"] == pytest.approx(1)
    with pytest.raises(ValueError):
        validate.fuzzy_similarity(d.withColumns({"a": F.lit(None).cast("int"), "b": F.lit(None).cast("int")}), 9, 9)


def test_similarities_of_all_transitions(spark):
    rng = np.random.default_rng(2)
    init, obs, sim = (rng.integers(1, 4, (12, 12)) for _ in range(3))
    d = spark.createDataFrame([(i, j, int(init[i, j]), int(obs[i, j]), int(sim[i, j])) for i in range(12) for j in range(12)], "row int, col int, init int, obs int, sim int")
    trans = spark.createDataFrame([(1, 1, 2), (2, 3, 1), (3, 1, 9)], "id_trans int, id_lulc_anterior int, id_lulc_posterior int")
    every = {r["id_trans"]: r["similarity"] for r in validate.transition_similarities(d, trans, 12, 12, window=5).collect()}
    for t, a, b in ((1, 1, 2), (2, 3, 1)):
        assert every[t] == pytest.approx(validate.transition_similarity(d, a, b, 12, 12, window=5).first()["similarity"])
    assert every[3] is None


SCRIPT = """@version = 8.3
Script {{
    a := CalculateRExpression "x <- v1 * 2
output(\\"n\\", x)" .no {{
        NumberValue v1 1;
    }};
    b := CalculatePythonExpression "print('hi')" {{ }};
}};
"""


def test_scripts():
    coded = external.recode_script(SCRIPT)
    assert "x <- v1" not in coded and "print" not in coded and coded.count("Calculate") == 2
    assert external.recode_script(coded, "decode") == SCRIPT
    with pytest.raises(ValueError, match="base 64"):
        external.recode_script(coded)
    with pytest.raises(ValueError, match="plain"):
        external.recode_script(SCRIPT, "decode")
    assert external.recode_script("nothing to do") == "nothing to do"
    assert external.fill_script("{a} {b}", {"a": 1, "b": "x"}) == "1 x"
    with pytest.raises(ValueError, match="driver"):
        external.local_folder("hdfs://host/x")


def test_console(tmp_path):
    tool = tmp_path / "tool"
    tool.write_text("#!/bin/sh\nprintf '\\033[31mran\\033[0m %s\\n' \"$*\"\n[ -f fails ] && echo 'Tool exited with an error'\nexit 0\n")
    tool.chmod(0o755)
    said = external.run_console(str(tool), "m.script", str(tmp_path), log_level=4)
    assert said == "ran -disable-parallel-steps -log-level 4 m.script\n" and [p.read_text() for p in tmp_path.glob("*.log")] == [said]
    (tmp_path / "fails").touch()
    with pytest.raises(RuntimeError, match="error"):
        external.run_console(str(tool), "m.script", str(tmp_path), log=False)

"""The database from ingestion to simulation, on a small landscape."""

from __future__ import annotations

import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from landweave.operators import build, models
from landweave.operators.transitions import transition_meta
from landweave.plans.database import LandDatabase, run_parallel
from landweave.schemas import TABLES
from landweave.streaming.ingest import ingest

N = 12


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    db = LandDatabase(spark, str(tmp_path_factory.mktemp("land") / "db"))
    extent = (0, N * 100, 0, N * 100)
    db.put("coords_t", build.square_grid(spark, extent, 100), resolution=100.0, epsg=2056)
    db.put("periods_t", build.periods(spark, "P10Y", "1985-01-01", "2005-01-01", "2015-01-01"))
    db.put("lulc_meta_t", build.lulc_meta(spark, {"forest": {"src_classes": [1, 2, 3]}, "urban": {"src_classes": [4]}, "agriculture": {"src_classes": [5, 6]}}))
    rng = np.random.default_rng(42)
    rows = [(0, i + 1, int(c) + 1, t) for t, p in ((1, 0.3), (2, 0.5), (3, 0.6)) for i, c in enumerate(rng.random(N * N) < p)]
    db.put("lulc_data_t", spark.createDataFrame(rows, TABLES["lulc_data_t"].schema))
    db.add_predictor("elevation", db.coords_t.select("id_coord", (F.col("lon") + F.col("lat")).alias("value")))
    db.add_predictor("soil", db.coords_t.select("id_coord", F.when(F.col("id_coord") % 2 == 0, "Clay").otherwise("Sandy").alias("value")))
    db.put("trans_meta_t", transition_meta(db.trans_v, 5))
    db.set_neighbors(300, [0, 150, 300])
    db.generate_neighbor_predictors()
    db.set_full_trans_preds()
    db.put("trans_rates_t", db.get_obs_trans_rates())
    db.put("trans_rates_t", db.spark.createDataFrame([(0, 4, t, None, 0.2) for t in (1, 2)], TABLES["trans_rates_t"].schema))
    db.put("runs_t", spark.createDataFrame([(1, 0, "unperturbed"), (2, 0, "perturbed")], TABLES["runs_t"].schema))
    return db


def test_tables(db):
    assert db.row_count("lulc_data_t") == 3 * N * N and db.metadata("coords_t")["resolution"] == 100.0
    assert db.column_max("pred_meta_t", "id_pred") == 2 + 3 * 2
    assert db.trans_meta_t.where("is_viable").count() == 2
    assert db.lulc_meta_long_v.count() == 6 and db.trans_v.count() == 2 * N * N
    with pytest.warns(UserWarning, match="stays"):
        db.put("coords_t", db.coords_t)
    with pytest.raises(ValueError, match="duplicate"):
        db.put("lulc_data_t", db.lulc_data_t.union(db.lulc_data_t))
    with pytest.raises(ValueError, match="lacks"):
        db.put("lulc_data_t", db.lulc_data_t.drop("id_lulc"))
    assert db.summary("runs_t").count() == 3
    db.set_report(purpose="test")
    assert {r["key"] for r in db.reporting_t.collect()} >= {"purpose", "last_opened", "report_name"}


def test_matrices_of_a_transition(db):
    assert db.run_lineage == [0] and db.pred_sources_v.count() == 0
    a, b = db._transition(1)
    rows = db.trans_pred_data_v(1)
    before = db.trans_v.where((F.col("id_lulc_anterior") == a) & (F.col("id_period") <= 3))
    assert rows.count() == before.count() and rows.where("did_transition").count() == before.where(F.col("id_lulc_posterior") == b).count()
    kinds = dict(rows.dtypes)
    assert kinds["id_pred_1"] in ("double", "int") and kinds["id_pred_2"] == "string" and {r[0] for r in rows.select("id_pred_2").distinct().collect()} == {"Clay", "Sandy"}
    wide = db.pred_data_wide_v(1, 3)
    assert wide.count() == db.lulc_data_t.where((F.col("id_period") == 3) & (F.col("id_lulc") == a)).count() and set(wide.columns) == {"id_coord", *(f"id_pred_{i}" for i in range(1, 9))}
    assert db.trans_pred_data_v(2, [1]).columns == ["id_coord", "id_period", "did_transition", "id_pred_1"]


def test_override_by_a_run(db):
    before = db.fetch("pred_data_t", where="id_pred = 1").count()
    db.id_run = 2
    db.put("pred_data_t", db.pred_data_t.where("id_pred = 1").withColumns({"id_run": F.lit(2), "value": F.col("value") + 100}))
    seen = db.fetch("pred_data_t", where="id_pred = 1")
    assert seen.count() == before and seen.select("id_run").distinct().collect()[0][0] == 2
    db.id_run = 0
    assert db.fetch("pred_data_t", where="id_pred = 1").select("id_run").distinct().collect()[0][0] == 0
    with pytest.raises(ValueError):
        db.id_run = 99
    db.id_run = 0


def test_models_potentials_allocation(db):
    fitted = db.fit_partial_models(models.Featureless())
    assert fitted.count() == 2 and {r["crossval_score"]["classif.auc"] for r in fitted.collect()} == {"0.5"}
    db.fit_partial_models(models.Tree(max_depth=3))
    assert db.get_crossval_scores().count() == 8
    with pytest.raises(ValueError, match="no model"):
        db.predict_trans_pot(4, "classif.auc")
    db.fit_full_models(select_score="classif.acc")
    scores = db.get_pred_filter_score("correlation")
    assert scores.count() == 2 * 8
    params = db.create_alloc_params_t(1, 0.1)
    db.put("alloc_params_t", params)
    assert {r[0] for r in params.select("id_run").distinct().collect()} == {1, 2}
    assert params.where("abs(frac_expander + frac_patcher - 1) > 1e-9 and id_run = 2").count() == 0
    db.id_run = 1
    db.alloc_patches([4], "classif.acc", seed=3)
    new = db.fetch("lulc_data_t", where="id_period = 4")
    assert new.count() == N * N and new.select("id_run").distinct().collect()[0][0] == 1
    changed = new.alias("n").join(db.fetch("lulc_data_t", where="id_period = 3").alias("o"), "id_coord").where("n.id_lulc <> o.id_lulc").count()
    assert 0 < changed <= np.ceil(0.2 * N * N) + 2 * 15
    assert db.adjusted_trans_pot_v(4).groupBy("id_coord").sum("value").where("`sum(value)` > 1.000001").count() == 0
    db.id_run = 0


def test_external_allocator_is_absent(db, tmp_path):
    db.id_run = 2
    with pytest.warns(UserWarning, match="isn't there"):
        db.alloc_external([4], "classif.acc", str(tmp_path))
    same = db.read("lulc_data_t").where("id_run = 2 and id_period = 4").alias("n").join(db.read("lulc_data_t").where("id_run = 0 and id_period = 3").alias("o"), "id_coord")
    assert same.where("n.id_lulc = o.id_lulc").count() == N * N
    assert {"From*", "To*", "Rate"} == set(db.spark.read.csv(f"{tmp_path}/4/trans_rates.csv", header=True).columns)
    db.id_run = 0


def test_evaluation(db):
    db.id_run = 1
    found = db.eval_alloc_params_t([1], [3], "classif.acc", window=5)
    assert found.count() == 2 and found.where("similarity between 0 and 1").count() == 2
    db.id_run = 0


def test_transitions_without_data_are_skipped(db):
    db.id_run = 1
    held = db.read("lulc_data_t").where("id_period = 3").select("id_coord").limit(20)
    db.put("lulc_data_t", held.select(F.lit(1).alias("id_run"), "id_coord", F.lit(1).alias("id_lulc"), F.lit(6).alias("id_period")))
    with pytest.warns(UserWarning, match="no data for transition 2 in period 7"):
        assert db.predict_trans_pot(7, "classif.acc") > 0
    assert {r[0] for r in db.read("trans_pot_t").where("id_period_post = 7").select("id_trans").distinct().collect()} == {1}
    with pytest.warns(UserWarning, match="no data"):
        assert db.predict_trans_pot(9, "classif.acc") == 0
    db.id_run = 0


def test_external_allocator(db, tmp_path):
    """A console that finds its inputs and leaves a map in which one cell changed."""
    tool = tmp_path / "tool"
    tool.write_text(f"""#!{sys.executable}
import os, sys
import pyarrow.parquet as pq
assert "eCA8LSAx" in open(sys.argv[-1]).read() and os.path.exists("trans_rates.csv") and os.path.exists("probability")
t = pq.read_table("anterior").to_pandas()
t.loc[0, "value"] = 3
os.mkdir("posterior")
t.to_parquet("posterior/part-0.parquet")
print("done")
""")
    tool.chmod(0o755)
    db.id_run = 2
    db.alloc_external([4], "classif.acc", str(tmp_path / "work"), script='a := CalculateRExpression "x <- 1" .no {{ }};', binary=str(tool))
    after = db.read("lulc_data_t").where("id_run = 2 and id_period = 4")
    assert after.count() == N * N and after.where("id_lulc = 3").count() == 1
    db.id_run = 0


def test_parallel(db):
    assert run_parallel([1, 2], lambda t, d: d.fetch("trans_meta_t", where=f"id_trans = {t}").count(), db) == [1, 1]


def test_stream(db, spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(0, i, 1, 9, s) for i in range(5) for s in (1, 2)]
    spark.createDataFrame([(r[0], r[1], r[2] if r[4] == 1 else 3, r[3], r[4]) for r in rows], "id_run int, id_coord int, id_lulc int, id_period int, seq int").write.parquet(source)
    stream = spark.readStream.schema("id_run int, id_coord int, id_lulc int, id_period int, seq int").parquet(source)
    ingest(db, stream, "lulc_data_t", str(tmp_path / "cp")).awaitTermination(120)
    assert {r[0] for r in db.read("lulc_data_t").where("id_period = 9").select("id_lulc").collect()} == {3}
    assert db.read("lulc_data_t").where("id_period = 9").count() == 5


def test_models_of_several_runs(db):
    """Predictors of a run of its own: its models see its rows."""
    db.id_run = 2
    db.put("trans_preds_t", db.trans_preds_t.where("id_run = 0").unionByName(db.spark.createDataFrame([(2, 1, 1)], TABLES["trans_preds_t"].schema)))
    training, features = db._training()
    assert {r[0] for r in training.select("id_run").distinct().collect()} == {2}
    db.id_run = 0
    fitted = db.fit_partial_models(models.Featureless(), trans_meta=db.trans_meta_t.where("id_trans = 1"))
    assert fitted.where("id_trans = 1").count() >= 1
    assert features[1][0] == "id_pred_1" and db.get_crossval_predictions().select("id_trans").distinct().count() == 2
    spread = db.fit_spread_models(max_depth=2).where("learner_id = 'classif.rpart' and learner_full is not null")
    assert {r["id_trans"] for r in spread.collect()} == {1, 2}
    with pytest.raises(ValueError, match="no viable"):
        db.fit_partial_models(models.Featureless(), trans_preds=db.trans_preds_t.where("false"))

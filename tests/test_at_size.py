"""What only shows with many or large ids, on tables of a few rows."""

from __future__ import annotations

import datetime
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landweave.operators import allocate, models, neighbors
from landweave.queries import analytics, storage  # noqa: F401 - registers more queries
from landweave.queries.panel import Panel

SF = "/root/testdata/sf0.001"


@pytest.fixture
def parts(spark, tmp_path):
    """A folder with the tables of parts that have the given keys."""

    def of(*keys: int) -> str:
        part = [(k, f"p{k}", "b", "t", k % 50 + 1, 900.0 + k % 7) for k in keys]
        spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
        sold = [(k, k % 5 + y % 3 + 1.0, datetime.datetime(y, 3, 1)) for k in keys for y in range(1995, 2000)]
        spark.createDataFrame(sold, "l_partkey long, l_quantity double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
        return str(tmp_path)

    return of


def by_sql(name: str, folder: str, columns: list[str], files: str = ".parquet/*.parquet") -> list[tuple]:
    import duckdb

    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '{folder}/{t}{files}'")
    return sorted(con.execute("select " + ", ".join(columns) + f" from ({analytics.ORACLE_SQL[name]})").fetchall())


def joins(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_are_not_broadcast(spark):
    pairs = neighbors.neighbor_pairs(Panel(spark, SF).coords, 300, [0.0, 300.0])
    assert "SortMergeJoin" in joins(pairs) and "Broadcast" not in joins(pairs)


def test_cells_are_not_broadcast_to_be_counted(spark):
    plan = joins(analytics.QUERIES["a5_neighbor_counts"](spark, SF))
    assert "SortMergeJoin [gx" in plan and "BroadcastHashJoin [gx" not in plan


def test_classed_pairs_are_merged(spark):
    plan = joins(analytics.QUERIES["j10_neighbors"](spark, SF))
    assert "SortMergeJoin [gx" in plan and "Broadcast" not in plan


def test_uniforms_of_large_ids(spark, parts):
    """Ids times 7919 are beyond 32 bits, where the SQL overflows as well: the states are worked out here."""
    ids = (3, 271_178, 271_179, 1_199_999, 7_199_999)
    df = analytics.QUERIES["r6_multinomial"](spark, parts(*ids))
    for cell, state in ((r["cell"], r["state"]) for r in df.collect()):
        upto, wanted = 0.0, None
        own = [t for t in (1, 2, 3, 4) if (cell + t) % 5]
        for t in own:
            upto += (cell * 37 + t * 11) % 100 / 100 / 2
            wanted = t if wanted is None and (cell * 7919) % 1000 / 1000 < upto else wanted
        assert state == (wanted or own[-1])


def test_upsert_of_ids_that_the_panel_has(spark, parts):
    """The added cells are apart from the panel's, also where the panel reaches their ids."""
    folder = parts(*range(5), 20, *range(99_999, 100_006))
    df = analytics.QUERIES["s13_upsert"](spark, folder)
    assert sorted(map(tuple, df.collect())) == by_sql("s13_upsert", folder, df.columns)


def test_held_out_scores_choose_the_model(spark, monkeypatch):
    """What is refitted follows from the scores of the fits, which nothing puts others in the place of."""
    wanted = sorted(by_sql("m2_select_and_refit", SF, ["learner_id", "id_coord", "value"], ".parquet"))
    assert sorted(map(tuple, analytics.QUERIES["m2_select_and_refit"](spark, SF).select("learner_id", "id_coord", "value").collect())) == wanted
    other = {"a": "b", "b": "a"}[wanted[0][0]]
    tried = models.fit_partial

    def reversed_scores(t, names, learner):
        return tried(t, names, learner).withColumn("crossval_score", F.create_map(F.lit("classif.auc"), F.when(F.col("learner_id") == other, "0.9").otherwise("0.1")))

    monkeypatch.setattr(models, "fit_partial", reversed_scores)
    df = analytics.QUERIES["m2_select_and_refit"](spark, SF)
    assert {r[0] for r in df.select("learner_id").collect()} == {other} and "CartesianProduct" not in joins(df)


def test_shares_by_value():
    x, y = np.array([[1.0], [1.0], [2.0], [np.nan]]), np.array([1, 0, 1, 0])
    assert models.Shares().fit(x, y).predict(np.array([[1.0], [2.0], [np.nan], [1.5], [9.0]])).tolist() == [0.5, 1.0, 0.0, 0.5, 0.5]


def test_a_run_s_raster_is_kept_in_few_bytes(spark):
    """Of 160,000 cells and two transitions at most 110 bytes a cell; the last column is beyond what the cells fill."""
    side = 400
    i = np.arange(side * side, dtype=np.int32)
    run, full = allocate._Run(3), lambda x, t="i4": pa.array(np.full(len(i), x, dtype=t))
    none = lambda t: pa.nulls(len(i), t)
    names = ["k", "id_coord", "row", "col", "value", "params"]
    cells = pa.RecordBatch.from_arrays([pa.array(i % 3 + 1), pa.array(i), pa.array(i // side), pa.array(i % side), none(pa.float64()), none(pa.list_(pa.float64()))], names=names)
    pots = [pa.RecordBatch.from_arrays([full(t), pa.array(i), none(pa.int32()), none(pa.int32()), full(0.3 * t, "f8"), none(pa.list_(pa.float64()))], names=names) for t in (1, 2)]
    ends = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int32()), *[pa.nulls(2, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.float64())], pa.array([[1, 2, 4.0, 2.0, None, 0.05], [2, 3, 4.0, None, 0.5, 0.05]])], names=names)
    tracemalloc.start()
    for kind, rows in ((0, ends), (1, cells), *[(2, p) for p in pots]):
        for a in range(0, rows.num_rows, 10_000):
            run.take(kind, rows.slice(a, 10_000))
    out = list(run.allocated(7, {}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == len(i) and peak < 110 * len(i)
    dense = [allocate.Transition(t, t + 1, np.full(len(i), 0.3 * t), 4.0, (2.0, 0.0)[t - 1], 0.5, 0.05) for t in (1, 2)]
    wanted = allocate.allocate(allocate.Landscape(i % 3 + 1, side, side), dense, np.random.default_rng([7, 3]), single_cells=False)
    assert np.concatenate([b.column("id_lulc").to_numpy() for b in out]).tolist() == wanted.tolist()


def test_cuts_by_counting(monkeypatch):
    """Quantiles of counted values are those of the rows, and a forest of many rows with few values sorts none of them."""
    rng = np.random.default_rng(2)
    q = np.linspace(0, 1, 65)[1:-1]
    for n in (66, 1000, 5001):
        v = rng.choice(rng.normal(size=90), n)
        values, counts = np.unique(v, return_counts=True)
        assert np.array_equal(models.counted_quantiles(values, np.cumsum(counts), q), np.quantile(v, q))
    x = np.stack([rng.choice(rng.normal(size=100), 3000), rng.integers(0, 9, 3000), np.where(rng.random(3000) < 0.2, np.nan, rng.integers(0, 80, 3000))], axis=1)
    y = (x[:, 1] + rng.normal(size=3000) > 5).astype(int)
    sorted_ = []
    plain = np.quantile
    monkeypatch.setattr(np, "quantile", lambda v, *a: sorted_.append(len(v)) or plain(v, *a))
    counted = models.Forest(n_trees=3, gamma=0.9).fit(x, y)
    assert max(sorted_, default=0) <= 101
    # The same by sorting: as if every row had a value of its own.
    cuts = models.Tree._cuts

    def by_rows(self, x, rows, f):
        self._coded.values[f] = np.arange(len(x) + 1.0)
        return cuts(self, x, rows, f)

    monkeypatch.setattr(models.Coded, "at", lambda self, rows: models.Coded(list(self.values), self.codes))
    monkeypatch.setattr(models.Tree, "_cuts", by_rows)
    by_sort = models.Forest(n_trees=3, gamma=0.9).fit(x, y)
    assert max(sorted_) > 1000 and [t.nodes for t in by_sort.trees] == [t.nodes for t in counted.trees] and by_sort.importance.tolist() == counted.importance.tolist()

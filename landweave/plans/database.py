"""The land-use database: typed tables under keys, run lineage, and the steps of a simulation.

Reads are lazy frames of what the active run sees; writes go through the store's modes. A
simulation advances period by period, since what is allocated in one feeds the next's
predictors: the loop is on the driver, all work in it in Spark, and each period's result is
written before the next begins, so no plan grows with the number of periods. A frame that was
read before a write that touches its partitions must be read again.
"""

from __future__ import annotations

import functools
import os
import shutil
import warnings
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import allocate, build, models, neighbors, patches, potential, transitions, validate
from ..schemas import SOURCES, TABLES
from ..sources.folders import remove, settle, settle_at
from ..sources.raster import tabular_to_raster
from ..sources.store import ParquetStore
from . import design, external
from .lineage import lineage, validate_runs, visible


class LandDatabase(ParquetStore):
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, id_run: int | None = 0):
        super().__init__(spark, path, read_only)
        if not read_only and not self.exists("runs_t"):
            self.put("runs_t", spark.createDataFrame([(0, None, "base")], TABLES["runs_t"].schema))
        self._id_run: int | None = None
        self.id_run = id_run

    # runs

    @property
    def id_run(self) -> int | None:
        return self._id_run

    @id_run.setter
    def id_run(self, value: int | None) -> None:
        """The active run; None sees the rows of all runs."""
        self._line = None if value is None else lineage(self.read("runs_t"), value)
        self._id_run = value

    @property
    def run_lineage(self) -> list[int] | None:
        return self._line

    # tables

    def get(self, name: str, shadow: bool = False) -> DataFrame:
        """What the active run sees of a table; an empty table if there is none yet."""
        if not self.exists(name):
            return self.spark.createDataFrame([], TABLES[name].schema)
        df = self.read(name)
        return df if name == "runs_t" else visible(df, self._line, shadow)

    def fetch(self, name: str, cols: Sequence[str] | None = None, where: str | None = None, limit: int | None = None, in_order: bool = False) -> DataFrame:
        if not self.exists(name):
            raise KeyError(f"no table {name}")
        return self._fetched(self.get(name), name, cols, where, limit, in_order)

    def put(self, name: str, df: DataFrame | str, **attributes) -> int:
        """Casts, validates and writes rows (or a view's) in the table's mode; they are computed once. A table to be
        written once that is there already stays, with a warning."""
        spec = TABLES[name]
        if spec.mode == "write_once" and self.exists(name):
            warnings.warn(f"{name} is there already and stays", stacklevel=2)
            return self.row_count(name)
        df, settled = settle_at(spec.cast(self._frame(df, spec.maps)), name)
        try:
            spec.validate(df)
            if name == "runs_t":
                validate_runs(df.unionByName(self.read(name).join(df.select("id_run"), "id_run", "left_anti"), True) if self.exists(name) else df)
            mode = "overwrite" if spec.mode in ("write_once", "overwrite") else "upsert"
            return self.commit(df, name, mode, settled=True, keys=list(spec.keys), alternate=list(spec.alternate), partitions=list(spec.partitions), maps=list(spec.maps), **attributes)
        finally:
            remove(self.spark, settled)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.get(name)
        raise AttributeError(name)

    # views

    @property
    def lulc_meta_long_v(self) -> DataFrame:
        return build.unnest(self.get("lulc_meta_t"), "src_classes", "id_lulc", "name").withColumnRenamed("src_classes", "src_class")

    @property
    def pred_sources_v(self) -> DataFrame:
        return self.get("pred_meta_t").select(F.explode(F.col("sources").cast(SOURCES)).alias("s")).select("s.*").distinct()

    @property
    def trans_v(self) -> DataFrame:
        return transitions.transitions(self.get("lulc_data_t"))

    @property
    def extent(self) -> DataFrame:
        return build.extent(self.get("coords_t"))

    @property
    def coords_minimal(self) -> DataFrame:
        return build.coords_minimal(self.get("coords_t"))

    def adjusted_trans_pot_v(self, id_period_post: int) -> DataFrame:
        return potential.adjusted_potentials(self.get("trans_pot_t"), self.get("trans_rates_t"), id_period_post)

    def trans_rates_external_v(self, id_period: int) -> DataFrame:
        return transitions.rates_for_export(self.get("trans_rates_t"), self.get("trans_meta_t"), id_period)

    def alloc_params_patches_v(self) -> DataFrame:
        return patches.patch_params(self.get("alloc_params_t"))

    def _transition(self, id_trans: int) -> tuple[int, int]:
        found = self.get("trans_meta_t").where(F.col("id_trans") == id_trans).first()
        if found is None:
            raise ValueError(f"no transition {id_trans}")
        return found["id_lulc_anterior"], found["id_lulc_posterior"]

    def _predictors(self, id_trans: int, id_preds: Sequence[int] | None) -> list[int]:
        if id_preds is not None:
            return sorted(id_preds)
        return sorted(r[0] for r in self.get("trans_preds_t").where(F.col("id_trans") == id_trans).select("id_pred").distinct().collect())

    def _typed(self, df: DataFrame, ordered: bool = False) -> DataFrame:
        return design.typed_predictors(df, [r.asDict() for r in self.get("pred_meta_t").collect()], ordered)

    def trans_pred_data_v(self, id_trans: int, id_preds: Sequence[int] | None = None, ordered: bool = False) -> DataFrame:
        """The training matrix of a transition, predictors in their types."""
        a, b = self._transition(id_trans)
        return self._typed(design.training_matrix(self.get("lulc_data_t"), self.get("pred_data_t"), self.get("periods_t"), a, b, self._predictors(id_trans, id_preds)), ordered)

    def pred_data_wide_v(self, id_trans: int, id_period_anterior: int, ordered: bool = False) -> DataFrame:
        """The inference matrix of a transition in a period."""
        a, _ = self._transition(id_trans)
        return self._typed(design.inference_matrix(self.get("lulc_data_t"), self.get("pred_data_t"), a, self._predictors(id_trans, None), id_period_anterior), ordered)

    def lulc_data_as_rast(self, id_period: int | None = None, resolution: float | None = None) -> DataFrame:
        """(layer, row, col, value): a layer for each period."""
        d = self.get("lulc_data_t").select("id_coord", "id_period", "id_lulc")
        d = d if id_period is None else d.where(F.col("id_period") == id_period)
        return tabular_to_raster(d, self.get("coords_t"), "id_lulc", resolution or self.metadata("coords_t").get("resolution"))

    def summary(self, name: str) -> DataFrame:
        """Rows, and per column the number of distinct values and the range."""
        return summarise(self.get(name))

    # building

    def set_report(self, **entries: str) -> None:
        """Upserts entries; the defaults only where there are none yet. The time is always stamped."""
        rows = {k: str(v) for k, v in entries.items()}
        if not self.row_count("reporting_t"):
            rows = {"report_name": "landweave", "creator": os.environ.get("USER", "unknown")} | rows
        rows["last_opened"] = build.today()
        self.put("reporting_t", self.spark.createDataFrame(list(rows.items()), TABLES["reporting_t"].schema))

    def add_predictor(self, name: str, data: DataFrame, **meta) -> int:
        """Predictor values (id_coord, value, maybe id_period) under an existing or the next id, for the active run."""
        found = self.get("pred_meta_t").where(F.col("name") == name).first()
        id_pred = found["id_pred"] if found else self.column_max("pred_meta_t", "id_pred") + 1
        kind = meta.pop("data_type", None) or (found["data_type"] if found else build.infer_data_type(data))
        row = build.pred_meta(self.spark, {name: {"data_type": kind, **meta}}).withColumn("id_pred", F.lit(id_pred))
        value = F.col("value")
        if kind in ("factor", "ordered") and dict(data.dtypes)["value"] == "string":
            levels = list(meta.get("factor_levels") or (found and found["factor_levels"]) or sorted(r[0] for r in data.select("value").where("value is not null").distinct().collect()))
            row = row.withColumn("factor_levels", F.array(*map(F.lit, levels)))
            value = F.nullif(F.array_position(F.array(*map(F.lit, levels)), value), F.lit(0))
        if "id_period" not in data.columns:
            data = data.withColumn("id_period", F.lit(0))
        self.put("pred_meta_t", row)
        self.put("pred_data_t", data.select(F.lit(self.id_run or 0).alias("id_run"), "id_period", F.lit(id_pred).alias("id_pred"), "id_coord", value.cast("double").alias("value")))
        return id_pred

    def set_neighbors(self, max_distance: float = 1000, breaks: Sequence[float] = neighbors.BREAKS, overwrite: bool = False, rows_per_file: int = 100_000_000) -> None:
        """Stores the pairs of neighbours, in files of bounded size; leaves those that are there unless ``overwrite``."""
        if self.exists("neighbors_t"):
            if not overwrite:
                return
            self.delete_from("neighbors_t")
        self.rows_per_file = rows_per_file
        try:
            self.put("neighbors_t", neighbors.neighbor_pairs(self.get("coords_t"), max_distance, breaks), max_distance=float(max_distance))
        finally:
            del self.rows_per_file

    def generate_neighbor_predictors(self) -> None:
        """Predictors that count neighbours by class and distance, and their values in all observed periods."""
        meta = neighbors.predictor_meta(self.get("lulc_meta_t"), self.get("neighbors_t"), self.column_max("pred_meta_t", "id_pred") + 1)
        known = self.get("pred_meta_t").select("name")
        self.put("pred_meta_t", meta.join(known, "name", "left_anti"))
        self._put_neighbors(self.get("lulc_data_t"))

    def _put_neighbors(self, lulc: DataFrame) -> None:
        parsed = neighbors.parse_predictor_names(self.get("pred_meta_t"))
        if not parsed.limit(1).count():
            raise ValueError("there are no neighbour predictors")
        self.put("pred_data_t", neighbors.neighbor_counts(self.get("neighbors_t"), lulc, parsed, self.id_run or 0))

    def upsert_new_neighbors(self, id_period: int) -> None:
        self._put_neighbors(self.get("lulc_data_t").where(F.col("id_period") == id_period))

    def set_full_trans_preds(self) -> None:
        self.put("trans_preds_t", transitions.full_transition_predictors(self.get("pred_meta_t"), self.get("trans_meta_t")))

    def get_obs_trans_rates(self) -> DataFrame:
        return transitions.observed_rates(self.trans_v, self.get("trans_meta_t"), self.id_run)

    # models

    def _viable(self) -> list[int]:
        return sorted(r[0] for r in self.get("trans_meta_t").where("is_viable").select("id_trans").collect())

    def _training(self, trans_preds: DataFrame | None = None, trans_meta: DataFrame | None = None) -> tuple[DataFrame, dict[int, list[str]]]:
        """The rows of every viable transition for every run that has predictors of its own, in one plan a run, and each
        transition's features. Both tables hold a row a transition, or one a predictor of it."""
        preds = self.get("trans_preds_t") if trans_preds is None else trans_preds
        trans = (self.get("trans_meta_t") if trans_meta is None else trans_meta).where("is_viable")
        known = {r["id_trans"] for r in trans.select("id_trans").collect()}
        by_run: dict[int, dict[int, set[int]]] = {}
        for r in preds.select("id_run", "id_trans", "id_pred").distinct().collect():
            if r["id_trans"] in known:
                by_run.setdefault(r["id_run"], {}).setdefault(r["id_trans"], set()).add(r["id_pred"])
        if not by_run:
            raise ValueError("no viable transition has predictors")
        own = {t: sorted(set().union(*(run.get(t, set()) for run in by_run.values()))) for t in known}
        every = sorted(set().union(*own.values()))
        before, out = self.id_run, []
        try:
            for run in sorted(by_run):
                # Run 0 stands for the active one: predictors of the base hold for every run.
                self.id_run = before if run == 0 else run
                some = trans.where(F.col("id_trans").isin(list(by_run[run])))
                d = design.training_matrices(self.get("lulc_data_t"), self.get("pred_data_t"), self.get("periods_t"), some, every)
                out.append(d.withColumn("id_run", F.lit(self.id_run or 0)))
        finally:
            self.id_run = before
        return functools.reduce(DataFrame.unionByName, out), {t: [f"id_pred_{i}" for i in ids] for t, ids in own.items()}

    def fit_partial_models(self, learner: object, measures: Sequence[str] = ("classif.auc", "classif.acc"), sample_frac: float = 0.7, seed: int = 1, trans_preds: DataFrame | None = None, trans_meta: DataFrame | None = None) -> DataFrame:
        """Every viable transition's model on a stratified share of its rows, scored on the rest; stored and returned.
        All fits are groups of one job."""
        self.put("trans_models_t", models.fit_partial(*self._training(trans_preds, trans_meta), learner, measures, sample_frac, seed))
        return self.get("trans_models_t")

    def fit_spread_models(self, **options) -> DataFrame:
        """Trees or forests on all rows, each fit spread over the cluster: for matrices larger than a task."""
        self.put("trans_models_t", models.fit_spread(*self._training(), **options))
        return self.get("trans_models_t")

    def fit_full_models(self, learner: object | None = None, select_score: str | None = None, select_maximize: bool = True) -> DataFrame:
        """Models on all rows: of a learner, or of the best stored model of each transition."""
        if (learner is None) == (select_score is None):
            raise ValueError("give a learner or a score to select by")
        chosen = None if select_score is None else potential.best_models(self.get("trans_models_t"), select_score, select_maximize)
        rows, features = self._training()
        self.put("trans_models_t", models.fit_full(rows, features, chosen, learner))
        return self.get("trans_models_t")

    def get_pred_filter_score(self, kind: str, learner: object | None = None) -> DataFrame:
        return models.filter_scores(*self._training(), kind, learner)

    def get_crossval_predictions(self) -> DataFrame:
        """What stored models predicted of the rows that they were scored on."""
        return models.crossval_predictions(self.get("trans_models_t"))

    def get_crossval_scores(self) -> DataFrame:
        """(id_run, id_trans, learner_id, measure, score) of the stored models."""
        return self.get("trans_models_t").select("id_run", "id_trans", "learner_id", F.explode("crossval_score").alias("measure", "score")).withColumn("score", F.col("score").try_cast("double"))

    def predict_trans_pot(self, id_period_post: int, select_score: str, select_maximize: bool = True) -> int:
        """Potentials of all viable transitions into a period, from the best model of each."""
        held = self.get("trans_models_t").where("learner_full is not null")
        missing = sorted(r[0] for r in potential.missing_models(self.get("trans_meta_t"), held).collect())
        if missing:
            raise ValueError(f"transitions {missing} have no model")
        best = potential.best_models(held, select_score, select_maximize)
        best = best.groupBy("id_trans").agg(F.max_by("learner_full", "id_run").alias("learner_full"))
        trans = self.get("trans_meta_t").where("is_viable")
        known = {r["id_trans"]: r["id_preds"] for r in transitions.predictors_by_transition(self.get("trans_preds_t")).collect()}
        preds: dict[int, list[int]] = {t: known.get(t, []) for t in self._viable()}
        if not any(preds.values()):
            warnings.warn("no viable transition with predictors: no potentials", stacklevel=2)
            return 0
        rows = design.inference_matrices(self.get("lulc_data_t"), self.get("pred_data_t"), trans, preds, id_period_post - 1)
        found = models.predict(rows, {t: [f"id_pred_{i}" for i in own] for t, own in preds.items()}, best)
        found, settled = settle_at(found.withColumn("id_period_post", F.lit(id_period_post)), "potentials")
        try:
            has = {r[0] for r in found.select("id_trans").distinct().collect()}
            for t in sorted(preds.keys() - has):
                warnings.warn(f"no data for transition {t} in period {id_period_post}: it is skipped", stacklevel=2)
            return self.put("trans_pot_t", found) if has else 0
        finally:
            remove(self.spark, settled)

    # allocation

    def _cells(self) -> DataFrame:
        c = self.get("coords_t")
        edge = c.agg(F.min("lon").alias("x"), F.max("lat").alias("y"))
        resolution = self.metadata("coords_t").get("resolution")
        if resolution is None:
            raise ValueError("coords_t has no resolution among its attributes")
        return c.crossJoin(F.broadcast(edge)).select("id_coord", F.round((F.col("y") - F.col("lat")) / resolution).cast("int").alias("row"), F.round((F.col("lon") - F.col("x")) / resolution).cast("int").alias("col"))

    def alloc_patches(self, id_periods: Sequence[int], select_score: str, select_maximize: bool = True, area_kind: str = "lognormal", avoid: bool = True, batch_size: int = 0, seed: int = 0) -> None:
        """Simulates periods one after another for the active run: potentials, calibration, allocation,
        and the neighbour predictors of the new period."""
        known = [r[0] for r in self.get("periods_t").select("id_period").collect()]
        has_neighbors = self.exists("neighbors_t")
        run = F.lit(self.id_run or 0).alias("id_run")
        for period in build.check_periods(id_periods, known):
            self.predict_trans_pot(period, select_score, select_maximize)
            cells = self._cells().join(self.get("lulc_data_t").where(F.col("id_period") == period - 1).select("id_coord", "id_lulc"), "id_coord").select(run, "*")
            pot = self.adjusted_trans_pot_v(period).select(run, "id_trans", "id_coord", "value")
            rates = self.get("trans_rates_t").where(F.col("id_period") == period)
            par = self.alloc_params_patches_v().groupBy("id_trans").agg(*[F.max_by(c, "id_run").alias(c) for c in ("area_mean", "area_var", "elongation")])
            trans = allocate.transition_inputs(self.get("trans_meta_t").where("is_viable"), par, rates).select(run, "*")
            done = allocate.allocate_runs(cells, pot, trans, seed=seed * 1000 + period, area_kind=area_kind, avoid=avoid, batch_size=batch_size)
            self.put("lulc_data_t", done.where("id_lulc is not null").withColumn("id_period", F.lit(period)))
            if has_neighbors:
                self.upsert_new_neighbors(period)

    def create_alloc_params_t(self, n_perturbations: int = 5, sd: float = 0.05, seed: int = 1) -> DataFrame:
        """Parameters of every viable transition: means over the observed periods, and perturbed copies for further runs."""
        seen = self.get("periods_t").where("not is_extrapolated and id_period > 1").select("id_period")
        maps = self.trans_v.join(F.broadcast(seen), "id_period", "left_semi").join(self._cells(), "id_coord").select("id_period", "row", "col", F.col("id_lulc_anterior").alias("anterior"), F.col("id_lulc_posterior").alias("posterior"))
        means = patches.mean_params(patches.alloc_params_all(maps, self.get("trans_meta_t").where("is_viable"), "id_period"))
        runs = sorted(r[0] for r in self.read("runs_t").select("id_run").collect() if r[0] > 0)
        return patches.perturbed_params(means, n_perturbations, sd, seed, runs)

    def eval_alloc_params_t(self, runs: Sequence[int], id_periods: Sequence[int], select_score: str, window: int = 11, **options) -> DataFrame:
        """Simulates observed periods for each run and attaches to its parameters each transition's mean
        fuzzy similarity of simulated and observed change."""
        before, found = self.id_run, []
        # Kept apart, as the simulation rewrites the partitions that these rows come from.
        observed = settle(self.get("lulc_data_t").select("id_coord", "id_period", F.col("id_lulc").alias("obs")), "observed")
        size = self._cells().agg(F.max("row"), F.max("col")).first()
        try:
            for run in runs:
                self.id_run = run
                initial = settle(self.get("lulc_data_t").where(F.col("id_period") == id_periods[0] - 1).select("id_coord", F.col("id_lulc").alias("init")), "initial")
                self.alloc_patches(id_periods, select_score, **options)
                sim = self.read("lulc_data_t").where((F.col("id_run") == run) & (F.col("id_period") == id_periods[-1])).select("id_coord", F.col("id_lulc").alias("sim"))
                obs = observed.where(F.col("id_period") == id_periods[-1]).select("id_coord", "obs")
                maps = self._cells().join(initial, "id_coord").join(sim, "id_coord").join(obs, "id_coord")
                trans = self.get("trans_meta_t").where("is_viable")
                scored = validate.transition_similarities(maps, trans, size[0] + 1, size[1] + 1, window=window)
                found += [(run, r["id_trans"], r["similarity"]) for r in scored.select("id_trans", "similarity").collect()]
        finally:
            self.id_run = before
        scores = self.spark.createDataFrame(found, "id_run int, id_trans int, similarity double")
        return TABLES["alloc_params_t"].cast(self.read("alloc_params_t").drop("similarity").join(scores, ["id_run", "id_trans"]))

    # external allocator

    def export_external(self, id_period: int, folder: str) -> None:
        """The external allocator's inputs: CSV tables of rates and parameters, maps as Parquet of cells."""
        csv = lambda df, name: df.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}", header=True)  # noqa: E731 - tables of one row a transition
        csv(self.trans_rates_external_v(id_period), "trans_rates.csv")
        par = patches.export_params(self.get("alloc_params_t")).join(F.broadcast(self.get("trans_meta_t").where("is_viable")), "id_trans")
        pair = [F.col("id_lulc_anterior").alias("From*"), F.col("id_lulc_posterior").alias("To*")]
        csv(par.select(*pair, F.col("frac_expander").alias("Percent_Expander")), "expansion_table.csv")
        csv(par.select(*pair, F.col("mean_patch_size").alias("Mean_Patch_Size"), F.col("patch_size_variance").alias("Patch_Size_Variance"), F.col("patch_isometry").alias("Patch_Isometry")), "patcher_table.csv")
        self.lulc_data_as_rast(id_period - 1).drop("layer").write.mode("overwrite").parquet(f"{folder}/anterior")
        maps = self.adjusted_trans_pot_v(id_period).join(self._cells(), "id_coord").withColumn("layer", F.format_string("%03d_id_trans_%d", F.col("id_trans"), F.col("id_trans")))
        maps.select("layer", "row", "col", "value").write.mode("overwrite").partitionBy("layer").parquet(f"{folder}/probability")

    def alloc_external(self, id_periods: Sequence[int], select_score: str, folder: str, script: str | None = None, binary: str = "external-allocator", **console) -> None:
        """Periods through the external allocator: its inputs are exported, the text of ``script`` is written beside
        them with its code blocks encoded, and its console run (see :func:`.external.run_console`); the posterior map is
        read from the Parquet table posterior (row, col, value). If it isn't installed nothing changes in
        the period, with a warning. It runs on the driver, so ``folder`` must be a local one then."""
        known = [r[0] for r in self.get("periods_t").select("id_period").collect()]
        for period in build.check_periods(id_periods, known):
            self.predict_trans_pot(period, select_score)
            self.export_external(period, f"{folder}/{period}")
            result = f"{folder}/{period}/posterior"
            if shutil.which(binary) and script:
                at = external.local_folder(f"{folder}/{period}")
                with open(os.path.join(at, "allocation.script"), "w") as f:
                    f.write(external.recode_script(script))
                external.run_console(binary, "allocation.script", at, **console)
                done = self.spark.read.parquet(result).join(self._cells(), ["row", "col"]).select("id_coord", F.col("value").alias("id_lulc"))
            else:
                warnings.warn(f"{binary} isn't there: period {period} stays as the one before", stacklevel=2)
                done = self.get("lulc_data_t").where(F.col("id_period") == period - 1).select("id_coord", "id_lulc")
            self.put("lulc_data_t", done.select(F.lit(self.id_run or 0).alias("id_run"), "id_coord", "id_lulc", F.lit(period).alias("id_period")))


def summarise(df: DataFrame) -> DataFrame:
    """(n_rows, column, n_distinct, min, max) of every plain column."""
    plain = [n for n, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary"))]
    one = df.agg(F.count("*").alias("n_rows"), *[f(c).alias(f"{k}_{c}") for c in plain for k, f in (("n", F.count_distinct), ("min", F.min), ("max", F.max))])
    return one.select("n_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n_distinct"), F.col(f"min_{c}").cast("string").alias("min"), F.col(f"max_{c}").cast("string").alias("max")) for c in plain])).alias("s")).select("n_rows", "s.*")


def run_parallel(items: Iterable, worker: Callable, db: LandDatabase, threads: int = 4) -> list:
    """``worker(item, db)`` for each item, several Spark jobs at a time, each on a reading view of the database."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda item: worker(item, LandDatabase(db.spark, db.path, read_only=True, id_run=db.id_run)), items))

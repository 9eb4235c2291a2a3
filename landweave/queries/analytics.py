"""Queries over the panel: each operator in Spark, and what it must equal in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import allocate, build, models, neighbors, patches, potential, transitions, validate
from ..plans import design, lineage
from ..plans.database import summarise
from ..sources import raster
from ..sources.store import ParquetStore
from .panel import COLS, TRANS, Panel, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, panel: bool = True):
    """Registers a function of a :class:`Panel` as a query, with its SQL over the panel's tables."""

    def register(f: Callable[[Panel], DataFrame]) -> Callable[[Panel], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Panel(spark, sf_dir))
        if oracle is not None:
            ORACLE_SQL[name] = sql(oracle) if panel else oracle
        return f

    return register


def r8(c) -> F.Column:
    return F.round(c, 8)


# transitions and rates


@query("j1_transitions", "select * from trans")
def _(p: Panel) -> DataFrame:
    return transitions.transitions(p.lulc)


@query("a1_observed_rates", 'select cast(0 as integer) id_run, n.id_period, m.id_trans, cast(n.n as integer) "count", round(cast(n.n as double) / n.total, 8) rate from (select id_period, id_lulc_anterior, id_lulc_posterior, count(*) n, sum(count(*)) over (partition by id_period, id_lulc_anterior) total from trans group by 1, 2, 3) n join meta m using (id_lulc_anterior, id_lulc_posterior)')
def observed_rates(p: Panel) -> DataFrame:
    t = transitions.transitions(p.lulc)
    return transitions.observed_rates(t, transitions.transition_meta(t), 0).withColumn("rate", r8("rate"))


@query("a2_transition_meta", "select id_trans, id_lulc_anterior, id_lulc_posterior, cardinality, round(frequency_rel, 8) frequency_rel, round(frequency_abs, 8) frequency_abs, not ((cardinality < 700 and frequency_rel < 0.085) or id_lulc_posterior = 4) is_viable from meta")
def _(p: Panel) -> DataFrame:
    m = transitions.transition_meta(transitions.transitions(p.lulc), 700, 0.085, exclude_posterior=[4])
    return m.withColumns({c: r8(c) for c in ("frequency_rel", "frequency_abs")})


@query(
    "a3_extrapolated_rates",
    """, obs as (select n.id_period, m.id_trans, cast(n.n as double) / n.total rate from (select id_period, id_lulc_anterior, id_lulc_posterior, count(*) n, sum(count(*)) over (partition by id_period, id_lulc_anterior) total from trans group by 1, 2, 3) n join meta m using (id_lulc_anterior, id_lulc_posterior) where n.id_period <= 5 and (m.id_trans <> 2 or n.id_period = 2)),
fit as (select id_trans, coalesce(regr_slope(rate, id_period), 0) b, coalesce(regr_intercept(rate, id_period), avg(rate)) a, count(*) n, avg(rate) m from obs group by 1)
select cast(0 as integer) id_run, p.id_period, id_trans, cast(round_even(1000 * greatest(0, case when n = 1 then m else a + b * p.id_period end), 0) as integer) "count", round(greatest(0, case when n = 1 then m else a + b * p.id_period end), 8) rate from fit, periods p where p.is_extrapolated""",
)
def _(p: Panel) -> DataFrame:
    obs = _observed(p).where("id_period <= 5 and (id_trans <> 2 or id_period = 2)")
    return transitions.extrapolate_rates(obs, p.periods, 1000).withColumn("rate", r8("rate"))


def _observed(p: Panel) -> DataFrame:
    t = transitions.transitions(p.lulc)
    return transitions.observed_rates(t, transitions.transition_meta(t), 0)


@query("p3_rates_for_export", 'select m.id_lulc_anterior "From*", m.id_lulc_posterior "To*", round(cast(n.n as double) / n.total, 8) "Rate" from (select id_lulc_anterior, id_lulc_posterior, count(*) n, sum(count(*)) over (partition by id_lulc_anterior) total from trans where id_period = 3 group by 1, 2) n join meta m using (id_lulc_anterior, id_lulc_posterior) where cardinality >= 700')
def _(p: Panel) -> DataFrame:
    t = transitions.transitions(p.lulc)
    return transitions.rates_for_export(_observed(p), transitions.transition_meta(t, 700), 3).withColumn("Rate", r8("Rate"))


@query("u5_full_transition_predictors", "select cast(0 as integer) id_run, cast(id_pred as integer) id_pred, id_trans from (select unnest([1, 2, 3, 4]) id_pred), meta where cardinality >= 700")
def _(p: Panel) -> DataFrame:
    preds = p.spark.range(1, 5).select(F.col("id").alias("id_pred"))
    return transitions.full_transition_predictors(preds, transitions.transition_meta(transitions.transitions(p.lulc), 700))


@query("j13_recode", "select cast(o_orderkey as bigint) id, cast(o_custkey % 7 as integer) src_class, case when o_custkey % 7 in (1, 2, 3) then 1 when o_custkey % 7 = 4 then 2 else 3 end id_lulc from orders where o_custkey % 7 <> 0", panel=False)
def _(p: Panel) -> DataFrame:
    meta = build.lulc_meta(p.spark, {"forest": {"src_classes": [1, 2, 3]}, "urban": {"src_classes": [4]}, "agriculture": {"src_classes": [5, 6]}})
    samples = p.table("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).cast("int").alias("src_class"))
    return transitions.recode(samples, meta).select("id", "src_class", "id_lulc")


# calibration and models


@query("v1_adjusted_potentials", 'select id_trans, cast(id_period_post as integer) id_period_post, id_coord, round(case when t > 1 then v / t else v end, 8) "value" from (select *, sum(v) over (partition by id_coord) t from (select id_trans, id_period_post, id_coord, case when m > 0 then "value" * rate / m else 0 end v from (select *, avg("value") over (partition by id_trans) m from pot) join rates using (id_trans)))')
def _(p: Panel) -> DataFrame:
    return potential.adjusted_potentials(p.potentials, p.rates, 6).withColumn("value", r8("value"))


@query("w1_best_model", "select id_run, cast(id_trans as integer) id_trans, learner_id from (select *, row_number() over (partition by id_run, id_trans order by case when not gone then auc end desc nulls last, learner_id) rn from models) where rn = 1")
def _(p: Panel) -> DataFrame:
    return potential.best_models(p.models, "classif.auc").drop("crossval_score")


@query("q3_best_model_as_strings", "select id_run, cast(id_trans as integer) id_trans, learner_id from (select *, row_number() over (partition by id_run, id_trans order by case when not gone then cast(auc as varchar) end nulls last, learner_id) rn from models) where rn = 1")
def _(p: Panel) -> DataFrame:
    return potential.best_models(p.models, "classif.auc", maximize=False, numeric=False).drop("crossval_score")


@query("o5_top_predictors", "select id_trans, id_coord, round(\"value\", 8) \"value\", cast(rn as integer) rank from (select *, row_number() over (partition by id_trans order by \"value\" desc, id_coord) rn from pot) where rn <= 3")
def _(p: Panel) -> DataFrame:
    return potential.top_per_group(p.potentials, "id_trans", "value", 3, "id_coord").select("id_trans", "id_coord", r8("value").alias("value"), "rank")


@query("j8_missing_models", "select id_trans from meta where cardinality >= 700 and id_trans not in (1, 2, 3, 4)")
def _(p: Panel) -> DataFrame:
    return potential.missing_models(transitions.transition_meta(transitions.transitions(p.lulc), 700), p.models)


@query("m4_featureless", "select id_coord, id_lulc_anterior, id_lulc_posterior, round(avg(case when id_lulc_posterior <> id_lulc_anterior then 1.0 else 0.0 end) over (partition by id_lulc_anterior), 8) prior from trans where id_period = 2")
def _(p: Panel) -> DataFrame:
    t = transitions.transitions(p.lulc).where("id_period = 2")
    rows = t.select(F.lit(0).alias("id_run"), F.col("id_lulc_anterior").alias("id_trans"), "id_coord", "id_lulc_posterior", (F.col("id_lulc_posterior") != F.col("id_lulc_anterior")).alias("did_transition"))
    priors = models.predict(rows, [], models.fit_full(rows, [], learner=models.Featureless()))
    return rows.join(priors, ["id_trans", "id_coord"]).select("id_coord", F.col("id_trans").alias("id_lulc_anterior"), "id_lulc_posterior", r8("value").alias("prior"))


@query(
    "m5_auc",
    "select lang, round((r - p * (p + 1) / 2) / nullif(p * (t - p), 0), 8) auc from (select lang, sum(case when quality = 1 then rk else 0 end) r, cast(sum(quality) as double) p, cast(count(*) as double) t from (select lang, quality, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 rk from labels join documents using (doc_id)) group by 1)",
    panel=False,
)
def _(p: Panel) -> DataFrame:
    d = p.table("labels").join(p.table("documents"), "doc_id").select("lang", F.col("quality").alias("label"), F.col("n_chars").alias("score"))
    return models.auc_by(d, "lang").withColumn("auc", r8("auc"))


@query("m5_accuracy", "select lang, round(avg(case when (n_chars > 1000) = (quality = 1) then 1.0 else 0.0 end), 8) acc from labels join documents using (doc_id) group by 1", panel=False)
def _(p: Panel) -> DataFrame:
    d = p.table("labels").join(p.table("documents"), "doc_id").select("lang", (F.col("quality") == 1).alias("label"), (F.col("n_chars") > 1000).alias("predicted"))
    return models.accuracy_by(d, "lang").withColumn("acc", r8("acc"))


#: Predictors are pivoted once before they are joined.
_TRAINING = """select l.id_coord, l.id_period, l.did_transition, s.id_pred_1, s.id_pred_2, d.id_pred_3, d.id_pred_4
from (select id_coord, id_period - 1 id_period, id_lulc_posterior = 2 did_transition from trans where id_lulc_anterior = 1 and id_period - 1 < 5) l
left join (select id_coord, max("value") filter (where id_pred = 1) id_pred_1, max("value") filter (where id_pred = 2) id_pred_2 from pred where id_period = 0 group by 1) s on s.id_coord = l.id_coord
left join (select id_coord, id_period, max("value") filter (where id_pred = 3) id_pred_3, max("value") filter (where id_pred = 4) id_pred_4 from pred where id_period > 0 group by 1, 2) d on d.id_coord = l.id_coord and d.id_period = l.id_period"""


def _training(p: Panel) -> DataFrame:
    return design.training_matrix(p.lulc, p.pred_data, p.periods, 1, 2, [1, 2, 3, 4])


@query("d1_training_matrix", _TRAINING)
def _(p: Panel) -> DataFrame:
    return _training(p)


@query(
    "d1_training_matrices",
    """select m.id_trans, l.id_coord, l.id_period, l.post = m.id_lulc_posterior did_transition, s.id_pred_1, d.id_pred_4
from (select id_coord, id_period - 1 id_period, id_lulc_anterior ant, id_lulc_posterior post from trans where id_period - 1 < 5) l join meta m on m.id_lulc_anterior = l.ant and m.cardinality >= 700
left join (select id_coord, max("value") id_pred_1 from pred where id_period = 0 and id_pred = 1 group by 1) s on s.id_coord = l.id_coord
left join (select id_coord, id_period, max("value") id_pred_4 from pred where id_period > 0 and id_pred = 4 group by 1, 2) d on d.id_coord = l.id_coord and d.id_period = l.id_period""",
)
def _(p: Panel) -> DataFrame:
    meta = transitions.transition_meta(transitions.transitions(p.lulc), 700).where("is_viable")
    return design.training_matrices(p.lulc, p.pred_data, p.periods, meta, [1, 4])


@query(
    "d2_inference_matrices",
    """, v as (select id_coord, max(case when id_pred = 1 then "value" end) id_pred_1, max(case when id_pred = 3 then "value" end) id_pred_3 from pred where id_pred in (1, 3) and id_period in (0, 4) group by 1)
select t.id_trans, l.id_coord, v.id_pred_1, v.id_pred_3 from (select unnest([1, 2, 3]) id_trans, unnest([1, 1, 2]) ant) t join lulc l on l.id_lulc = t.ant and l.id_period = 4 join v using (id_coord)
where (t.id_trans = 1 and v.id_pred_1 is not null) or (t.id_trans = 2 and v.id_pred_3 is not null) or (t.id_trans = 3 and (v.id_pred_1 is not null or v.id_pred_3 is not null))""",
)
def _(p: Panel) -> DataFrame:
    trans = p.spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id_trans int, id_lulc_anterior int")
    return design.inference_matrices(p.lulc, p.pred_data, trans, {1: [1], 2: [3], 3: [1, 3]}, 4)


@query(
    "d2_inference_matrix",
    """select l.id_coord, max(case when id_pred = 1 then "value" end) id_pred_1, max(case when id_pred = 3 then "value" end) id_pred_3, max(case when id_pred = 4 then "value" end) id_pred_4
from (select id_coord from lulc where id_period = 4 and id_lulc = 2) l join (select * from pred where id_pred in (1, 3, 4) and id_period in (0, 4)) using (id_coord) group by 1""",
)
def _(p: Panel) -> DataFrame:
    return design.inference_matrix(p.lulc, p.pred_data, 2, [1, 3, 4], 4)


_META = [
    {"id_pred": 1, "data_type": "int", "fill_value": "-1", "factor_levels": None},
    {"id_pred": 2, "data_type": "float", "fill_value": None, "factor_levels": None},
    {"id_pred": 3, "data_type": "bool", "fill_value": "false", "factor_levels": None},
    {"id_pred": 4, "data_type": "factor", "fill_value": "none", "factor_levels": ["Sandy", "Loamy", "Clay", "Peaty", "Chalky"]},
]


@query("p9_typed_predictors", f"select id_coord, id_period, did_transition, coalesce(cast(id_pred_1 as integer), -1) id_pred_1, id_pred_2, coalesce(cast(id_pred_3 as boolean), false) id_pred_3, coalesce(list_extract(['Sandy', 'Loamy', 'Clay', 'Peaty', 'Chalky'], cast(id_pred_4 as integer)), 'none') id_pred_4 from ({_TRAINING})")
def _(p: Panel) -> DataFrame:
    return design.typed_predictors(_training(p), _META)


@query("m6_correlation", f"select 0 id_run, 1 id_trans, feature, round(abs(corr(x, cast(did_transition as integer))), 8) score from (select did_transition, unnest(['id_pred_1', 'id_pred_2', 'id_pred_3', 'id_pred_4']) feature, unnest([id_pred_1, id_pred_2, id_pred_3, id_pred_4]) x from ({_TRAINING})) group by feature")
def _(p: Panel) -> DataFrame:
    t = _training(p).withColumns({"id_run": F.lit(0), "id_trans": F.lit(1)})
    return models.filter_scores(t, [f"id_pred_{i}" for i in (1, 2, 3, 4)]).withColumn("score", r8("score"))


@query("a17_balanced_weights", "select id_coord, id_period, round(cast(count(*) over () as double) / (4 * count(*) over (partition by id_lulc)), 8) weight from lulc")
def _(p: Panel) -> DataFrame:
    return models.class_weights(p.lulc, "id_lulc").select("id_coord", "id_period", r8("weight").alias("weight"))


@query("m3_predict")
def _(p: Panel) -> DataFrame:
    t = _training(p).withColumns({"id_run": F.lit(0), "id_trans": F.lit(1)})
    names = [f"id_pred_{i}" for i in (1, 2, 3, 4)]
    full = models.fit_full(t, names, learner=models.Featureless())
    rows = design.inference_matrix(p.lulc, p.pred_data, 1, [1, 2, 3, 4], 5).withColumn("id_trans", F.lit(1))
    return models.predict(rows, names, full).withColumn("value", r8("value"))


ORACLE_SQL["m3_predict"] = sql(f"select 1 id_trans, id_coord, round((select avg(cast(did_transition as integer)) from ({_TRAINING})), 8) \"value\" from (select id_coord from lulc where id_period = 5 and id_lulc = 1)")


# neighbours

_PAIRS = "select a.id_coord id_coord_origin, b.id_coord id_coord_neighbor, sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) distance from coords a join coords b on a.id_coord <> b.id_coord and a.\"row\" between b.\"row\" - 3 and b.\"row\" + 3 and a.col between b.col - 3 and b.col + 3 and (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) <= 300 * 300"
_BREAKS = [0.0, 100.0, 200.0, 300.0]
_CLASS = "case when distance >= 0 and distance < 100 then '[0,100)' when distance < 200 then '[100,200)' when distance <= 300 then '[200,300]' end"


@query("j10_neighbors", f"select id_coord_origin, id_coord_neighbor, round(distance, 8) distance, {_CLASS} distance_class from ({_PAIRS})")
def _(p: Panel) -> DataFrame:
    return neighbors.neighbor_pairs(p.coords, 300, _BREAKS).withColumn("distance", r8("distance"))


def _neighbor_setup(p: Panel) -> tuple[DataFrame, DataFrame]:
    pairs = neighbors.neighbor_pairs(p.coords, 300, _BREAKS)
    names = p.spark.createDataFrame([(i, n) for i, n in enumerate(("forest", "urban", "agriculture", "static"), 1)], "id_lulc int, name string")
    classes = p.spark.createDataFrame([("[100,200)",), ("[200,300]",)], "distance_class string")
    return pairs, neighbors.predictor_meta(names, classes, 5)


@query("a4_neighbor_predictors", "select cast(4 + row_number() over (order by id_lulc, dc) as integer) id_pred, 'id_lulc_' || id_lulc || '_dist_' || dc \"name\", 'int' data_type, '0' fill_value from (select unnest([1, 2, 3, 4]) id_lulc), (select unnest(['[100,200)', '[200,300]']) dc)")
def _(p: Panel) -> DataFrame:
    return _neighbor_setup(p)[1].select("id_pred", "name", "data_type", "fill_value")


@query("a5_neighbor_counts", f"select cast(0 as integer) id_run, l.id_period, cast(4 + (l.id_lulc - 1) * 2 + case when distance < 200 then 1 else 2 end as integer) id_pred, id_coord_origin id_coord, cast(count(*) as double) \"value\" from ({_PAIRS}) n join lulc l on l.id_coord = n.id_coord_neighbor and l.id_period = 5 group by 2, 3, 4")
def _(p: Panel) -> DataFrame:
    pairs, meta = _neighbor_setup(p)
    return neighbors.neighbor_counts(pairs, p.lulc.where("id_period = 5"), neighbors.parse_predictor_names(meta), 0)


# lineage


@query("l1_lineage", "with recursive r as (select r_regionkey id_run, case when r_regionkey > 0 then (r_regionkey - 1) // 2 end p from region), l as (select id_run, p, 1 d from r where id_run = 3 union all select r.id_run, r.p, d + 1 from l join r on r.id_run = l.p) select cast(id_run as integer) id_run, cast(d as integer) distance from l", panel=False)
def _(p: Panel) -> DataFrame:
    return p.spark.createDataFrame([(i, d) for d, i in enumerate(lineage.lineage(p.runs, 3), 1)], "id_run int, distance int")


@query("l5_visible_slices", "select o.* from over o join (select id_period, max(id_run) id_run from over where id_run in (3, 1, 0) group by 1) using (id_period, id_run)")
def _(p: Panel) -> DataFrame:
    return lineage.visible(p.overrides, lineage.lineage(p.runs, 3))


@query("l4_single_run", "select * from over where id_run = 0")
def _(p: Panel) -> DataFrame:
    return lineage.visible(p.overrides, [0])


@query("l6_unshadowed", "select id_run, cast(id_trans as integer) id_trans, learner_id from models where id_run in (3, 1, 0)")
def _(p: Panel) -> DataFrame:
    return lineage.visible(p.models, lineage.lineage(p.runs, 3)).drop("crossval_score")


@query("l6_shadowed", "select id_run, cast(id_trans as integer) id_trans, learner_id from models where id_run = 3")
def _(p: Panel) -> DataFrame:
    return lineage.visible(p.models, lineage.lineage(p.runs, 3), shadow=True).drop("crossval_score")


@query(
    "l8_predictor_presence",
    """, has as (select distinct r.id_run, pr.id_period, pr.id_pred from pred pr, runs r where r.id_run = 0 or (r.id_run = 1 and pr.id_period = 3 and pr.id_pred = 3) or (r.id_run = 3 and pr.id_period = 0 and pr.id_pred = 1)),
line as (select unnest([3, 1, 0]) id_run, unnest([0, 1, 2]) distance),
g as (select l.id_run, l.distance, p.id_period, m.id_pred, 'pred' || m.id_pred "name", h.id_run is not null hd, s.id_run is not null hs from line l, periods p, (select unnest([1, 2, 3, 4]) id_pred) m
 left join has h on h.id_run = l.id_run and h.id_period = p.id_period and h.id_pred = m.id_pred left join has s on s.id_run = l.id_run and s.id_period = 0 and s.id_pred = m.id_pred)
select cast(id_run as integer) id_run, cast(distance as integer) distance, id_period, cast(id_pred as integer) id_pred, "name", hd has_dynamic, hs has_static, bool_or(hd) over (partition by id_period, id_pred) dynamic_in_line, bool_or(hs) over (partition by id_period, id_pred) static_in_line,
 bool_or(hd) over (partition by id_pred) in_any_period, bool_or(hd or hs) over (partition by id_period, id_pred) available from g""",
)
def _(p: Panel) -> DataFrame:
    meta = p.spark.createDataFrame([(i, f"pred{i}") for i in (1, 2, 3, 4)], "id_pred int, name string")
    data = p.pred_data.crossJoin(F.broadcast(p.runs.select("id_run"))).where("id_run = 0 or (id_run = 1 and id_period = 3 and id_pred = 3) or (id_run = 3 and id_period = 0 and id_pred = 1)")
    return lineage.predictor_presence(p.runs, p.periods, meta, data, 3)


# constructors, projections, scalar functions


@query("p2_extent", "select min(lon) xmin, max(lon) xmax, min(lat) ymin, max(lat) ymax from coords")
def _(p: Panel) -> DataFrame:
    return build.extent(p.coords)


@query("p1_coords_minimal", "select id_coord, lon, lat from coords")
def _(p: Panel) -> DataFrame:
    return build.coords_minimal(p.coords)


@query("p5_square_grid", "select cast(i + 1 as integer) id_coord, 2697000.0::double + (i % 30 + 0.5::double) * 100 lon, 1255000.0::double - (i // 30 + 0.5::double) * 100 lat from range(900) t(i)", panel=False)
def _(p: Panel) -> DataFrame:
    return build.square_grid(p.spark, (2697000, 2700000, 1252000, 1255000), 100).select("id_coord", "lon", "lat")


@query(
    "p6_periods",
    "select id_period, cast(start_date as varchar) start_date, cast(end_date as varchar) end_date, is_extrapolated from (values (0, date '2005-01-01', date '2005-01-01', false), (1, date '1985-01-01', date '1994-12-31', false), (2, date '1995-01-01', date '2004-12-31', false), (3, date '2005-01-01', date '2014-12-31', false), (4, date '2015-01-01', date '2015-01-01', true)) t(id_period, start_date, end_date, is_extrapolated)",
    panel=False,
)
def _(p: Panel) -> DataFrame:
    d = build.periods(p.spark, "P10Y", "1985-01-01", "2005-01-01", "2015-01-01")
    return d.withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


@query("p7_lulc_meta_long", "select * from (values (1, 'forest', 1), (1, 'forest', 2), (1, 'forest', 3), (2, 'urban', 4), (3, 'agriculture', 5), (3, 'agriculture', 6)) t(id_lulc, \"name\", src_class)", panel=False)
def _(p: Panel) -> DataFrame:
    meta = build.lulc_meta(p.spark, {"forest": {"src_classes": [1, 2, 3]}, "urban": {"src_classes": [4]}, "agriculture": {"src_classes": [5, 6]}, "static": {}})
    return build.unnest(meta, "src_classes", "id_lulc", "name").withColumnRenamed("src_classes", "src_class")


@query("p7_pred_sources", "select * from (values (1, 'https://example.com/a', 'x1'), (1, 'https://example.com/b', 'x2')) t(id_pred, url, md5sum)", panel=False)
def _(p: Panel) -> DataFrame:
    spec = {"noise": {"data_type": "float", "sources": [{"url": "https://example.com/a", "md5sum": "x1"}, {"url": "https://example.com/b", "md5sum": "x2"}]}, "index": {"data_type": "int"}}
    return build.unnest(build.pred_meta(p.spark, spec), "sources", "id_pred")


@query(
    "p10_isometry",
    "with k as (select i, e0, y0, lead(e0) over (order by i) e1, lead(y0) over (order by i) y1 from (values (1, 0.17::double, 2.0::double), (2, 0.171, 1.5), (3, 0.172, 1.2), (4, 0.32, 1.0), (5, 0.328, 0.75), (6, 0.333, 0.5), (7, 0.334, 0.25), (8, 0.34, 0.0)) t(i, e0, y0)), x as (select cast(o_orderkey as bigint) id, cast(o_custkey % 500 as double) / 1000 e from orders) select id, round(case when e < 0.17 then 2.0 when e > 0.34 then 0.0 else (select y0 + (e - e0) * (y1 - y0) / (e1 - e0) from k where e <= e1 and (e > e0 or (i = 1 and e >= e0))) end, 8) isometry from x",
    panel=False,
)
def _(p: Panel) -> DataFrame:
    e = (F.col("o_custkey") % 500).cast("double") / 1000
    return p.table("orders").select(F.col("o_orderkey").alias("id"), r8(patches.isometry(e)).alias("isometry"))


@query("p11_change_map", "select a.id_coord, case when a.id_lulc = 1 and b.id_lulc = 2 then 1 end specific, case when a.id_lulc <> b.id_lulc then b.id_lulc end general from lulc a join lulc b on a.id_coord = b.id_coord and a.id_period = 1 and b.id_period = 5")
def _(p: Panel) -> DataFrame:
    d = _two_maps(p)
    a = validate.change_map(d, 1, 2).select("id_coord", F.col("change").alias("specific"))
    return a.join(validate.change_map(d).select("id_coord", F.col("change").alias("general")), "id_coord")


def _two_maps(p: Panel, first: int = 1, last: int = 5) -> DataFrame:
    a = p.lulc.where(F.col("id_period") == first).select("id_coord", F.col("id_lulc").alias("init"))
    return a.join(p.lulc.where(F.col("id_period") == last).select("id_coord", F.col("id_lulc").alias("final")), "id_coord")


@query("p13_export_params", "select cast(p_partkey as integer) id, greatest(1e-6::double, least(1 - 1e-6::double, cast(p_size - 1 as double) / 49)) frac_expander, case when p_partkey % 3 = 0 then 1.0::double else p_retailprice end mean_patch_size, case when p_partkey % 4 = 0 then 0.0::double else 2.0::double end patch_size_variance, case when p_partkey % 5 = 0 then 1.0::double else 0.5::double end patch_isometry from part", panel=False)
def _(p: Panel) -> DataFrame:
    k = F.col("p_partkey")
    d = p.table("part").select(k.cast("int").alias("id"), ((F.col("p_size") - 1).cast("double") / 49).alias("frac_expander"), F.when(k % 3 != 0, F.col("p_retailprice")).alias("mean_patch_size"), F.when(k % 4 != 0, 2.0).alias("patch_size_variance"), F.when(k % 5 != 0, 0.5).alias("patch_isometry"))
    return patches.export_params(d)


@query("f1_distance_classes", "select cast(o_orderkey as bigint) id, case when d >= 0 and d < 100 then '[0,100)' when d >= 100 and d < 500 then '[100,500)' when d >= 500 and d <= 1000 then '[500,1e+03]' end distance_class from (select o_orderkey, cast(o_custkey % 1200 as double) d from orders)", panel=False)
def _(p: Panel) -> DataFrame:
    return p.table("orders").select(F.col("o_orderkey").alias("id"), scalar.cut((F.col("o_custkey") % 1200).cast("double"), list(neighbors.BREAKS)).alias("distance_class"))


@query("f2_concat_nulls", "select cast(o_orderkey as bigint) id, concat('a', case when o_custkey % 2 = 0 then o_orderstatus end, 'z') s from orders", panel=False)
def _(p: Panel) -> DataFrame:
    return p.table("orders").select(F.col("o_orderkey").alias("id"), scalar.concat_skipping_nulls(F.lit("a"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")), F.lit("z")).alias("s"))


# patches, rasters, validation


@query(
    "a13_elongation",
    """select id_lulc, cast(n as bigint) n, round(case when n <= 1 or a + b <= 0 then 0 else 1 - sqrt(greatest(0, (a + b) / 2 - sqrt(greatest(0, (a - b) * (a - b) / 4 + d * d))) / ((a + b) / 2 + sqrt(greatest(0, (a - b) * (a - b) / 4 + d * d)))) end, 6) elongation
from (select id_lulc, n, rr / n - (r / n) * (r / n) a, cc / n - (c / n) * (c / n) b, rc / n - (r / n) * (c / n) d from (select id_lulc, cast(count(*) as double) n, sum(cast("row" as double)) r, sum(cast(col as double)) c, sum(cast("row" * "row" as double)) rr, sum(cast(col * col as double)) cc, sum(cast("row" * col as double)) rc from lulc join coords using (id_coord) where id_period = 1 group by 1))""",
)
def _(p: Panel) -> DataFrame:
    d = p.lulc.where("id_period = 1").join(p.coords, "id_coord")
    r, c = F.col("row").cast("double"), F.col("col").cast("double")
    s = d.groupBy("id_lulc").agg(F.count("*").cast("double").alias("n"), F.sum(r).alias("r"), F.sum(c).alias("c"), F.sum(r * r).alias("rr"), F.sum(c * c).alias("cc"), F.sum(r * c).alias("rc"))
    return s.select("id_lulc", F.col("n").cast("long").alias("n"), F.round(patches.elongation(*(F.col(x) for x in ("n", "r", "c", "rr", "cc", "rc"))), 6).alias("elongation"))


def _maps(p: Panel) -> DataFrame:
    return _two_maps(p).select("id_coord", F.col("init").alias("anterior"), F.col("final").alias("posterior")).join(p.coords, "id_coord")


@query(
    "a14_expanders",
    """, m as (select c."row", c.col, a.id_lulc ant, b.id_lulc post from lulc a join lulc b on a.id_coord = b.id_coord and a.id_period = 1 and b.id_period = 5 join coords c on c.id_coord = a.id_coord),
t as (select *, ant = 1 and post = 2 tr from m)
select t."row", t.col, case when sum(cast(n.ant = 2 as integer)) >= 1 then 'expander' when sum(cast(n.ant = 2 as integer)) = 0 then 'patcher' end kind from t left join t n on n."row" between t."row" - 1 and t."row" + 1 and n.col between t.col - 1 and t.col + 1 and not n.tr where t.tr group by 1, 2""",
)
def _(p: Panel) -> DataFrame:
    return patches.classify_cells(_maps(p), 1, 2)


@query("a12_class_stats")
def _(p: Panel) -> DataFrame:
    cells = p.lulc.where("id_period = 1").join(p.coords, "id_coord").select("row", "col", F.col("id_lulc").alias("value"))
    stats = patches.class_stats(patches.patches(cells, tile=16))
    return stats.select("value", "patch_count", *[F.round(c, 6).alias(c) for c in ("patch_area_mean", "patch_area_variance", "patch_elongation_mean")])


#: Of cells (r, c, v, k: number) the component of each (l: its smallest number), by labels that sink along all
#: edges until none sinks further, and statistics of the components as a12 has them.
LABELS = """edges as materialized (select a.k a, b.k b from cells a join (select cells.*, i, j from cells, (select unnest([-1, 0, 1]) i), (select unnest([-1, 0, 1]) j)) b on a.v = b.v and a.r = b.r + b.i and a.c = b.c + b.j),
sink(k, l, step, moved) as (select k, k, 0, true from cells
  union all select k, n, step + 1, bool_or(n < l) over () from (select s.k, s.l, min(t.l) n, s.step from sink s join edges e on e.a = s.k join sink t on t.k = e.b where s.moved group by s.k, s.l, s.step)),
lab as (select cells.*, m.l from cells join (select k, min(l) l from sink group by 1) m using (k)),
parts as (select v, l, n, case when n <= 1 or a + b <= 0 then 0 else 1 - sqrt(greatest(0, (a + b) / 2 - sqrt(greatest(0, (a - b) * (a - b) / 4 + d * d))) / ((a + b) / 2 + sqrt(greatest(0, (a - b) * (a - b) / 4 + d * d)))) end e
  from (select v, l, n, rr / n - (r / n) * (r / n) a, cc / n - (c / n) * (c / n) b, rc / n - (r / n) * (c / n) d from (select v, l, cast(count(*) as double) n, sum(cast(r as double)) r, sum(cast(c as double)) c, sum(cast(r * r as double)) rr, sum(cast(c * c as double)) cc, sum(cast(r * c as double)) rc from lab group by v, l)))"""


def recursive(text: str) -> str:
    return sql(text).replace("with coords", "with recursive coords", 1)


ORACLE_SQL["a12_class_stats"] = recursive(
    f""", cells as materialized (select "row" r, col c, id_lulc v, id_coord k from lulc join coords using (id_coord) where id_period = 1),
{LABELS}
select v "value", cast(count(*) as integer) patch_count, round(avg(n), 6) patch_area_mean, round(case when count(*) > 1 then var_samp(n) end, 6) patch_area_variance, round(avg(e), 6) patch_elongation_mean from parts group by v"""
)


#: Similarities of two maps m (r, c, va, vb; null: no class) both ways at window W, by cell.
SIMILARITY = """e as (select max(r) mr, max(c) mc from m),
o as (select x.i, y.j, exp(-sqrt(cast(x.i * x.i + y.j * y.j as double)) / 2) w from range(-{h}, {h} + 1) x(i), range(-{h}, {h} + 1) y(j)),
seen as (select t.r, t.c, t.w, s.va, s.vb from (select m.r, m.c, o.w, greatest(0, least(e.mr, m.r + o.i)) tr, greatest(0, least(e.mc, m.c + o.j)) tc from m, o, e) t join m s on s.r = t.tr and s.c = t.tc),
whole as (select r, c, sum(w) total, bool_or(va is null or vb is null) gap from seen group by 1, 2),
fa as (select r, c, va cat, sum(w) f from seen where va is not null group by 1, 2, 3),
fb as (select r, c, vb cat, sum(w) f from seen where vb is not null group by 1, 2, 3),
shared as (select r, c, sum(least(fa.f, fb.f)) f from fa join fb using (r, c, cat) group by 1, 2),
s as (select r, c, case when not gap then coalesce(f, 0) / total end s from whole left join shared using (r, c)),
both_ways as (select m.r, m.c, case when m.va is not null then s end sim_a, case when m.vb is not null then s end sim_b from m join s using (r, c))"""
_TWO = """, m as (select c."row" r, c.col c, a.id_lulc va, b.id_lulc vb from coords c left join (select * from lulc where id_period = 1) a using (id_coord) left join (select * from lulc where id_period = 2) b using (id_coord)),
"""


def _two_with_gaps(p: Panel) -> tuple[DataFrame, int]:
    d = p.coords.select("id_coord", "row", "col")
    for name, period in (("a", 1), ("b", 2)):
        d = d.join(p.lulc.where(F.col("id_period") == period).select("id_coord", F.col("id_lulc").alias(name)), "id_coord", "left")
    return d, p.n_rows


@query("r2_fuzzy_cells", _TWO + SIMILARITY.format(h=1) + ' select r "row", c col, round(sim_a, 8) sim_a, round(sim_b, 8) sim_b from both_ways')
def _(p: Panel) -> DataFrame:
    d, n_rows = _two_with_gaps(p)
    return validate.similarity_cells(d, n_rows, COLS, window=3, tile=16).select("row", "col", *[r8(c).alias(c) for c in ("sim_a", "sim_b")])


@query("r2_fuzzy_similarity", _TWO + SIMILARITY.format(h=5) + " select round(avg(sim_a), 8) mean_a, round(avg(sim_b), 8) mean_b, round(least(avg(sim_a), avg(sim_b)), 8) similarity from both_ways")
def _(p: Panel) -> DataFrame:
    """At the default window; gaps don't count."""
    d, n_rows = _two_with_gaps(p)
    return validate.fuzzy_similarity(d.where("a is not null or b is not null"), n_rows, COLS, tile=16).select(*[r8(c).alias(c) for c in ("mean_a", "mean_b", "similarity")])


@query("r2_gaps_that_count", _TWO + SIMILARITY.format(h=1) + " select case when count(sim_a) = count(*) then avg(sim_a) end mean_a, case when count(sim_b) = count(*) then avg(sim_b) end mean_b from both_ways")
def _(p: Panel) -> DataFrame:
    d, n_rows = _two_with_gaps(p)
    return validate.fuzzy_similarity(d, n_rows, COLS, window=3, ignore_na=False).select("mean_a", "mean_b")


@query("r4_weight_matrix", "select cast(x.i as integer) \"row\", cast(y.j as integer) col, round(exp(-sqrt(cast((x.i - 5) * (x.i - 5) + (y.j - 5) * (y.j - 5) as double)) / 2), 8) weight from range(11) x(i), range(11) y(j)", panel=False)
def _(p: Panel) -> DataFrame:
    w = validate.weights(11)
    return p.spark.createDataFrame([(i, j, float(np.round(w[i, j], 8))) for i in range(11) for j in range(11)], "row int, col int, weight double")


@query("r5_rook_neighbors", ', e as (select max("row") last from coords) select cast(id_coord + 1 as integer) cell, cast(case when "row" > 0 then id_coord + 1 - 50 else 0 end as integer) "up", cast(case when "row" < last then id_coord + 1 + 50 else 0 end as integer) down, cast(case when col > 0 then id_coord else 0 end as integer) "left", cast(case when col < 49 then id_coord + 2 else 0 end as integer) "right" from coords, e')
def _(p: Panel) -> DataFrame:
    return allocate.rook_table(p.coords.select((F.col("id_coord") + 1).alias("cell")), p.n_rows, COLS)


@query(
    "r6_multinomial",
    "select id_coord cell, cast(coalesce(min(case when u < cum then id_trans end), max(id_trans)) as integer) state from (select id_coord, id_trans, sum(\"value\" / 2) over (partition by id_coord order by id_trans rows unbounded preceding) cum, cast((id_coord * 7919) % 1000 as double) / 1000 u from pot) group by 1",
)
def _(p: Panel) -> DataFrame:
    pot = p.potentials.select(F.col("id_coord").alias("cell"), F.col("id_trans").alias("state"), (F.col("value") / 2).alias("p"))
    u = p.coords.select(F.col("id_coord").alias("cell"), (F.expr("(cast(id_coord as bigint) * 7919) % 1000").cast("double") / 1000).alias("u"))
    return allocate.multinomial_states(pot, u)


@query("a16_ensemble", "with s as (select cast(l_suppkey as integer) id_run, cast(l_partkey as integer) id_coord, cast(l_linenumber % 4 + 1 as integer) id_lulc from lineitem), n as (select id_coord, id_lulc, count(*) n from s group by 1, 2), m as (select id_coord, id_lulc mode_lulc, sum(n) over (partition by id_coord) n_runs, row_number() over (partition by id_coord order by n desc, id_lulc) rn from n) select m.id_coord, cast(m.id_coord % 4 + 1 as integer) first_lulc, cast(n_runs as bigint) n_runs, cast(c.n as bigint) n_changed, round(cast(c.n as double) / n_runs, 8) p_changed, mode_lulc from m join (select id_coord, count(*) filter (where id_lulc <> id_coord % 4 + 1) n from s group by 1) c using (id_coord) where rn = 1", panel=False)
def _(p: Panel) -> DataFrame:
    s = p.table("lineitem").select(F.col("l_suppkey").cast("int").alias("id_run"), F.col("l_partkey").cast("int").alias("id_coord"), (F.col("l_linenumber") % 4 + 1).cast("int").alias("id_lulc"))
    first = p.coords.select("id_coord", (F.col("id_coord") % 4 + 1).alias("id_lulc"))
    return validate.ensemble_summary(s, first).withColumn("p_changed", r8("p_changed"))


@query("r9_allocate")
def _(p: Panel) -> DataFrame:
    every = lambda d: d.withColumn("id_run", F.explode(F.array(*map(F.lit, range(4)))))
    cells = every(p.lulc.where("id_period = 5").join(p.coords, "id_coord"))
    trans = p.spark.createDataFrame([(t, a, b, 4.0, 2.0, 0.5, 0.1) for t, a, b in TRANS], "id_trans int, id_lulc_anterior int, id_lulc_posterior int, area_mean double, area_var double, elongation double, rate double")
    return allocate.allocate_runs(cells, every(p.potentials), every(trans), seed=7)


# storage


def _store(p: Panel) -> ParquetStore:
    return ParquetStore(p.spark, p.folder("store"))


@query("s13_upsert", "select 0 id_run, id_coord, case when id_coord % 10 = 0 and id_period = 2 then 9 else id_lulc end id_lulc, id_period from lulc where id_period in (1, 2) union all select 0, cast(100000 + id_coord as integer), 9, 2 from coords where id_coord < 5")
def _(p: Panel) -> DataFrame:
    """The added cells' ids are the panel's as well where it has more than 100,000 cells, so whether a row is added is one of the keys."""
    s = _store(p)
    base = p.lulc.where("id_period in (1, 2)").withColumns({"id_run": F.lit(0), "is_added": F.lit(False)})
    s.commit(base, "lulc", "overwrite", keys=["id_run", "id_coord", "id_period", "is_added"], partitions=["id_period"])
    added = p.coords.where("id_coord < 5").select((F.col("id_coord") + 100000).alias("id_coord"), F.lit(2).alias("id_period"), F.lit(9).alias("id_lulc"), F.lit(0).alias("id_run"), F.lit(True).alias("is_added"))
    s.commit(base.where("id_coord % 10 = 0 and id_period = 2").withColumn("id_lulc", F.lit(9)).unionByName(added), "lulc", "upsert")
    return s.read("lulc").select("id_run", "id_coord", "id_lulc", "id_period")


@query("s12_append_by_name", "select id_coord, id_lulc, cast(null as varchar) note from lulc where id_period = 1 union all select id_coord, null, 'new' from coords where id_coord < 7")
def _(p: Panel) -> DataFrame:
    s = _store(p)
    s.commit(p.lulc.where("id_period = 1").select("id_coord", "id_lulc"), "t")
    s.commit(p.coords.where("id_coord < 7").select("id_coord", F.lit("new").alias("note")), "t", "append")
    return s.read("t").select("id_coord", "id_lulc", "note")


@query("s9_delete", "select id_coord, id_period, id_lulc from lulc where id_period in (1, 2) and not (id_lulc = 3 or case when id_coord % 11 = 0 then null else false end)")
def _(p: Panel) -> DataFrame:
    s = _store(p)
    s.commit(p.lulc.where("id_period in (1, 2)"), "lulc", keys=["id_coord", "id_period"], partitions=["id_period"])
    s.delete_from("lulc", "id_lulc = 3 or case when id_coord % 11 = 0 then null else false end")
    return s.read("lulc").select("id_coord", "id_period", "id_lulc")


@query("s6_fetch", "select id_coord, id_lulc from lulc where id_period = 2 and id_lulc > 2")
def _(p: Panel) -> DataFrame:
    s = _store(p)
    s.commit(p.lulc, "lulc", partitions=["id_period"])
    return s.fetch("lulc", ["id_coord", "id_lulc"], "id_period = 2 and id_lulc > 2")


@query("s8_sql", "select id_period, id_lulc, count(*) n from lulc group by 1, 2")
def _(p: Panel) -> DataFrame:
    s = _store(p)
    s.commit(p.lulc, "lulc_data")
    return s.query("select id_period, id_lulc, count(*) n from lulc_data group by 1, 2")


@query("s4_counts", "select count(*) row_count, max(id_coord) column_max from lulc")
def _(p: Panel) -> DataFrame:
    s = _store(p)
    s.commit(p.lulc, "lulc")
    return p.spark.createDataFrame([(s.row_count("lulc"), s.column_max("lulc", "id_coord"))], "row_count long, column_max int")


@query("s21_extract_raster", "select cast(c_custkey as integer) id_coord, l.layer, cast((c_custkey % 50) * 10 + (c_custkey // 50 % 40) as double) * l.k \"value\" from customer, (select unnest(['a', 'b']) layer, unnest([1, 2]) k) l where c_custkey < 1500", panel=False)
def _(p: Panel) -> DataFrame:
    cells = p.spark.range(2000).select(F.floor(F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col"))
    layers = p.spark.createDataFrame([("a", 1), ("b", 2)], "layer string, k int")
    grid = cells.crossJoin(layers).select("row", "col", "layer", ((F.col("col") * 10 + F.col("row")).cast("double") * F.col("k")).alias("value"))
    k = F.col("c_custkey")
    points = p.table("customer").where("c_custkey < 1500").select(k.cast("int").alias("id_coord"), ((k % 50) * 100.0 + 37).alias("lon"), (-(F.floor(k / 50) % 40) * 100.0 - 61).alias("lat"))
    return raster.extract_raster(grid, points, 0, 0, 100)


@query("s21_extract_polygons", "select c.id_coord, cast(p.i as integer) id, 'zone' \"attribute\", 'z' || p.i \"value\" from coords c, range(6) p(i) where c.lon > p.i * 700 and c.lon < p.i * 700 + 1000 and -c.lat > p.i * 300 and -c.lat < p.i * 300 + 900")
def _(p: Panel) -> DataFrame:
    i = F.col("id")
    x0, y0 = i * 700.0, -(i * 300.0)
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x0 + 1000.0, y0), (x0 + 1000.0, y0 - 900.0), (x0, y0 - 900.0))])
    polygons = p.spark.range(6).select(i.cast("int").alias("id"), F.concat(F.lit("z"), i.cast("string")).alias("zone"), ring.alias("ring"))
    return raster.extract_polygons(polygons, p.coords, ["zone"], 1000.0)


@query("s22_tabular_to_raster", "select 'id_period_' || id_period layer, \"row\", col, id_lulc \"value\" from lulc join coords using (id_coord) where id_period in (1, 2)")
def _(p: Panel) -> DataFrame:
    return raster.tabular_to_raster(p.lulc.where("id_period in (1, 2)"), p.coords, "id_lulc", 100)


@query("s26_summary", """select n_rows, "column", n_distinct, "min", "max" from (select count(*) n_rows, unnest(['id_coord', 'id_period', 'id_lulc']) "column", unnest([count(distinct id_coord), count(distinct id_period), count(distinct id_lulc)]) n_distinct,
 unnest([cast(min(id_coord) as varchar), cast(min(id_period) as varchar), cast(min(id_lulc) as varchar)]) "min", unnest([cast(max(id_coord) as varchar), cast(max(id_period) as varchar), cast(max(id_lulc) as varchar)]) "max" from lulc)""")
def _(p: Panel) -> DataFrame:
    return summarise(p.lulc.select("id_coord", "id_period", "id_lulc"))


@query("w2_observed_before_last", "select id_period from periods where not is_extrapolated and id_period < 5")
def _(p: Panel) -> DataFrame:
    return design.observed_before_last(p.periods)

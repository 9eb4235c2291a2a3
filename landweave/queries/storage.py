"""More queries: storage, lineage, constructors and the relational primitives behind the domain's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import allocate, build, models, patches, potential, transitions, validate
from ..plans import design, lineage
from ..plans.database import LandDatabase
from ..schemas import TABLES
from ..sources.folders import settle
from ..sources.store import concat
from .analytics import _PAIRS, _TRAINING, LABELS, ORACLE_SQL, SIMILARITY, _maps, _observed, _store, _training, _two_maps, query, r8, recursive
from .panel import COLS, TRANS, Panel

# storage


@query("s3_list_tables", "select unnest(['coords', 'lulc']) table_name", panel=False)
def _(p: Panel) -> DataFrame:
    s = _store(p)
    s.commit(p.lulc, "lulc")
    s.commit(p.coords, "coords")
    return p.spark.createDataFrame([(n,) for n in s.list_tables()], "table_name string")


@query("s7_metadata", "select * from (values ('epsg', '2056'), ('flag', 'true'), ('keys', '[\"id_coord\"]'), ('label', '\"grid\"'), ('resolution', '100.0')) t(key, \"value\")", panel=False)
def _(p: Panel) -> DataFrame:
    import json

    s = _store(p)
    s.commit(p.coords, "coords", keys=["id_coord"], epsg=2056, resolution=100.0, flag=True, label="grid")
    return p.spark.createDataFrame([(k, json.dumps(v)) for k, v in s.metadata("coords").items() if k != "schema"], "key string, value string")


@query("s10_commit_modes", "select * from (values ('overwrite', 3), ('append', 1), ('upsert', 4), ('upsert', 5), ('rows', 5)) t(step, n)", panel=False)
def _(p: Panel) -> DataFrame:
    s = _store(p)
    row = lambda *r: p.spark.createDataFrame([(i, float(i)) for i in r], "id int, value double")
    out = [("overwrite", s.commit(row(1, 2, 3), "t", "upsert", keys=["id"])), ("append", s.commit(row(4), "t", "append", quiet=True))]
    out += [("upsert", s.commit(row(2, 4), "t", "upsert")), ("upsert", s.commit(row(5), "t", "upsert")), ("rows", s.row_count("t"))]
    return p.spark.createDataFrame(out, "step string, n int")


@query("s11_overwrite_partitioned", "select id_coord, id_period, id_lulc from lulc where id_period = 3")
def _(p: Panel) -> DataFrame:
    s = _store(p)
    s.commit(p.lulc, "lulc", partitions=["id_period"])
    s.commit(p.lulc.where("id_period = 3"), "lulc")
    return s.read("lulc").select("id_coord", "id_period", "id_lulc")


@query("s14_key_conflicts", "select 'conflict' outcome, 3 n", panel=False)
def _(p: Panel) -> DataFrame:
    from ..sources.store import KeyConflict

    s = _store(p)
    row = lambda *r: p.spark.createDataFrame(list(r), "id int, name string")
    s.commit(row((1, "a"), (2, "b"), (3, "c")), "t", keys=["id"], alternate=["name"])
    try:
        s.commit(row((9, "a")), "t", "upsert")
        outcome = "written"
    except KeyConflict:
        outcome = "conflict"
    return p.spark.createDataFrame([(outcome, s.row_count("t"))], "outcome string, n int")


@query("s18_cast_to_schema", "select cast(0 as integer) id_run, id_coord, id_lulc, id_period, 'kept' note from lulc where id_period = 1")
def _(p: Panel) -> DataFrame:
    d = p.lulc.where("id_period = 1").select(F.col("id_lulc").cast("string"), F.lit("kept").alias("note"), F.col("id_period").cast("long"), F.lit(0.0).alias("id_run"), "id_coord")
    return TABLES["lulc_data_t"].validate(TABLES["lulc_data_t"].cast(d))


@query("s27_report", "select * from (values ('a', '2'), ('b', 'x')) t(key, \"value\")", panel=False)
def _(p: Panel) -> DataFrame:
    db = LandDatabase(p.spark, p.folder("report"))
    db.set_report(a=1)
    db.set_report(a=2, b="x")
    return db.reporting_t.where("key in ('a', 'b')")


@query("l3_all_runs", "select * from over")
def _(p: Panel) -> DataFrame:
    return lineage.visible(p.overrides, None)


@query("l7_orphan_runs", "select r.id_run, r.parent_id_run from runs r where r.id_run <> 1 and r.parent_id_run is not null and r.parent_id_run not in (select id_run from runs where id_run <> 1)")
def _(p: Panel) -> DataFrame:
    return lineage.orphans(p.runs.where("id_run <> 1"))


@query("u3_recursive_lineage", "with recursive r as (select r_regionkey id_run, case when r_regionkey > 0 then (r_regionkey - 1) // 2 end p from region), l as (select id_run origin, id_run, 0 d from r union all select l.origin, r.p, d + 1 from l join r on r.id_run = l.id_run where r.p is not null) select cast(origin as integer) origin, cast(id_run as integer) id_run, cast(d as integer) distance from l", panel=False)
def _(p: Panel) -> DataFrame:
    return lineage.lineages(p.runs)


# relational primitives


@query("j3_static_by_period", "select p.id_period, s.id_coord, s.id_pred, s.\"value\" from pred s, periods p where s.id_period = 0 and p.id_period between 1 and 4")
def _(p: Panel) -> DataFrame:
    return design.static_by_period(p.pred_data, p.periods)


@query("j7_values_of_class", "select id_coord, id_pred, \"value\" from pred where id_period = 4 and id_coord in (select id_coord from lulc where id_period = 4 and id_lulc = 2)")
def _(p: Panel) -> DataFrame:
    return design.values_of_cells(p.pred_data, p.lulc.where("id_period = 4 and id_lulc = 2"), 4).select("id_coord", "id_pred", "value")


@query("j9_rates_of_all_transitions", "select m.id_trans, id_lulc_anterior, id_lulc_posterior, coalesce(case when m.id_trans = 2 then 3.0::double end, 1) area_mean, case when m.id_trans = 2 then 0.5::double end area_var, coalesce(case when m.id_trans = 2 then 0.2::double end, 0.5) elongation, coalesce(r.rate, 0) rate from meta m left join rates r using (id_trans)")
def _(p: Panel) -> DataFrame:
    params = p.spark.createDataFrame([(2, 3.0, 0.5, 0.2)], "id_trans int, area_mean double, area_var double, elongation double")
    return allocate.transition_inputs(transitions.transition_meta(transitions.transitions(p.lulc)), params, p.rates)


@query("a6_predictors_by_transition", "select m.id_trans, string_agg(cast(id_pred as varchar), ',' order by id_pred) preds from (select unnest([1, 2, 3, 4]) id_pred) p, meta m where (m.id_trans + id_pred) % 2 = 0 group by 1")
def _(p: Panel) -> DataFrame:
    meta = transitions.transition_meta(transitions.transitions(p.lulc)).withColumn("is_viable", F.lit(True))
    pairs = transitions.full_transition_predictors(p.spark.range(1, 5).select(F.col("id").alias("id_pred")), meta).where("(id_trans + id_pred) % 2 = 0")
    return transitions.predictors_by_transition(pairs).select("id_trans", F.array_join(F.col("id_preds").cast("array<string>"), ",").alias("preds"))


@query("a8_closest_run", "select id_period, cast(max(id_run) as integer) id_run from over where id_run in (3, 1, 0) group by 1")
def _(p: Panel) -> DataFrame:
    return lineage.closest_runs(p.overrides, lineage.lineage(p.runs, 3), "id_period")


@query("a10_pivot", "select id_coord, id_period, max(case when id_pred = 3 then \"value\" end) id_pred_3, max(case when id_pred = 4 then \"value\" end) id_pred_4, cast(null as double) id_pred_9 from pred where id_pred in (3, 4) group by 1, 2")
def _(p: Panel) -> DataFrame:
    return design.wide(p.pred_data.where("id_pred in (3, 4)"), [3, 4, 9], "id_coord", "id_period")


@query("a11_mean_params", "select cast(p_size as integer) id_trans, round(avg(p_retailprice), 6) mean_patch_size, round(avg(case when p_partkey % 3 <> 0 then p_retailprice / 2 end), 6) patch_size_variance from part group by 1", panel=False)
def _(p: Panel) -> DataFrame:
    k, x = F.col("p_partkey"), F.col("p_retailprice")
    nan = F.lit(float("nan"))
    d = p.table("part").select(F.col("p_size").cast("int").alias("id_trans"), x.alias("mean_patch_size"), F.when(k % 3 != 0, x / 2).otherwise(nan).alias("patch_size_variance"), *[nan.alias(c) for c in ("patch_elongation", "patch_isometry", "frac_expander", "frac_patcher")])
    return patches.mean_params(d).select("id_trans", F.round("mean_patch_size", 6).alias("mean_patch_size"), F.round("patch_size_variance", 6).alias("patch_size_variance"))


_KINDS = """, m as (select c."row", c.col, a.id_lulc ant, b.id_lulc post, a.id_coord from lulc a join lulc b on a.id_coord = b.id_coord and a.id_period = 1 and b.id_period = 5 join coords c on c.id_coord = a.id_coord),
t as (select *, ant = 1 and post = 2 tr from m),
k as (select t."row", t.col, t.id_coord, sum(cast(n.ant = 2 as integer)) near from t left join t n on n."row" between t."row" - 1 and t."row" + 1 and n.col between t.col - 1 and t.col + 1 and not n.tr where t.tr group by 1, 2, 3)"""


def isometry_sql(e: str) -> str:
    """The published curve as an expression."""
    steps = "".join(f" when {e} <= {b} then {ya} + ({e} - {a}) * ({yb - ya} / {b - a})" for (a, ya), (b, yb) in zip(patches.CURVE, patches.CURVE[1:]))
    return f"case when {e} is null then null when {e} < {patches.CURVE[0][0]} then {patches.CURVE[0][1]} when {e} > {patches.CURVE[-1][0]} then {patches.CURVE[-1][1]}{steps} end"


@query("a14_alloc_params")
def _(p: Panel) -> DataFrame:
    cols = ("mean_patch_size", "patch_size_variance", "patch_elongation", "patch_isometry", "frac_expander", "frac_patcher")
    return patches.alloc_params(_maps(p), 1, 2).select(*[F.round(c, 6).alias(c) for c in cols])


ORACLE_SQL["a14_alloc_params"] = recursive(
    f"""{_KINDS}, cells as materialized (select "row" r, col c, 1 v, id_coord k from k where near = 0),
{LABELS},
s as (select avg(n) mean, case when count(*) > 1 then var_samp(n) end variance, avg(e) e from parts), c as (select cast(count(*) as double) n, cast(count(*) filter (where near >= 1) as double) x, cast(count(*) filter (where near = 0) as double) y from k)
select round(mean, 6) mean_patch_size, round(variance, 6) patch_size_variance, round(e, 6) patch_elongation, round({isometry_sql("e")}, 6) patch_isometry, round(x / n, 6) frac_expander, round(y / n, 6) frac_patcher from s, c"""
)


@query("a14_alloc_params_of_all", "select cast(id_trans as integer) id_trans, round(x / n, 6) frac_expander, round(y / n, 6) frac_patcher from (select id_trans, cast(count(*) as double) n, cast(count(*) filter (where near >= 1) as double) x, cast(count(*) filter (where near = 0) as double) y from (select id_trans, a.id_coord, sum(cast(nb.id_lulc = b.id_lulc as integer)) near from (select unnest([1, 2, 3, 4]) id_trans, unnest([1, 1, 2, 3]) ant, unnest([2, 3, 1, 4]) post) t join lulc a on a.id_lulc = t.ant and a.id_period = 1 join lulc b on b.id_coord = a.id_coord and b.id_period = 5 and b.id_lulc = t.post join coords c on c.id_coord = a.id_coord left join (select c2.\"row\" r, c2.col q, x.id_lulc, y.id_lulc post from coords c2 join lulc x on x.id_coord = c2.id_coord and x.id_period = 1 join lulc y on y.id_coord = c2.id_coord and y.id_period = 5) nb on nb.r between c.\"row\" - 1 and c.\"row\" + 1 and nb.q between c.col - 1 and c.col + 1 and not (nb.id_lulc = t.ant and nb.post = t.post) group by 1, 2) group by 1)")
def _(p: Panel) -> DataFrame:
    """Every transition in one plan."""
    trans = p.spark.createDataFrame(TRANS, "id_trans int, id_lulc_anterior int, id_lulc_posterior int")
    return patches.alloc_params_all(_maps(p), trans).select("id_trans", *[F.round(c, 6).alias(c) for c in ("frac_expander", "frac_patcher")])


def _params(p: Panel) -> DataFrame:
    k = F.col("p_partkey")
    share = (k % 20).cast("double") / 20
    d = p.table("part").select(k.cast("int").alias("id_trans"), *[F.lit(x).alias(c) for c, x in (("mean_patch_size", 1.5), ("patch_size_variance", 2.5), ("patch_elongation", 0.25), ("patch_isometry", 0.75))], share.alias("frac_expander"), (1 - share).alias("frac_patcher"))
    return patches.perturbed_params(d, 2, 0.1)


@query("a15_perturbed_params", "select cast(r as integer) id_run, cast(p_partkey as integer) id_trans, 1.5::double mean_patch_size, true in_range, case when r = 1 then round(cast(p_partkey % 20 as double) / 20, 8) end frac_expander from part, range(1, 4) t(r)", panel=False)
def _(p: Panel) -> DataFrame:
    """The deviates themselves are held against the published hash in the tests."""
    d = _params(p)
    return d.select("id_run", "id_trans", "mean_patch_size", (F.col("frac_expander").between(0, 1) & (F.abs(F.col("frac_expander") + F.col("frac_patcher") - 1) < 1e-9)).alias("in_range"), F.when(F.col("id_run") == 1, r8("frac_expander")).alias("frac_expander"))


@query("p4_patch_params", "select cast(1 as integer) id_run, cast(p_partkey as integer) id_trans, 1.5::double area_mean, 2.5::double area_var, 0.25::double elongation, round(cast(p_partkey % 20 as double) / 20, 8) frac_expander, round(1 - cast(p_partkey % 20 as double) / 20, 8) frac_patcher from part", panel=False)
def _(p: Panel) -> DataFrame:
    return patches.patch_params(_params(p)).where("id_run = 1").withColumns({c: r8(c) for c in ("frac_expander", "frac_patcher")})


@query("a18_global_counts", "select id_lulc, count(*) n_cells, round(cast(count(*) as double) / sum(count(*)) over (), 8) share from lulc where id_period = 2 group by 1")
def _(p: Panel) -> DataFrame:
    return validate.class_shares(p.lulc.where("id_period = 2")).withColumn("share", r8("share"))


@query("u2_dynamic_and_static", "select id_pred, id_period, count(*) n, round(sum(\"value\"), 4) total from (select id_pred, id_period, \"value\" from pred where id_period > 0 union all select s.id_pred, p.id_period, s.\"value\" from pred s, periods p where s.id_period = 0 and p.id_period between 1 and 4) group by 1, 2")
def _(p: Panel) -> DataFrame:
    return design.long_predictors(p.pred_data, p.periods).groupBy("id_pred", "id_period").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("p14_predicates", "select id_coord, id_period, id_lulc from lulc where id_lulc in (1, 3) and id_period <> 4 and not (id_coord % 2 = 0) and id_period = (select max(id_period) from lulc) and cast(id_coord as varchar) like '1_%'")
def _(p: Panel) -> DataFrame:
    s = _store(p)
    s.commit(p.lulc, "lulc_of_all")
    return s.query("select id_coord, id_period, id_lulc from lulc_of_all where id_lulc in (1, 3) and id_period <> 4 and not (id_coord % 2 = 0) and id_period = (select max(id_period) from lulc_of_all) and cast(id_coord as string) like '1_%'")


@query("u4_concat", "select id_coord, id_lulc, id_period, cast(null as integer) \"row\" from lulc where id_period = 1 union all select id_coord, null, null, \"row\" from coords")
def _(p: Panel) -> DataFrame:
    folder = p.folder("parts")
    p.lulc.where("id_period = 1").write.parquet(f"{folder}/a")
    p.coords.select("row", "id_coord").write.parquet(f"{folder}/b")
    return concat(p.spark, [f"{folder}/a", f"{folder}/b"]).select("id_coord", "id_lulc", "id_period", "row")


@query("o3_in_order", "select id_coord, id_period, id_lulc from (select * from lulc order by id_coord nulls last, id_period nulls last limit 50)")
def _(p: Panel) -> DataFrame:
    s = _store(p)
    s.commit(p.lulc, "lulc", keys=["id_coord", "id_period"])
    return s.fetch("lulc", ["id_coord", "id_period", "id_lulc"], limit=50, in_order=True)


@query("s20_maps", "select id_coord, k.\"key\", k.\"value\" from (select id_coord, unnest([{'key': 'area', 'value': cast(id_coord % 7 as varchar)}, {'key': 'kind', 'value': case when id_coord % 2 = 0 then 'even' end}]) k from coords)")
def _(p: Panel) -> DataFrame:
    """Structs and arrays of pairs become maps of strings on their way in."""
    s = _store(p)
    kind = F.when(F.col("id_coord") % 2 == 0, "even")
    named = p.coords.where("id_coord % 3 = 0").select("id_coord", F.struct((F.col("id_coord") % 7).alias("area"), kind.alias("kind")).alias("params"))
    pairs = p.coords.where("id_coord % 3 > 0").select("id_coord", F.array(F.struct(F.lit("area").alias("k"), (F.col("id_coord") % 7).cast("string").alias("v")), F.struct(F.lit("kind").alias("k"), kind.alias("v"))).alias("params"))
    s.commit(named, "t", keys=["id_coord"], maps=["params"])
    pairs.createOrReplaceTempView("landweave_pairs")
    s.commit("landweave_pairs", "t", "upsert")
    return s.read("t").select("id_coord", F.explode("params").alias("key", "value"))


@query("s25_bounded_files", f"select n_pairs, cast(0 as bigint) too_long from (select count(*) n_pairs from ({_PAIRS}))")
def _(p: Panel) -> DataFrame:
    db = LandDatabase(p.spark, p.folder("neighbors"))
    db.put("coords_t", p.coords.select("id_coord", "lon", "lat", F.lit(None).alias("elevation"), F.lit(None).alias("geom_polygon")), resolution=100.0)
    db.set_neighbors(300, [0.0, 100.0, 200.0, 300.0], rows_per_file=1000)
    n = db.read("neighbors_t").groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("n_pairs"), F.count_if(F.col("n") > 1000).alias("too_long"))


@query("r13_layers", "select 'id_period_' || id_period layer, \"row\", col, id_lulc \"value\" from lulc join coords using (id_coord) where id_period in (1, 2)")
def _(p: Panel) -> DataFrame:
    db = LandDatabase(p.spark, p.folder("layers"))
    db.put("coords_t", p.coords.select("id_coord", "lon", "lat", F.lit(None).alias("elevation"), F.lit(None).alias("geom_polygon")), resolution=100.0)
    db.put("lulc_data_t", p.lulc.where("id_period in (1, 2)").withColumn("id_run", F.lit(0)))
    return db.lulc_data_as_rast()


@query("p8_add_predictor", "select 1 id_pred, id_coord, cast(\"value\" as double) \"value\", 'int' data_type from (select cast(p_partkey as integer) id_coord, p_size \"value\" from part) union all select 2, cast(p_partkey as integer), cast(p_partkey % 3 + 1 as double), 'factor' from part", panel=False)
def _(p: Panel) -> DataFrame:
    db = LandDatabase(p.spark, p.folder("predictors"))
    k = F.col("p_partkey")
    db.add_predictor("size", p.table("part").select(k.cast("int").alias("id_coord"), F.col("p_size").alias("value")))
    db.add_predictor("soil", p.table("part").select(k.cast("int").alias("id_coord"), F.element_at(F.array(*map(F.lit, "abc")), (k % 3 + 1).cast("int")).alias("value")))
    return db.pred_data_t.join(db.pred_meta_t.select("id_pred", "data_type"), "id_pred").select("id_pred", "id_coord", "value", "data_type")


@query(
    "s24_export_tables",
    """select 'rates' "table", m.id_lulc_anterior "From", m.id_lulc_posterior "To", round(r.rate, 8) a, cast(null as double) b, cast(null as double) c from meta m join rates r using (id_trans)
union all select 'expansion', id_lulc_anterior, id_lulc_posterior, case when id_trans = 1 then 1 - 1e-6::double else 0.25 end, null, null from meta where id_trans <= 2
union all select 'patches', id_lulc_anterior, id_lulc_posterior, case when id_trans = 1 then 1 else 3.5::double end, case when id_trans = 1 then 0 else 2 end, 1 from meta where id_trans <= 2""",
)
def _(p: Panel) -> DataFrame:
    """The external allocator's tables, written as CSV and read again."""
    db = LandDatabase(p.spark, p.folder("export"))
    db.put("coords_t", p.coords.select("id_coord", "lon", "lat", F.lit(None).alias("elevation"), F.lit(None).alias("geom_polygon")), resolution=100.0)
    db.put("lulc_data_t", p.lulc.where("id_period = 5").withColumn("id_run", F.lit(0)))
    db.put("trans_meta_t", transitions.transition_meta(transitions.transitions(p.lulc)).withColumn("is_viable", F.lit(True)))
    db.put("trans_rates_t", p.rates.withColumn("count", F.lit(None)))
    db.put("trans_pot_t", p.potentials)
    cols = ["id_run", "id_trans", "mean_patch_size", "patch_size_variance", "patch_elongation", "patch_isometry", "frac_expander", "frac_patcher", "similarity"]
    db.put("alloc_params_t", p.spark.createDataFrame([(0, 1, None, None, None, None, 1.0, 0.0, None), (0, 2, 3.5, 2.0, 0.5, 1.0, 0.25, 0.75, None)], ", ".join(f"{c} {'int' if c.startswith('id') else 'double'}" for c in cols)))
    folder = p.folder("exported")
    db.export_external(6, folder)
    out = []
    for name, file, values in (("rates", "trans_rates.csv", ["Rate"]), ("expansion", "expansion_table.csv", ["Percent_Expander"]), ("patches", "patcher_table.csv", ["Mean_Patch_Size", "Patch_Size_Variance", "Patch_Isometry"])):
        d = p.spark.read.csv(f"{folder}/{file}", header=True)
        three = [F.round(F.col(v).cast("double"), 8) for v in values] + [F.lit(None).cast("double")] * (3 - len(values))
        out.append(d.select(F.lit(name).alias("table"), F.col("`From*`").cast("int").alias("From"), F.col("`To*`").cast("int").alias("To"), *[c.alias(n) for c, n in zip(three, "abc")]))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("p7_interventions", "select * from (values (1, 'protected_areas', 7), (1, 'protected_areas', 8), (2, 'hydro', 9)) t(id_intrv, \"name\", id_period)", panel=False)
def _(p: Panel) -> DataFrame:
    meta = build.intrv_meta(p.spark, {"protected_areas": {"id_period_list": [7, 8], "pre_allocation": True}, "hydro": {"id_period_list": [9], "params": {"level": 3}}})
    return meta.select("id_intrv", "name", F.explode("id_period_list").alias("id_period"))


# rasters and simulation


@query(
    "r1_focal_sums",
    """, m as (select c."row" r, c.col c, l.id_lulc v from coords c join lulc l using (id_coord) where l.id_period = 1)
select a.r "row", a.c col, cast(sum(b.v) as bigint) total, count(*) n from m a join m b on b.r between a.r - 1 and a.r + 1 and b.c between a.c - 1 and a.c + 1 group by 1, 2""",
)
def _(p: Panel) -> DataFrame:
    return patches.focal_sum(p.lulc.where("id_period = 1").join(p.coords, "id_coord"), "id_lulc")


@query("r2_identical_maps", "select 1.0::double similarity", panel=False)
def _(p: Panel) -> DataFrame:
    d = p.coords.select("row", "col", (F.col("id_coord") % 3 + 1).alias("a"), (F.col("id_coord") % 3 + 1).alias("b"))
    n = p.coords.agg(F.max("row")).first()[0] + 1
    return validate.fuzzy_similarity(d, n, COLS).select(r8("similarity").alias("similarity"))


_THREE = """, x as (select c."row" r, c.col c, a.id_lulc init, b.id_lulc obs, d.id_lulc sim from lulc a join lulc b on b.id_coord = a.id_coord and b.id_period = 3 join lulc d on d.id_coord = a.id_coord and d.id_period = 5 join coords c on c.id_coord = a.id_coord where a.id_period = 1),
m as (select cast("row" as integer) r, coords.col c, case when init = 1 and obs = 2 then 1 when init is not null then 0 end va, case when init = 1 and sim = 2 then 1 when init is not null then 0 end vb from coords left join x on x.r = coords."row" and x.c = coords.col),
"""


def _three_maps(p: Panel) -> DataFrame:
    obs = _two_maps(p, 1, 3).select("id_coord", "init", F.col("final").alias("obs"))
    return obs.join(_two_maps(p, 1, 5).select("id_coord", F.col("final").alias("sim")), "id_coord").join(p.coords, "id_coord")


@query("r3_transition_similarity", _THREE + SIMILARITY.format(h=2) + " select (select cast(sum(va) as bigint) from m) n_observed, (select cast(sum(vb) as bigint) from m) n_simulated, round(avg(sim_a), 8) mean_a, round(avg(sim_b), 8) mean_b, round(least(avg(sim_a), avg(sim_b)), 8) similarity from both_ways")
def _(p: Panel) -> DataFrame:
    found = validate.transition_similarity(_three_maps(p), 1, 2, p.n_rows, COLS, window=5)
    return found.select("n_observed", "n_simulated", *[r8(c).alias(c) for c in ("mean_a", "mean_b", "similarity")])


@query("r9_empty_potentials", "select cast(r as integer) id_run, l.id_coord, l.id_lulc from lulc l, range(2) t(r) where id_period = 5")
def _(p: Panel) -> DataFrame:
    every = lambda d: d.withColumn("id_run", F.explode(F.array(F.lit(0), F.lit(1))))
    cells = every(p.lulc.where("id_period = 5").join(p.coords, "id_coord"))
    trans = p.spark.createDataFrame([(1, 1, 2, 4.0, 2.0, 0.5, 0.1)], "id_trans int, id_lulc_anterior int, id_lulc_posterior int, area_mean double, area_var double, elongation double, rate double")
    return allocate.allocate_runs(cells, every(p.potentials.where("false")), every(trans))


@query("r9_certain_single_cells", "select cast(0 as integer) id_run, id_coord, case when id_lulc = 1 then 2 else id_lulc end id_lulc from lulc where id_period = 5")
def _(p: Panel) -> DataFrame:
    run = F.lit(0).alias("id_run")
    cells = p.lulc.where("id_period = 5").join(p.coords, "id_coord").select(run, "*")
    pot = cells.where("id_lulc = 1").select("id_run", F.lit(1).alias("id_trans"), "id_coord", F.lit(1.0).alias("value"))
    trans = p.spark.createDataFrame([(0, 1, 1, 2, 1.0, 0.0, 0.5, 0.1)], "id_run int, id_trans int, id_lulc_anterior int, id_lulc_posterior int, area_mean double, area_var double, elongation double, rate double")
    return allocate.allocate_runs(cells, pot, trans)


@query(
    "r10_simulation",
    """, seen as (select id_coord, id_period, cast(id_lulc % 2 + 1 as integer) id_lulc from lulc where id_period <= 3)
select * from seen union all select id_coord, 4, 2 from seen where id_period = 3 union all select id_coord, 5, 1 from seen where id_period = 3""",
)
def _(p: Panel) -> DataFrame:
    """Two periods of the whole landscape, end to end: grid, classes, predictors, models, rates, potentials, allocation.
    Rates of 1 and 0 leave nothing to chance: first all cells take the one class, then all the other."""
    db = LandDatabase(p.spark, p.folder("simulation"))
    db.put("coords_t", p.coords.select("id_coord", "lon", "lat", F.lit(None).alias("elevation"), F.lit(None).alias("geom_polygon")), resolution=100.0)
    years = p.spark.range(1, 6).select(F.col("id").cast("int").alias("id_period"), F.make_date(1994 + F.col("id").cast("int"), F.lit(1), F.lit(1)).alias("start_date"), F.make_date(1994 + F.col("id").cast("int"), F.lit(12), F.lit(31)).alias("end_date"), (F.col("id") > 3).alias("is_extrapolated"))
    db.put("periods_t", years)
    db.put("lulc_meta_t", build.lulc_meta(p.spark, {"a": {"src_classes": [1]}, "b": {"src_classes": [2]}}))
    db.put("lulc_data_t", p.lulc.where("id_period <= 3").select(F.lit(0).alias("id_run"), "id_coord", (F.col("id_lulc") % 2 + 1).alias("id_lulc"), "id_period"))
    db.add_predictor("size", p.table("part").select(F.col("p_partkey").cast("int").alias("id_coord"), F.col("p_size").alias("value")))
    db.put("trans_meta_t", transitions.transition_meta(db.trans_v, 1))
    db.set_full_trans_preds()
    rates = p.spark.createDataFrame([(0, 4, 1, None, 1.0), (0, 4, 2, None, 0.0), (0, 5, 1, None, 0.0), (0, 5, 2, None, 1.0)], "id_run int, id_period int, id_trans int, count int, rate double")
    db.put("trans_rates_t", rates)
    db.fit_full_models(learner=models.Featureless())
    db.alloc_patches([4, 5], "no.crossval", seed=1)
    return db.read("lulc_data_t").select("id_coord", "id_period", "id_lulc")


@query("m1_stratified_split", "select did_transition, cast(round_even(count(*) * 0.7, 0) as bigint) n_train, count(*) n from (select id_lulc_posterior = 2 did_transition from trans where id_lulc_anterior = 1 and id_period - 1 < 5) group by 1")
def _(p: Panel) -> DataFrame:
    d = models.stratified(_training(p), 0.7, 1, "did_transition")
    return d.groupBy("did_transition").agg(F.count_if("is_train").alias("n_train"), F.count("*").alias("n"))


#: Of the labels of a training matrix: rows of both classes, and of the train part (70 % of each class, rounded half to even).
_SPLIT = f""", n as (select cast(count(*) filter (where did_transition) as double) p, cast(count(*) filter (where not did_transition) as double) q from ({_TRAINING})),
s as (select *, round_even(0.7 * p, 0) tp, round_even(0.7 * q, 0) tq from n), k as (select *, tp / (tp + tq) prior from s)"""


def _labelled(p: Panel) -> tuple[DataFrame, list[str]]:
    return _training(p).withColumns({"id_run": F.lit(0), "id_trans": F.lit(1)}), [f"id_pred_{i}" for i in (1, 2, 3, 4)]


@query("m1_fit_partial", _SPLIT + " select 0 id_run, 1 id_trans, 'classif.featureless' learner_id, 0.5::double auc, round(case when prior > 0.5 then p - tp else q - tq end / (p - tp + q - tq), 8) acc from k")
def _(p: Panel) -> DataFrame:
    fitted = models.fit_partial(*_labelled(p), models.Featureless())
    score = lambda m: r8(F.col("crossval_score")[m].cast("double"))
    return fitted.select("id_run", "id_trans", "learner_id", score("classif.auc").alias("auc"), score("classif.acc").alias("acc"))


@query("m1_fit_partial_tree")
def _(p: Panel) -> DataFrame:
    """Held against fits by hand in the tests."""
    fitted = models.fit_partial(*_labelled(p), models.Tree(max_depth=4))
    return fitted.select("id_run", "id_trans", "learner_id", F.col("crossval_score")["classif.auc"].alias("auc"), F.col("crossval_score")["classif.acc"].alias("acc"))


@query("m7_crossval_predictions", _SPLIT + " select truth, cast(n as bigint) n, round(prior, 8) prediction from (select 1 truth, p - tp n, prior from k union all select 0, q - tq, prior from k)")
def _(p: Panel) -> DataFrame:
    found = models.crossval_predictions(models.fit_partial(*_labelled(p), models.Featureless()))
    return found.groupBy("truth", r8("prediction").alias("prediction")).agg(F.count("*").alias("n"))


@query(
    "m2_select_and_refit",
    f""", t as (select id_pred_3 x, cast(did_transition as integer) y, (id_coord + id_period) % 10 < 7 is_train from ({_TRAINING})),
held as (select t.y, coalesce(k.p, (select avg(y) from t where is_train)) p from t left join (select x, avg(y) p from t where is_train group by 1) k on k.x = t.x where not t.is_train),
ranked as (select y, rank() over (order by p) + cast(count(*) over (partition by p) - 1 as double) / 2 r from held),
score as (select (sum(r) filter (where y = 1) - cast(sum(y) as double) * (sum(y) + 1) / 2) / nullif(cast(sum(y) as double) * (count(*) - sum(y)), 0) auc from ranked),
best as (select case when auc > 0.5 then 'b' else 'a' end learner_id from score)
select best.learner_id, 1 id_trans, l.id_coord, round(case when best.learner_id = 'b' then coalesce(k.p, m.p) else m.p end, 8) "value"
from (select id_coord from lulc where id_period = 5 and id_lulc = 1) l cross join best cross join (select avg(y) p from t) m
left join (select id_coord, "value" x from pred where id_pred = 3 and id_period = 5) v on v.id_coord = l.id_coord left join (select x, avg(y) p from t group by 1) k on k.x = v.x""",
)
def _(p: Panel) -> DataFrame:
    """Of two tried learners the one with the better score on the rows held out is fitted on all rows, and predicts."""
    t, names = _labelled(p)
    t = settle(t.withColumn("is_train", (F.col("id_coord") + F.col("id_period")) % 10 < 7), "training")
    tried = models.fit_partial(t, names, models.Featureless("a")).unionByName(models.fit_partial(t, names, models.Shares("b", feature=2)))
    full = settle(models.fit_full(t, names, potential.best_models(tried, "classif.auc")), "models")
    rows = design.inference_matrix(p.lulc, p.pred_data, 1, [1, 2, 3, 4], 5).withColumn("id_trans", F.lit(1))
    return models.predict(rows, names, full).withColumn("value", r8("value")).crossJoin(F.broadcast(full.select("learner_id")))


@query("m6_filter_performance", "select 0 id_run, 1 id_trans, 'id_pred_' || i feature, 0.5::double score from range(1, 5) t(i)", panel=False)
def _(p: Panel) -> DataFrame:
    """Of a learner that heeds no feature; trees are held against fits by hand in the tests."""
    return models.filter_scores(*_labelled(p), "performance", models.Featureless())


@query("m6_filter_importance")
def _(p: Panel) -> DataFrame:
    """Held against fits by hand in the tests."""
    return models.filter_scores(*_labelled(p), "importance", models.Forest(n_trees=10, gamma=0.9))


@query("a1_rates_sum_to_one", "select id_period, id_lulc_anterior, round(sum(case when id_lulc_anterior <> id_lulc_posterior then 1.0 else 0 end) / count(*), 8) changed from trans group by 1, 2")
def _(p: Panel) -> DataFrame:
    m = transitions.transition_meta(transitions.transitions(p.lulc)).select("id_trans", "id_lulc_anterior")
    return _observed(p).join(F.broadcast(m), "id_trans").groupBy("id_period", "id_lulc_anterior").agg(r8(F.sum("rate")).alias("changed"))

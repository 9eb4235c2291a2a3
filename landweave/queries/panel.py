"""A land-use panel out of the test tables, in Spark and in SQL.

Parts are the cells of a grid 50 columns wide; what was sold of a part in a year gives its
class in that period; sizes, prices and yearly sales are predictors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import fresh_folder

COLS = 50
OBSERVED_UNTIL = 5
TRANS = [(1, 1, 2), (2, 1, 3), (3, 2, 1), (4, 3, 4)]

SQL = f"""coords as (select cast(p_partkey as integer) id_coord, cast((p_partkey % {COLS}) * 100 + 50 as double) lon, cast(-((p_partkey // {COLS}) * 100 + 50) as double) lat,
  cast(p_partkey // {COLS} as integer) "row", cast(p_partkey % {COLS} as integer) col from part),
lulc as (select cast(l_partkey as integer) id_coord, cast(year(l_shipdate) - 1994 as integer) id_period, cast(sum(cast(l_quantity as bigint)) % 4 + 1 as integer) id_lulc from lineitem group by 1, 2),
periods as (select cast(i as integer) id_period, i > {OBSERVED_UNTIL} is_extrapolated from range(0, 8) t(i)),
runs as (select r_regionkey id_run, case when r_regionkey > 0 then cast((r_regionkey - 1) // 2 as integer) end parent_id_run from region),
trans as (select c.id_coord, c.id_period, p.id_lulc id_lulc_anterior, c.id_lulc id_lulc_posterior from lulc c join lulc p on p.id_coord = c.id_coord and p.id_period + 1 = c.id_period),
meta as (select cast(row_number() over (order by a, b) as integer) id_trans, a id_lulc_anterior, b id_lulc_posterior, cast(n as integer) cardinality, cast(n as double) / sum(n) over () frequency_rel, cast(n as double) / total frequency_abs
  from (select id_lulc_anterior a, id_lulc_posterior b, count(*) n, sum(count(*)) over () total from trans group by 1, 2) where a <> b),
pred as (select cast(0 as integer) id_period, 1 id_pred, cast(p_partkey as integer) id_coord, cast(p_size as double) "value" from part where p_partkey % 7 <> 3
  union all select 0, 2, cast(p_partkey as integer), p_retailprice from part
  union all select cast(year(l_shipdate) - 1994 as integer), 3, cast(l_partkey as integer), cast(count(*) as double) from lineitem group by 1, 3
  union all select cast(year(l_shipdate) - 1994 as integer), 4, cast(l_partkey as integer), sum(l_quantity) from lineitem group by 1, 3),
pot as (select t.id_trans, 6 id_period_post, c.id_coord, cast((c.id_coord * 37 + t.id_trans * 11) % 100 as double) / 100 "value" from coords c, (select unnest([1, 2, 3, 4]) id_trans) t where (c.id_coord + t.id_trans) % 5 <> 0),
rates as (select cast(0 as integer) id_run, cast(6 as integer) id_period, cast(i as integer) id_trans, cast(i as double) / 10 rate from range(1, 4) t(i)),
over as (select r.id_run, l.id_period, l.id_coord, ((l.id_lulc + r.id_run) % 4) + 1 id_lulc from lulc l, runs r where r.id_run = 0 or (r.id_run = 1 and l.id_period = 3) or (r.id_run = 3 and l.id_period in (3, 5) and l.id_coord % 2 = 0)),
models as (select r.id_run, t.id_trans, l.learner learner_id, cast(((r.id_run * 7 + t.id_trans * 13 + l.k * 29) % 50) as double) / 50 auc, (r.id_run + t.id_trans + l.k) % 6 = 0 as gone
  from runs r, (select unnest([1, 2, 3, 4]) id_trans) t, (select unnest(['featureless', 'ranger', 'rpart']) learner, unnest([1, 2, 3]) k) l)"""


def sql(query: str) -> str:
    """A query over the panel; one that begins with a comma brings further common tables."""
    return f"with {SQL}{query}" if query.startswith(",") else f"with {SQL}\n{query}"


class Panel:
    """The domain tables as lazy frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def folder(self, name: str) -> str:
        return fresh_folder(self.spark, name)

    @property
    def coords(self) -> DataFrame:
        k = F.col("p_partkey")
        row, col = F.floor(k / COLS).cast("int"), (k % COLS).cast("int")
        return self.table("part").select(k.cast("int").alias("id_coord"), (col * 100 + 50).cast("double").alias("lon"), (-(row * 100 + 50)).cast("double").alias("lat"), row.alias("row"), col.alias("col"))

    @property
    def n_rows(self) -> int:
        """Rows of the grid."""
        return (self.coords.agg(F.max("row")).first()[0] or 0) + 1

    @property
    def lulc(self) -> DataFrame:
        sold = self.table("lineitem").groupBy(F.col("l_partkey").cast("int").alias("id_coord"), (F.year("l_shipdate") - 1994).alias("id_period"))
        return sold.agg((F.sum(F.col("l_quantity").cast("bigint")) % 4 + 1).cast("int").alias("id_lulc"))

    @property
    def periods(self) -> DataFrame:
        return self.spark.range(8).select(F.col("id").cast("int").alias("id_period"), (F.col("id") > OBSERVED_UNTIL).alias("is_extrapolated"))

    @property
    def runs(self) -> DataFrame:
        k = F.col("r_regionkey")
        return self.table("region").select(k.alias("id_run"), F.when(k > 0, F.floor((k - 1) / 2).cast("int")).alias("parent_id_run"))

    @property
    def pred_data(self) -> DataFrame:
        part, year = self.table("part"), (F.year("l_shipdate") - 1994).alias("id_period")
        key = F.col("p_partkey").cast("int").alias("id_coord")
        static = lambda i, c: part.select(F.lit(0).alias("id_period"), F.lit(i).alias("id_pred"), key, F.col(c).cast("double").alias("value"))
        sold = self.table("lineitem").groupBy(year, F.col("l_partkey").cast("int").alias("id_coord")).agg(F.count("*").cast("double").alias("3"), F.sum("l_quantity").alias("4"))
        dynamic = sold.unpivot(["id_period", "id_coord"], ["3", "4"], "id_pred", "value").select("id_period", F.col("id_pred").cast("int"), "id_coord", "value")
        return static(1, "p_size").where("id_coord % 7 <> 3").unionByName(static(2, "p_retailprice")).unionByName(dynamic)

    @property
    def potentials(self) -> DataFrame:
        t = self.spark.range(1, 5).select(F.col("id").cast("int").alias("id_trans"))
        out = self.coords.crossJoin(F.broadcast(t)).where("(id_coord + id_trans) % 5 <> 0")
        return out.select("id_trans", F.lit(6).alias("id_period_post"), "id_coord", (F.expr("(id_coord * 37 + id_trans * 11) % 100").cast("double") / 100).alias("value"))

    @property
    def rates(self) -> DataFrame:
        return self.spark.range(1, 4).select(F.lit(0).alias("id_run"), F.lit(6).alias("id_period"), F.col("id").cast("int").alias("id_trans"), (F.col("id").cast("double") / 10).alias("rate"))

    @property
    def overrides(self) -> DataFrame:
        """Classes by run: run 1 rewrites period 3, run 3 half of periods 3 and 5."""
        runs = self.runs.select("id_run")
        cond = "id_run = 0 or (id_run = 1 and id_period = 3) or (id_run = 3 and id_period in (3, 5) and id_coord % 2 = 0)"
        return self.lulc.crossJoin(F.broadcast(runs)).where(cond).select("id_run", "id_period", "id_coord", ((F.col("id_lulc") + F.col("id_run")) % 4 + 1).alias("id_lulc"))

    @property
    def models(self) -> DataFrame:
        """Model rows with scores that are strings; some have none."""
        t = self.spark.range(1, 5).select(F.col("id").cast("int").alias("id_trans"))
        kinds = self.spark.createDataFrame([("featureless", 1), ("ranger", 2), ("rpart", 3)], "learner_id string, k int")
        auc = F.expr("(id_run * 7 + id_trans * 13 + k * 29) % 50").cast("double") / 50
        scores = F.when(F.expr("(id_run + id_trans + k) % 6 = 0"), F.create_map(F.lit("classif.acc"), F.lit("0.5"))).otherwise(F.create_map(F.lit("classif.auc"), auc.cast("string")))
        return self.runs.select("id_run").crossJoin(t).crossJoin(kinds).select("id_run", "id_trans", "learner_id", scores.alias("crossval_score"))

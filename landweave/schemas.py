"""The fixed schema of every table: columns, keys, partitioning, how it is written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT, FLOAT, BOOL, TEXT, DATE, BLOB = T.IntegerType(), T.DoubleType(), T.BooleanType(), T.StringType(), T.DateType(), T.BinaryType()
MAP = T.MapType(TEXT, TEXT)
INTS = T.ArrayType(INT)
TEXTS = T.ArrayType(TEXT)
SOURCES = T.ArrayType(T.StructType([T.StructField("url", TEXT), T.StructField("md5sum", TEXT)]))
PRED_TYPES = ("int", "float", "bool", "factor", "ordered")


@dataclass(frozen=True)
class TableSpec:
    """One table. ``checks`` are SQL conditions that every row must meet."""

    name: str
    columns: tuple[tuple[str, T.DataType], ...]
    keys: tuple[str, ...]
    alternate: tuple[str, ...] = ()
    partitions: tuple[str, ...] = ()
    maps: tuple[str, ...] = ()
    mode: str = "upsert"
    checks: tuple[str, ...] = field(default=())

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in self.columns])

    def cast(self, df: DataFrame) -> DataFrame:
        """Columns of the schema first and cast, extra ones after them; ValueError on a missing one."""
        missing = [n for n, _ in self.columns if n not in df.columns]
        if missing:
            raise ValueError(f"{self.name} lacks columns {missing}")
        known = {n for n, _ in self.columns}
        return df.select(*[F.col(n).cast(t).alias(n) for n, t in self.columns], *[n for n in df.columns if n not in known])

    def validate(self, df: DataFrame) -> DataFrame:
        """Keys and partitions not null, keys unique, ``checks`` met; all in one aggregation and one look for duplicates."""
        solid = dict.fromkeys([*self.keys, *self.partitions])
        wrong = [F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in solid]
        wrong += [F.count_if(~F.coalesce(F.expr(c), F.lit(True))).alias(c) for c in self.checks]
        if wrong:
            found = {k: n for k, n in df.agg(*wrong).first().asDict().items() if n}
            if found:
                raise ValueError(f"{self.name} is invalid: {found}")
        for keys in filter(None, (self.keys, self.alternate)):
            if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
                raise ValueError(f"{self.name} has duplicate {keys}")
        return df


def _spec(name: str, columns: str, keys: str, alternate: str = "", partitions: str = "", maps: str = "", mode: str = "upsert", checks: tuple[str, ...] = ()) -> TableSpec:
    kinds = {"i": INT, "d": FLOAT, "b": BOOL, "s": TEXT, "D": DATE, "B": BLOB, "m": MAP, "ai": INTS, "as": TEXTS, "src": SOURCES}
    parsed = tuple((n, kinds[k]) for n, k in (c.split(":") for c in columns.split()))
    return TableSpec(name, parsed, tuple(keys.split()), tuple(alternate.split()), tuple(partitions.split()), tuple(maps.split()), mode, checks)


TABLES: dict[str, TableSpec] = {
    s.name: s
    for s in [
        _spec("coords_t", "id_coord:i lon:d lat:d elevation:d geom_polygon:s", "id_coord", mode="write_once"),
        _spec("periods_t", "id_period:i start_date:D end_date:D is_extrapolated:b", "start_date end_date", "id_period", mode="write_once", checks=("start_date <= end_date",)),
        _spec("lulc_meta_t", "id_lulc:i name:s pretty_name:s description:s src_classes:ai", "name", "id_lulc"),
        _spec("lulc_data_t", "id_run:i id_coord:i id_lulc:i id_period:i", "id_run id_coord id_period", partitions="id_run", checks=("id_lulc is not null",)),
        _spec("pred_meta_t", "id_pred:i name:s pretty_name:s description:s orig_format:s sources:src unit:s factor_levels:as data_type:s fill_value:s", "name", "id_pred", checks=(f"data_type in {PRED_TYPES}",)),
        _spec("pred_data_t", "id_run:i id_period:i id_pred:i id_coord:i value:d", "id_run id_period id_pred id_coord", partitions="id_run id_period"),
        _spec("trans_meta_t", "id_trans:i id_lulc_anterior:i id_lulc_posterior:i cardinality:i frequency_rel:d frequency_abs:d is_viable:b", "id_lulc_anterior id_lulc_posterior", "id_trans"),
        _spec("trans_preds_t", "id_run:i id_pred:i id_trans:i", "id_run id_pred id_trans", mode="overwrite"),
        _spec("trans_rates_t", "id_run:i id_period:i id_trans:i count:i rate:d", "id_run id_period id_trans", checks=("rate >= 0",)),
        _spec("trans_models_t", "id_run:i id_trans:i learner_id:s learner_params:m learner_spec:B crossval_score:m crossval_predictions:B learner_full:B", "id_run id_trans learner_id", partitions="id_run", maps="learner_params crossval_score"),
        _spec("trans_pot_t", "id_trans:i id_period_post:i id_coord:i value:d", "id_trans id_period_post id_coord", checks=("value between 0 and 1",)),
        _spec(
            "alloc_params_t",
            "id_run:i id_trans:i mean_patch_size:d patch_size_variance:d patch_elongation:d patch_isometry:d frac_expander:d frac_patcher:d similarity:d",
            "id_run id_trans",
            checks=("frac_expander between 0 and 1", "frac_patcher between 0 and 1"),
        ),
        _spec("neighbors_t", "id_coord_origin:i id_coord_neighbor:i distance:d distance_class:s", "id_coord_origin id_coord_neighbor", mode="write_once", checks=("distance >= 0",)),
        _spec("intrv_meta_t", "id_run:i id_intrv:i id_period_list:ai id_trans_list:ai pre_allocation:b name:s pretty_name:s description:s sources:src params:m", "id_run id_intrv", maps="params"),
        _spec("intrv_masks_t", "id_run:i id_intrv:i id_coord:i", "id_run id_intrv id_coord"),
        _spec("runs_t", "id_run:i parent_id_run:i description:s", "id_run"),
        _spec("reporting_t", "key:s value:s", "key"),
    ]
}

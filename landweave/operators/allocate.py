"""Allocation of change on a raster: multinomial draws and the growth of patches.

Growing patches is sequential within a raster, so runs are what goes in parallel: each
raster is one task's. Its rows arrive in batches and are kept as arrays only: some 40 bytes a cell,
and 8 for each potential of a cell that its transition can change.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def rook_neighbors(n_rows: int, n_cols: int) -> np.ndarray:
    """Up, down, left and right cell of each cell (row-major from 0); -1 beyond the edge."""
    i = np.arange(n_rows * n_cols)
    r, c = np.divmod(i, n_cols)
    return np.stack([np.where(r > 0, i - n_cols, -1), np.where(r < n_rows - 1, i + n_cols, -1), np.where(c > 0, i - 1, -1), np.where(c < n_cols - 1, i + 1, -1)])


def rook_table(cells: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """The same as columns of a table with ``cell`` from 1; 0 beyond the edge."""
    k = F.col("cell") - 1
    r, c = F.floor(k / n_cols), k % n_cols
    edge = lambda inside, to: F.when(inside, to).otherwise(0).cast("int")
    n = F.col("cell")
    return cells.select("cell", edge(r > 0, n - n_cols).alias("up"), edge(r < n_rows - 1, n + n_cols).alias("down"), edge(c > 0, n - 1).alias("left"), edge(c < n_cols - 1, n + 1).alias("right"))


def multinomial_states(probabilities: DataFrame, uniforms: DataFrame, stay: int | None = None) -> DataFrame:
    """One state for each cell by the inverse of the cumulative probabilities: the first whose sum exceeds
    the cell's uniform ``u``; the last state (or ``stay``) beyond all. Null and negative count as 0."""
    p = probabilities.withColumn("p", F.greatest(F.lit(0.0), F.coalesce(F.nanvl("p", F.lit(0.0)), F.lit(0.0))))
    upto = F.sum("p").over(Window.partitionBy("cell").orderBy("state").rowsBetween(Window.unboundedPreceding, 0))
    hit = p.withColumn("upto", upto).join(uniforms.hint("merge"), "cell").groupBy("cell").agg(F.min(F.when(F.col("u") < F.col("upto"), F.col("state"))).alias("s"), F.max("state").alias("last"))
    return hit.select("cell", F.coalesce("s", F.col("last") if stay is None else F.lit(stay)).alias("state"))


def _half_away(x: float) -> int:
    return int(np.floor(x + 0.5)) if x >= 0 else int(np.ceil(x - 0.5))


def sample_area(rng: np.random.Generator, mean: float, var: float, kind: str = "lognormal") -> int:
    """A patch's size, 1 at least: log-normal or normal with this mean and variance."""
    if mean is None or np.isnan(mean) or mean <= 0:
        return 1
    var = 0.0 if var is None or np.isnan(var) else var
    if kind == "normal":
        return max(1, _half_away(rng.normal(mean, np.sqrt(max(var, 0.0)))))
    var = var if var > 0 else 1.0
    s2 = np.log1p(var / mean**2)
    return max(1, _half_away(rng.lognormal(np.log(mean) - s2 / 2, np.sqrt(s2))))


@dataclass
class _Moments:
    n: float = 0.0
    r: float = 0.0
    c: float = 0.0
    rr: float = 0.0
    cc: float = 0.0
    rc: float = 0.0

    def add(self, r: int, c: int) -> None:
        self.n, self.r, self.c = self.n + 1, self.r + r, self.c + c
        self.rr, self.cc, self.rc = self.rr + r * r, self.cc + c * c, self.rc + r * c

    def with_each(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The elongation if each of these cells were added."""
        n = self.n + 1
        mr, mc = (self.r + r) / n, (self.c + c) / n
        a, b, d = (self.rr + r * r) / n - mr * mr, (self.cc + c * c) / n - mc * mc, (self.rc + r * c) / n - mr * mc
        mid, half = (a + b) / 2, np.sqrt(np.maximum(0, (a - b) ** 2 / 4 + d * d))
        high = mid + half
        return np.where(high > 0, 1 - np.sqrt(np.maximum(0, mid - half) / np.where(high > 0, high, 1)), 0.0)


class Landscape:
    """A raster in allocation: what each cell was (``before``) and is (``now``); -1 has no class."""

    def __init__(self, classes: np.ndarray, n_rows: int, n_cols: int):
        self.before, self.now, self.n_rows, self.n_cols = classes.copy(), classes.copy(), n_rows, n_cols

    def around(self, cell: int) -> list[int]:
        """Those of the up, down, left and right cell that there are."""
        r, c = divmod(cell, self.n_cols)
        return [x for x, inside in ((cell - self.n_cols, r > 0), (cell + self.n_cols, r < self.n_rows - 1), (cell - 1, c > 0), (cell + 1, c < self.n_cols - 1)) if inside]

    def grow(self, pivot: int, area: int, from_class: int, to_class: int, p: np.ndarray, shape: float, avoid: bool) -> tuple[int, list[int]]:
        """Grows a patch from ``pivot`` by the bordering cell with the largest potential per deviation from
        the wanted elongation, the first of equal ones. With ``avoid`` a patch that would touch
        another of its transition, or stays too small, isn't placed. The number of cells placed
        and the cells tried."""
        if not 0 <= pivot < len(self.now) or self.now[pivot] != from_class or self.before[pivot] != from_class:
            return 0, []
        patch, border, moments = [pivot], set(), _Moments()
        moments.add(*divmod(pivot, self.n_cols))
        inside = {pivot}

        def spread(cell: int) -> None:
            border.update(x for x in self.around(cell) if x not in inside)

        def foreign(cell: int) -> bool:
            return self.before[cell] == from_class and self.now[cell] == to_class

        spread(pivot)
        while len(patch) < area:
            if avoid and any(map(foreign, border)):
                return 0, patch
            free = np.array(sorted(x for x in border if self.before[x] == from_class and self.now[x] == from_class), dtype=np.int64)
            if not len(free):
                if avoid:
                    return 0, patch
                break
            r, c = np.divmod(free, self.n_cols)
            score = np.maximum(0, np.nan_to_num(p[free])) / (np.abs(moments.with_each(r, c) - shape) + EPS)
            best = int(free[int(np.argmax(score))])
            patch.append(best)
            inside.add(best)
            border.discard(best)
            moments.add(*divmod(best, self.n_cols))
            spread(best)
        if avoid and any(map(foreign, self.around(patch[-1]))):
            return 0, patch
        self.now[patch] = to_class
        return len(patch), patch


@dataclass
class OfClass:
    """Potentials of one class's cells, looked up by cell; ``rank`` numbers the cells of each class."""

    rank: np.ndarray
    values: np.ndarray

    def __getitem__(self, cells: np.ndarray) -> np.ndarray:
        return self.values[self.rank[cells]]


@dataclass
class Transition:
    """One transition with its potentials: dense over the raster, or of its class's cells."""

    from_class: int
    to_class: int
    p: np.ndarray | OfClass
    area_mean: float = 1.0
    area_var: float = 0.0
    elongation: float = 0.5
    rate: float = 0.0

    def pivots(self, cells: np.ndarray, rarefy: bool) -> np.ndarray:
        p = np.maximum(0, np.nan_to_num(self.p[cells]))
        return p / self.area_mean if rarefy and not np.isnan(self.area_mean) and self.area_mean > 1 else p


def _draw(rng: np.random.Generator, probabilities: np.ndarray) -> np.ndarray:
    """Per column the first row whose cumulative probability exceeds a uniform, or -1."""
    upto = np.cumsum(probabilities, axis=0)
    hit = rng.random(upto.shape[1]) < upto
    return np.where(hit.any(axis=0), hit.argmax(axis=0), -1)


def allocate(land: Landscape, transitions: list[Transition], rng: np.random.Generator, *, single_cells: bool, batch_size: int = 0, rarefy: bool = True, shuffle: bool = True, avoid: bool = True, area_kind: str = "lognormal") -> np.ndarray:
    """All transitions of one period, class by class. With ``single_cells`` each cell is drawn once; else
    patches grow from drawn pivots until a transition has changed its rate of the class's
    cells. ``batch_size`` pivots are tried per draw: 0 is a hundredth of the class, below 0 all.
    """
    for from_class in sorted({t.from_class for t in transitions}):
        own = [t for t in transitions if t.from_class == from_class]
        pool = np.flatnonzero((land.now == from_class) & (land.before == from_class))
        if not len(pool):
            continue
        if single_cells:
            state = _draw(rng, np.stack([t.pivots(pool, rarefy) for t in own]))
            for q, t in enumerate(own):
                land.now[pool[state == q]] = t.to_class
            continue
        left = np.array([max(0.0, np.nan_to_num(t.rate)) * len(pool) for t in own])
        size = batch_size if batch_size > 0 else (len(pool) if batch_size < 0 else max(1, len(pool) // 100))
        failed = np.zeros(len(land.now), dtype=bool)
        while (left > 0).any():
            pool = pool[~failed[pool] & (land.now[pool] == from_class)]
            if not len(pool):
                break
            state = _draw(rng, np.stack([t.pivots(pool, rarefy) * (left[q] > 0) for q, t in enumerate(own)]))
            drawn = np.flatnonzero(state >= 0)
            if not len(drawn):
                break
            if shuffle:
                drawn = rng.permutation(drawn)
            tried = 0
            for i in drawn:
                q, cell = int(state[i]), int(pool[i])
                if tried >= size:
                    break
                if left[q] <= 0 or failed[cell] or land.now[cell] != from_class:
                    continue
                t = own[q]
                n, cells = land.grow(cell, sample_area(rng, t.area_mean, t.area_var, area_kind), from_class, t.to_class, t.p, t.elongation, avoid)
                tried += 1
                if n:
                    left[q] -= n
                else:
                    failed[cells] = True
    return land.now


def transition_inputs(trans: DataFrame, params: DataFrame, rates: DataFrame) -> DataFrame:
    """Every transition with its parameters and rate: without one a mean area of 1, an elongation of 0.5, a rate of 0."""
    d = trans.select("id_trans", "id_lulc_anterior", "id_lulc_posterior").join(params.select("id_trans", "area_mean", "area_var", "elongation"), "id_trans", "left")
    d = d.join(rates.select("id_trans", "rate"), "id_trans", "left")
    return d.withColumns({"area_mean": F.coalesce("area_mean", F.lit(1.0)), "elongation": F.coalesce("elongation", F.lit(0.5)), "rate": F.coalesce("rate", F.lit(0.0))})


def allocate_runs(cells: DataFrame, potentials: DataFrame, transitions: DataFrame, seed: int = 0, **options) -> DataFrame:
    """Allocation of one period for every run at once.

    ``cells``: id_run, id_coord, row, col, id_lulc. ``potentials``: id_run, id_trans, id_coord,
    value. ``transitions``: id_run, id_trans, id_lulc_anterior, id_lulc_posterior, area_mean,
    area_var, elongation, rate. The result is id_run, id_coord, id_lulc. A missing elongation is
    0.5, a missing rate 0; single cells are drawn where every mean area of a run is 1 without variance.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = None
        for batch in batches:
            # Rows come by run and kind; pieces of a batch have one of each.
            of = np.stack([batch.column(c).to_numpy() for c in ("id_run", "kind")])
            cuts = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if run is None or run.id_run != of[0, a]:
                    if run is not None:
                        yield from run.allocated(seed, options)
                    run = _Run(int(of[0, a]))
                run.take(int(of[1, a]), batch.slice(a, b - a))
        if run is not None:
            yield from run.allocated(seed, options)

    cols = lambda kind, k, id_coord, row, col, value, params: [F.col("id_run").cast("int").alias("id_run"), F.lit(kind).alias("kind"), F.col(k).cast("int").alias("k"), *[x.cast(t).alias(n) for x, t, n in ((id_coord, "int", "id_coord"), (row, "int", "row"), (col, "int", "col"), (value, "double", "value"), (params, "array<double>", "params"))]]
    no = F.lit(None)
    params = F.array(*[F.col(c).cast("double") for c in ("id_lulc_anterior", "id_lulc_posterior", "area_mean", "area_var", "elongation", "rate")])
    a = transitions.select(*cols(_TRANSITION, "id_trans", no, no, no, no, params))
    b = cells.select(*cols(_CELL, "id_lulc", F.col("id_coord"), F.col("row"), F.col("col"), no, no))
    c = potentials.select(*cols(_POTENTIAL, "id_trans", F.col("id_coord"), no, no, F.col("value"), no))
    # A given number of partitions, as Spark would put small runs into one task.
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.union(b).union(c).repartition(n, "id_run").sortWithinPartitions("id_run", "kind").mapInArrow(work, "id_run int, id_coord int, id_lulc int")


#: Kinds of rows, in the order in which a run takes them.
_TRANSITION, _CELL, _POTENTIAL = range(3)
_BATCH = 65_536


class _Run:
    """The raster of one run, filled from batches of rows."""

    def __init__(self, id_run: int):
        self.id_run, self.own, self.parts = id_run, {}, []
        self.classes: np.ndarray | None = None

    def take(self, kind: int, rows: pa.RecordBatch) -> None:
        if kind == _TRANSITION:
            for k, params in zip(rows.column("k").to_pylist(), rows.column("params").to_pylist()):
                a, b, mean, var, shape, rate = (np.nan if x is None else x for x in params)
                self.own[k] = Transition(int(a), int(b), np.empty(0), mean, float(np.nan_to_num(var)), 0.5 if np.isnan(shape) else shape, float(np.nan_to_num(rate)))
        elif kind == _CELL:
            self.parts.append([rows.column(c).fill_null(-1).to_numpy().copy() for c in ("id_coord", "row", "col", "k")])
        elif self.parts or self.classes is not None:
            self._fill()
            self._potentials(rows)

    def _fill(self) -> None:
        """Cells to arrays, once all are there."""
        if self.classes is not None:
            return
        self.ids, r, c, k = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        self.n_rows, self.n_cols = int(r.max()) + 1, int(c.max()) + 1
        size = self.n_rows * self.n_cols
        self.at = r.astype(np.int32 if size < 1 << 31 else np.int64)
        self.at *= self.n_cols
        self.at += c
        del r, c
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.at, k = self.ids[order], self.at[order], k[order]
        self.classes = np.full(size, -1, dtype=np.int32)
        self.classes[self.at] = k
        self.rank, n = np.zeros(size, dtype=self.at.dtype), {}
        for f in {t.from_class for t in self.own.values()}:
            of = np.flatnonzero(self.classes == f)
            self.rank[of], n[f] = np.arange(len(of)), len(of)
        for t in self.own.values():
            t.p = OfClass(self.rank, np.zeros(n[t.from_class]))

    def _potentials(self, rows: pa.RecordBatch) -> None:
        k, ids = rows.column("k").fill_null(-1).to_numpy(), rows.column("id_coord").fill_null(-1).to_numpy()
        value = rows.column("value").to_numpy(zero_copy_only=False)
        i = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        at, known = self.at[i], self.ids[i] == ids
        for x in np.unique(k).tolist():
            t = self.own.get(x)
            if t is not None:
                some = known & (k == x) & (self.classes[at] == t.from_class)
                t.p.values[self.rank[at[some]]] = value[some]

    def allocated(self, seed: int, options: dict) -> Iterator[pa.RecordBatch]:
        if not self.parts and self.classes is None:
            return
        self._fill()
        own = [self.own[k] for k in sorted(self.own)]
        now = self.classes
        if own:
            single = all(t.area_mean == 1 and t.area_var == 0 for t in own)
            now = allocate(Landscape(self.classes, self.n_rows, self.n_cols), own, np.random.default_rng([seed, self.id_run]), single_cells=single, **options)
        for i in range(0, len(self.ids), _BATCH):
            k = now[self.at[i : i + _BATCH]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), self.id_run, dtype=np.int32)), pa.array(self.ids[i : i + _BATCH]), pa.array(k, mask=k < 0)], names=["id_run", "id_coord", "id_lulc"])

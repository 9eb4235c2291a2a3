"""Transition models: learners, stratified splits, measures, filter scores.

A learner is anything with ``fit(x, y, weights)`` and ``predict(x)``; fits run in parallel,
one (run, transition) a group of ``applyInPandas``. What is distributed is the number of
models; each one's training matrix is a task's.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Featureless:
    """Predicts the share of positives."""

    learner_id: str = "classif.featureless"
    prior: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> Featureless:
        self.prior = float(np.average(y, weights=weights)) if len(y) else 0.0
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.prior)

    def params(self) -> dict:
        return {}


@dataclass
class Shares:
    """Predicts the share of positives among the rows with the same value of one feature; of all rows for a new value."""

    learner_id: str = "classif.shares"
    feature: int = 0
    prior: float = 0.0
    values: np.ndarray | None = None
    shares: np.ndarray | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> Shares:
        self.prior = float(np.average(y, weights=weights)) if len(y) else 0.0
        self.values, at = np.unique(x[:, self.feature], return_inverse=True)
        w = np.ones(len(y)) if weights is None else weights
        self.shares = np.bincount(at, w * y, len(self.values)) / np.bincount(at, w, len(self.values))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature]
        if not len(self.values):
            return np.full(len(v), self.prior)
        at = np.minimum(np.searchsorted(self.values, v), len(self.values) - 1)
        known = (self.values[at] == v) | (np.isnan(self.values[at]) & np.isnan(v))
        return np.where(known, self.shares[at], self.prior)

    def params(self) -> dict:
        return {"feature": self.feature}


@dataclass
class Coded:
    """The columns of a matrix as their distinct values and each row's number among them."""

    values: list[np.ndarray]
    codes: list[np.ndarray]

    @classmethod
    def of(cls, x: np.ndarray) -> Coded:
        both = [np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1])]
        return cls([v for v, _ in both], [c.astype(np.int32) for _, c in both])

    def at(self, rows: np.ndarray) -> Coded:
        return Coded(self.values, [c[rows] for c in self.codes])


def counted_quantiles(values: np.ndarray, upto: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What ``np.quantile`` gives for sorted distinct values of which the first i + 1 stand for ``upto[i]`` rows."""
    at = q * (upto[-1] - 1)
    low = np.floor(at)
    a, b = (values[np.searchsorted(upto, np.minimum(k, upto[-1] - 1), "right")] for k in (low, low + 1))
    t = at - low
    return np.where(t < 0.5, a + (b - a) * t, b - (b - a) * (1 - t))


@dataclass
class Tree:
    """A classification tree by Gini gain; missing values go with the smaller ones.

    ``penalty`` scales the gain of a feature that ``used`` doesn't hold yet.
    """

    learner_id: str = "classif.rpart"
    max_depth: int = 8
    min_leaf: int = 5
    max_features: int | None = None
    bins: int = 64
    seed: int = 0
    nodes: list = field(default_factory=list)
    importance: np.ndarray | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, penalty: np.ndarray | None = None, used: set[int] | None = None, coded: Coded | None = None) -> Tree:
        x = np.where(np.isnan(x), -np.inf, x)
        w = np.ones(len(y)) if weights is None else weights
        self._coded = Coded.of(x) if coded is None else coded
        self.nodes, self.importance = [], np.zeros(x.shape[1])
        rng, used = np.random.default_rng(self.seed), set() if used is None else used
        self._split(x, y.astype(float), w, np.arange(len(y)), 0, rng, penalty, used)
        del self._coded
        return self

    def _cuts(self, x: np.ndarray, rows: np.ndarray, f: int) -> tuple[np.ndarray, np.ndarray]:
        """A feature's cuts at some rows, and how many of them lie below each row's value. Where there are fewer values
        than rows they are counted, which gives the same without a sort."""
        values, codes = self._coded.values[f], self._coded.codes[f]
        if len(values) > len(rows):
            v = x[rows, f]
            finite = v[np.isfinite(v)]
            cuts = np.unique(np.quantile(finite, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(finite) > self.bins else np.unique(finite)[:-1]
            return cuts, np.searchsorted(cuts, v, "left")
        code = codes[rows]
        n = np.bincount(code, minlength=len(values))
        seen = np.isfinite(values) & (n > 0)
        finite, upto = values[seen], np.cumsum(n[seen])
        if len(finite) and upto[-1] > self.bins:
            finite = np.unique(counted_quantiles(finite, upto, np.linspace(0, 1, self.bins + 1)[1:-1]))
        else:
            finite = finite[:-1]
        return finite, np.searchsorted(finite, values, "left")[code]

    def _split(self, x, y, w, rows, depth, rng, penalty, used) -> int:
        me = len(self.nodes)
        own = w[rows]
        positive = own * y[rows]
        total = own.sum()
        p = float(positive.sum() / total) if total else 0.0
        self.nodes.append((-1, 0.0, p, -1, -1))
        if depth >= self.max_depth or len(rows) < 2 * self.min_leaf or p in (0.0, 1.0):
            return me
        features = np.arange(x.shape[1])
        if self.max_features and self.max_features < len(features):
            features = rng.choice(features, self.max_features, replace=False)
        best, left = (1e-12, -1, 0.0), None
        for f in features.tolist():
            cuts, at = self._cuts(x, rows, f)
            if not len(cuts):
                continue
            n = np.cumsum(np.bincount(at, own, len(cuts) + 1))
            pos = np.cumsum(np.bincount(at, positive, len(cuts) + 1))
            size = np.cumsum(np.bincount(at, minlength=len(cuts) + 1))[:-1]
            nl, nr, pl = n[:-1], n[-1] - n[:-1], pos[:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = pl * pl / nl + (pos[-1] - pl) ** 2 / nr - pos[-1] ** 2 / n[-1]
            gain[(size < self.min_leaf) | (len(rows) - size < self.min_leaf) | ~np.isfinite(gain)] = 0
            if penalty is not None and f not in used:
                gain = gain * penalty[f]
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best, left = (float(gain[k]), f, float(cuts[k])), at <= k
        if best[1] < 0:
            return me
        gain, f, cut = best
        used.add(f)
        self.importance[f] += gain
        a = self._split(x, y, w, rows[left], depth + 1, rng, penalty, used)
        b = self._split(x, y, w, rows[~left], depth + 1, rng, penalty, used)
        self.nodes[me] = (f, cut, p, a, b)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), -np.inf, x)
        at = np.zeros(len(x), dtype=np.int64)
        feature, cut, p, left, right = (np.array(c) for c in zip(*self.nodes))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return p[at].astype(float)
            i = np.flatnonzero(inner)
            goes = x[i, feature[at[i]]] <= cut[at[i]]
            at[i] = np.where(goes, left[at[i]], right[at[i]])

    def params(self) -> dict:
        return {"max_depth": self.max_depth, "min_leaf": self.min_leaf}


@dataclass
class Forest:
    """Bagged trees over random features; with ``gamma`` a guided regularised forest: a plain forest's
    importances first, then one in which a new feature must gain 1 / penalty times as much."""

    learner_id: str = "classif.ranger"
    n_trees: int = 50
    max_depth: int = 10
    gamma: float | None = None
    seed: int = 0
    trees: list = field(default_factory=list)

    def _grow(self, x, y, w, penalty, coded) -> np.ndarray:
        rng, self.trees, used = np.random.default_rng(self.seed), [], set()
        m = max(1, int(np.sqrt(x.shape[1])))
        for k in range(self.n_trees):
            rows = rng.integers(0, len(y), len(y))
            self.trees.append(Tree(max_depth=self.max_depth, max_features=m, seed=self.seed + k).fit(x[rows], y[rows], w[rows], penalty, used if penalty is not None else None, coded.at(rows)))
        return np.mean([t.importance for t in self.trees], axis=0)

    def fit(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> Forest:
        w = balanced_weights(y) if weights is None else weights
        coded = Coded.of(np.where(np.isnan(x), -np.inf, x))
        self.importance = self._grow(x, y, w, None, coded)
        if self.gamma is not None:
            top = self.importance.max()
            self.importance = self._grow(x, y, w, (1 - self.gamma) + self.gamma * (self.importance / top if top > 0 else self.importance), coded)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0)

    def params(self) -> dict:
        return {"n_trees": self.n_trees, "max_depth": self.max_depth} | ({} if self.gamma is None else {"gamma": self.gamma})


def balanced_weights(y: np.ndarray) -> np.ndarray:
    """n / (number of classes * size of the class)."""
    classes, at, n = np.unique(y, return_inverse=True, return_counts=True)
    return (len(y) / (len(classes) * n))[at] if len(y) else np.empty(0)


def auc(y: np.ndarray, p: np.ndarray) -> float:
    """By average ranks; NaN where a class is missing."""
    pos = int(np.sum(y == 1))
    if not pos or pos == len(y):
        return float("nan")
    rank = pd.Series(p).rank().to_numpy()
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))


def accuracy(y: np.ndarray, p: np.ndarray) -> float:
    return float(np.mean((p > 0.5) == (y == 1)))


MEASURES: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {"classif.auc": auc, "classif.acc": accuracy}


def auc_by(df: DataFrame, *group: str, label: str = "label", score: str = "score") -> DataFrame:
    """The area under the ROC curve per group, in built-in operators: average ranks by window.
    Where the groups are few and large, ranks come from one sort of the distinct scores."""
    per = df.groupBy(*group, score).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"))
    before = Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2.0)
    sums = ranked.groupBy(*group).agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum("n").cast("double").alias("t"))
    return sums.select(*group, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("t") - F.col("p"))).alias("auc"))


def accuracy_by(df: DataFrame, *group: str, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """The share of rows per group whose label is what was predicted."""
    return df.groupBy(*group).agg(F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("acc"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``weight``: rows / (classes * rows of the class). The sums go back by broadcast: a row a class."""
    n = df.groupBy(label).agg(F.count("*").cast("double").alias("n")).agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.collect_list(F.struct(label, "n")).alias("each"))
    per = n.select("total", "k", F.inline("each")).select(label, (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))
    return df.join(F.broadcast(per), label)


PREDICTIONS = "id_run int, id_trans int, learner_id string, row int, truth int, prediction double"


def crossval_predictions(models: DataFrame) -> DataFrame:
    """(id_run, id_trans, learner_id, row, truth, prediction) of the rows that stored models were scored on."""

    def unpack(parts):
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                y, p = pickle.loads(bytes(r.crossval_predictions))
                yield pd.DataFrame({"id_run": r.id_run, "id_trans": r.id_trans, "learner_id": r.learner_id, "row": np.arange(len(y)), "truth": y, "prediction": p})

    return models.where("crossval_predictions is not null").select("id_run", "id_trans", "learner_id", "crossval_predictions").mapInPandas(unpack, PREDICTIONS)


def stratified(df: DataFrame, share: float, seed: int, *by: str, key: str = "id_coord") -> DataFrame:
    """``df`` with ``is_train``: within each stratum the given share of rows, in the order of a hash of their key."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), key), key))
    return df.withColumn("is_train", rank <= F.rint(F.count("*").over(w) * share))


MODEL_SCHEMA = "id_run int, id_trans int, learner_id string, learner_params map<string,string>, learner_spec binary, crossval_score map<string,string>, crossval_predictions binary, learner_full binary"


Features = Sequence[str] | Mapping[int, Sequence[str]]


def _of(features: Features, id_trans: int) -> list[str]:
    """The features of a transition: all have the same, or each its own."""
    return list(features[id_trans] if isinstance(features, Mapping) else features)


def _matrix(pdf: pd.DataFrame, names: list[str]) -> np.ndarray:
    return pdf[names].to_numpy(dtype=float) if names else np.empty((len(pdf), 0))


def fit_partial(training: DataFrame, features: Features, learner: object, measures: Sequence[str] = ("classif.auc", "classif.acc"), share: float = 0.7, seed: int = 1) -> DataFrame:
    """Per (id_run, id_trans) a learner fitted on the train part of ``training`` (with is_train) and scored
    on the rest. A failure is a row with learner_id "error" and the reason as its score."""
    measures = list(measures)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        run, trans = int(pdf["id_run"].iloc[0]), int(pdf["id_trans"].iloc[0])
        try:
            y = pdf["did_transition"].to_numpy().astype(int)
            x = _matrix(pdf, _of(features, trans))
            train = pdf["is_train"].to_numpy()
            model = pickle.loads(pickle.dumps(learner)).fit(x[train], y[train])
            p = model.predict(x[~train])
            scores = {m: repr(MEASURES[m](y[~train], p)) for m in measures}
            row = (run, trans, model.learner_id, {k: str(v) for k, v in model.params().items()}, pickle.dumps(learner), scores, pickle.dumps((y[~train], p)), None)
        except Exception as e:  # noqa: BLE001 - a failed fit is a result
            row = (run, trans, "error", {}, None, {"error": str(e)[:200]}, None, None)
        return pd.DataFrame([row], columns=[c.split()[0] for c in MODEL_SCHEMA.split(", ")])

    d = stratified(training, share, seed, "id_run", "id_trans", "did_transition") if "is_train" not in training.columns else training
    return d.groupBy("id_run", "id_trans").applyInPandas(fit, MODEL_SCHEMA)


def fit_full(training: DataFrame, features: Features, chosen: DataFrame | None = None, learner: object | None = None) -> DataFrame:
    """Models fitted on all rows: of one ``learner`` (with the score no.crossval = 1), or of each (run,
    transition)'s row in ``chosen`` (learner_spec and crossval_score)."""
    if (chosen is None) == (learner is None):
        raise ValueError("give a learner or chosen models")

    def fit(key: tuple, pdf: pd.DataFrame, spec: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in MODEL_SCHEMA.split(", ")]
        if not len(pdf) or (learner is None and not len(spec)):
            return pd.DataFrame(columns=columns)
        y = pdf["did_transition"].to_numpy().astype(int)
        x = _matrix(pdf, _of(features, int(key[1])))
        raw = pickle.dumps(learner) if learner is not None else spec["learner_spec"].iloc[0]
        scores = {"no.crossval": "1"} if learner is not None else dict(spec["crossval_score"].iloc[0])
        model = pickle.loads(raw).fit(x, y)
        row = (int(key[0]), int(key[1]), model.learner_id, {k: str(v) for k, v in model.params().items()}, raw, scores, None, pickle.dumps(model))
        return pd.DataFrame([row], columns=columns)

    of = chosen if chosen is not None else training.sparkSession.createDataFrame([], MODEL_SCHEMA)
    return training.groupBy("id_run", "id_trans").cogroup(of.groupBy("id_run", "id_trans")).applyInPandas(fit, MODEL_SCHEMA)


def fit_spread(training: DataFrame, features: Features, max_depth: int = 8, min_leaf: int = 5, n_trees: int = 1, seed: int = 0, bins: int = 64) -> DataFrame:
    """Trees (n_trees = 1) or forests of matrices that are larger than a task: every fit is spread over the cluster
    by pyspark.ml, one (run, transition) after another, and comes back as a :class:`Tree` or
    :class:`Forest`. Missing values go with the smaller ones, as there."""
    from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows, low = [], -1e300
    for run, trans in sorted(tuple(r) for r in training.select("id_run", "id_trans").distinct().collect()):
        names = _of(features, trans)
        d = training.where((F.col("id_run") == run) & (F.col("id_trans") == trans))
        filled = d.select(F.col("did_transition").cast("double").alias("label"), *[F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(None)), F.lit(low)).alias(n) for n in names])
        plain = {"labelCol": "label", "featuresCol": "x", "maxDepth": max_depth, "minInstancesPerNode": min_leaf, "maxBins": bins, "seed": seed, "impurity": "gini"}
        kind = DecisionTreeClassifier(**plain) if n_trees == 1 else RandomForestClassifier(numTrees=n_trees, **plain)
        fitted = kind.fit(VectorAssembler(inputCols=names, outputCol="x").transform(filled).select("label", "x"))
        trees = [_from_ml(t, len(names), max_depth, min_leaf) for t in ([fitted] if n_trees == 1 else fitted.trees)]
        model = trees[0] if n_trees == 1 else Forest(n_trees=n_trees, max_depth=max_depth, seed=seed, trees=trees)
        rows.append((run, trans, model.learner_id, {k: str(v) for k, v in model.params().items()}, None, {"no.crossval": "1"}, None, pickle.dumps(model)))
    return training.sparkSession.createDataFrame(rows, MODEL_SCHEMA)


def _from_ml(fitted, n_features: int, max_depth: int, min_leaf: int) -> Tree:
    """A tree of pyspark.ml with its nodes in a list."""
    tree = Tree(max_depth=max_depth, min_leaf=min_leaf, nodes=[], importance=fitted.featureImportances.toArray() if n_features else np.zeros(0))

    def add(node) -> int:
        me = len(tree.nodes)
        stats = list(node.impurityStats().stats())
        total = sum(stats)
        p = stats[1] / total if len(stats) > 1 and total else 0.0
        tree.nodes.append((-1, 0.0, p, -1, -1))
        if node.subtreeDepth():
            split = node.split()
            left, right = add(node.leftChild()), add(node.rightChild())
            tree.nodes[me] = (split.featureIndex(), split.threshold(), p, left, right)
        return me

    add(fitted._java_obj.rootNode())
    return tree


def predict(rows: DataFrame, features: Features, models: DataFrame) -> DataFrame:
    """Potentials in [0, 1] of ``rows`` (id_trans, id_coord and the features). Models are small and travel
    with their transition's rows, which are scored batch by batch without grouping."""
    held = rows.sparkSession.sparkContext.broadcast({r["id_trans"]: bytes(r["learner_full"]) for r in models.select("id_trans", "learner_full").collect()})

    def score(parts):
        loaded = {k: pickle.loads(v) for k, v in held.value.items()}
        for pdf in parts:
            for trans, some in pdf.groupby("id_trans"):
                if trans in loaded:
                    x = _matrix(some, _of(features, int(trans)))
                    yield pd.DataFrame({"id_trans": some["id_trans"], "id_coord": some["id_coord"], "value": np.clip(loaded[trans].predict(x), 0, 1)})

    names = sorted({n for own in features.values() for n in own}) if isinstance(features, Mapping) else features
    return rows.select("id_trans", "id_coord", *names).mapInPandas(score, "id_trans int, id_coord int, value double")


def filter_scores(training: DataFrame, features: Features, kind: str = "correlation", learner: object | None = None, folds: int = 2, seed: int = 1) -> DataFrame:
    """(id_run, id_trans, feature, score): |correlation| with the label in built-in operators; or by
    ``learner`` the cross-validated AUC with the feature alone (performance), or importances."""
    if kind == "correlation":
        y = F.col("did_transition").cast("double")
        names = sorted({n for own in features.values() for n in own}) if isinstance(features, Mapping) else list(features)
        wide = training.groupBy("id_run", "id_trans").agg(*[F.abs(F.corr(F.col(f).cast("double"), y)).alias(f) for f in names])
        out = wide.unpivot(["id_run", "id_trans"], names, "feature", "score").withColumn("score", F.nanvl("score", F.lit(None)))
        if isinstance(features, Mapping):
            out = out.where(functools.reduce(Column.__or__, [(F.col("id_trans") == t) & F.col("feature").isin(list(own)) for t, own in features.items()], F.lit(False)))
        return out

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names = _of(features, int(pdf["id_trans"].iloc[0]))
        y, x = pdf["did_transition"].to_numpy().astype(int), _matrix(pdf, names)
        try:
            if kind == "importance":
                scores = pickle.loads(pickle.dumps(learner)).fit(x, y).importance
            else:
                fold = np.random.default_rng(seed).permutation(len(y)) % folds
                scores = [np.mean([auc(y[fold == k], pickle.loads(pickle.dumps(learner)).fit(x[fold != k][:, [j]], y[fold != k]).predict(x[fold == k][:, [j]])) for k in range(folds)]) for j in range(len(names))]
        except Exception:  # noqa: BLE001 - a failed filter has no score
            scores = [np.nan] * len(names)
        return pd.DataFrame({"id_run": int(pdf["id_run"].iloc[0]), "id_trans": int(pdf["id_trans"].iloc[0]), "feature": names, "score": scores})

    return training.groupBy("id_run", "id_trans").applyInPandas(one, "id_run int, id_trans int, feature string, score double").withColumn("score", F.nanvl("score", F.lit(None)))

"""Classifiers of comparison vectors.

A vector table has two id columns, then one column per feature.  Fitting needs counts only: naive Bayes one
grouped count per feature, expectation maximisation the distinct vectors with their counts (solved on the
driver up to ``max_patterns`` patterns, by grouped sums beyond that), k-means weighted sums per round, and
the linear models Spark ML.  Prediction is a Column expression, so it stays lazy and inside the scan's stage.
"""

from __future__ import annotations

import inspect
import math
import warnings
from collections.abc import Sequence
from functools import reduce
from typing import Any

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlink.options import get_option
from pairlink.scratch import Scratch


class NotFittedError(ValueError):
    """Prediction asked of a classifier without parameters."""


class LearningError(ValueError):
    """Training data from which nothing can be learnt."""


def _features(vectors: DataFrame) -> list[str]:
    return vectors.columns[2:]


def with_labels(vectors: DataFrame, matches: DataFrame) -> DataFrame:
    """``vectors`` with ``label`` 1 for the pairs in ``matches`` and 0 for the others."""
    if not isinstance(matches, DataFrame):
        raise ValueError("matches must be a DataFrame of pairs")
    one, two = vectors.columns[:2]
    m = matches.select(F.col(matches.columns[0]).alias(one), F.col(matches.columns[1]).alias(two)).distinct().withColumn("label", F.lit(1))
    return vectors.join(m, [one, two], "left").withColumn("label", F.coalesce("label", F.lit(0))).select(*vectors.columns, "label")


class PairClassifier:
    """Base: subclasses give ``_fit`` and ``_score`` (log odds of a match), or ``_decide`` where there are no probabilities."""

    fitted = False
    supervised = True

    def fit(self, vectors: DataFrame, match_index: DataFrame | None = None) -> PairClassifier:
        if not self.supervised:
            data = vectors
        elif match_index is None:
            raise ValueError("a supervised classifier needs the matches")
        else:
            data = with_labels(vectors, match_index)
        if vectors.isEmpty():
            raise ValueError("the training vectors are empty")
        self._fit(data, _features(vectors))
        self.fitted = True
        return self

    def learn(self, vectors: DataFrame, match_index: DataFrame | None = None, return_type: str | None = None):
        warnings.warn("learn is deprecated, use fit_predict", DeprecationWarning, stacklevel=2)
        return self.fit_predict(vectors, match_index)

    def fit_predict(self, vectors: DataFrame, match_index: DataFrame | None = None):
        return self.fit(vectors, match_index).predict(vectors)

    def _check(self) -> None:
        if not self.fitted:
            raise NotFittedError(f"this {type(self).__name__} is not fitted yet")

    def predict(self, vectors: DataFrame):
        """The links, the labelled pairs or a local array, by option classification.return_type."""
        self._check()
        one, two = vectors.columns[:2]
        labelled = vectors.select(one, two, self._decide(_features(vectors)).cast("int").alias("classification"))
        kind = get_option("classification.return_type")
        if kind == "index":
            return labelled.filter("classification = 1").select(one, two)
        return labelled if kind == "series" else np.array([r[0] for r in labelled.select("classification").collect()])

    def prob(self, vectors: DataFrame) -> DataFrame:
        """The pairs with the probability of a match."""
        self._check()
        one, two = vectors.columns[:2]
        return vectors.select(one, two, (1 / (1 + F.exp(-self._score(_features(vectors))))).alias("prob"))

    def _decide(self, features: Sequence[str]) -> Column:
        return self._score(features) > 0

    def _score(self, features: Sequence[str]) -> Column:
        raise AttributeError(f"{type(self).__name__} has no probabilities")

    def _fit(self, data: DataFrame, features: Sequence[str]) -> None:
        raise NotImplementedError


BaseClassifier = PairClassifier


def sum_rule(vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose features add up to more than ``threshold``."""
    total = reduce(Column.__add__, (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in _features(vectors)))
    return vectors.filter(total > threshold).select(*vectors.columns[:2])


class _Linear(PairClassifier):
    def __init__(self, coefficients: Sequence[float] | None = None, intercept: float | None = None):
        self.coefficients = None if coefficients is None else [float(x) for x in coefficients]
        self.intercept = None if intercept is None else float(intercept)
        self.fitted = self.coefficients is not None and self.intercept is not None

    @property
    def params(self) -> dict[str, Any]:
        return {"coefficients": self.coefficients, "intercept": self.intercept}

    def _plane(self, features: Sequence[str]) -> Column:
        if len(features) != len(self.coefficients):
            raise ValueError("as many coefficients as features are needed")
        return reduce(Column.__add__, (F.col(f).cast("double") * w for f, w in zip(features, self.coefficients)), F.lit(self.intercept))

    def _assembled(self, data: DataFrame, features: Sequence[str]) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        # equal vectors are one weighted row
        counted = data.groupBy(*features, "label").agg(F.count("*").cast("double").alias("__w"))
        counted = counted.select(*(F.col(f).cast("double").alias(f) for f in features), F.col("label").cast("double").alias("label"), "__w")
        return VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="error").transform(counted)


class LogisticRegressionClassifier(_Linear):
    """Logistic regression with an L2 penalty; given coefficients and intercept it is deterministic linkage."""

    def __init__(self, coefficients=None, intercept=None, C: float = 1.0, max_iter: int = 100):
        super().__init__(coefficients, intercept)
        self.C, self.max_iter = C, max_iter

    def _fit(self, data, features):
        from pyspark.ml.classification import LogisticRegression

        x = self._assembled(data, features)
        n = x.agg(F.sum("__w")).first()[0]
        model = LogisticRegression(featuresCol="__x", labelCol="label", weightCol="__w", regParam=1 / (self.C * n), elasticNetParam=0.0, standardization=False, maxIter=self.max_iter, tol=1e-8).fit(x)
        self.coefficients, self.intercept = [float(w) for w in model.coefficients], float(model.intercept)

    def _score(self, features):
        return self._plane(features)


class SVMClassifier(_Linear):
    """Linear support vector machine: squared hinge loss, L2 penalty on the coefficients and the intercept.

    Newton's method: every round is one grouped sum of gradient and curvature over the distinct weighted
    vectors inside the margin, and a step that is halved until the objective falls.
    """

    def __init__(self, C: float = 1.0, max_iter: int = 100, tol: float = 1e-8):
        super().__init__()
        self.C, self.max_iter, self.tol = C, max_iter, tol

    def _fit(self, data, features):
        scratch = Scratch(data.sparkSession, "svm")
        x = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
        points = data.groupBy(*features, "label").agg(F.count("*").cast("double").alias("__w"))
        points = scratch.save(points.select(*(c.alias(f"x{i}") for i, c in enumerate(x)), (2 * F.col("label") - 1).cast("double").alias("y"), "__w"))
        size = len(x)
        cols = [F.col(f"x{i}") for i in range(size)]

        def slack(w):
            return F.greatest(1 - F.col("y") * reduce(Column.__add__, (c * float(v) for c, v in zip(cols, w))), F.lit(0.0))

        def cost(*ws):
            row = points.agg(*(F.sum(F.col("__w") * slack(w) ** 2).alias(f"c{i}") for i, w in enumerate(ws))).first()
            return [0.5 * float(w @ w) + self.C * float(c) for w, c in zip(ws, row)]

        w = np.zeros(size)
        upper = [(i, j) for i in range(size) for j in range(i, size)]
        for _ in range(self.max_iter):
            inside = points.withColumn("s", slack(w)).filter("s > 0")
            sums = inside.agg(*(F.sum(F.col("__w") * F.col("s") * F.col("y") * c) for c in cols), *(F.sum(F.col("__w") * cols[i] * cols[j]) for i, j in upper)).first()
            sums = np.array([v or 0.0 for v in sums])
            gradient = w - 2 * self.C * sums[:size]
            if np.abs(gradient).max() <= self.tol * max(1.0, self.C):
                break
            curve = np.eye(size)
            for (i, j), v in zip(upper, sums[size:]):
                curve[i, j] += 2 * self.C * v
                curve[j, i] = curve[i, j]
            step = np.linalg.solve(curve, -gradient)
            tried = [w + step * 0.5**k for k in range(12)]
            before, *costs = cost(w, *tried)
            better = [t for t, c in zip(tried, costs) if c < before]
            if not better:
                break
            w = better[0]
        self.coefficients, self.intercept = [float(v) for v in w[:-1]], float(w[-1])

    def _decide(self, features):
        return self._plane(features) > 0


class KMeansClassifier(PairClassifier):
    """Two clusters; the one that starts at high similarities holds the matches.  Given centres predict without fitting."""

    supervised = False

    def __init__(self, match_cluster_center: Sequence[float] | None = None, nonmatch_cluster_center: Sequence[float] | None = None, max_iter: int = 300, tol: float = 1e-4):
        self.match_cluster_center = None if match_cluster_center is None else [float(x) for x in match_cluster_center]
        self.nonmatch_cluster_center = None if nonmatch_cluster_center is None else [float(x) for x in nonmatch_cluster_center]
        self.max_iter, self.tol = max_iter, tol
        self.fitted = match_cluster_center is not None and nonmatch_cluster_center is not None

    def _distance(self, features: Sequence[str], center: Sequence[float]) -> Column:
        if len(features) != len(center):
            raise ValueError("a centre needs a value per feature")
        return reduce(Column.__add__, (F.pow(F.col(f).cast("double") - c, 2) for f, c in zip(features, center)))

    def _fit(self, data, features):
        scratch = Scratch(data.sparkSession, "kmeans")
        points = scratch.save(data.groupBy(*features).agg(F.count("*").alias("__n")))
        spread = points.agg(*(F.var_pop(F.col(f).cast("double")).alias(f) for f in features)).first()
        still = self.tol * float(np.mean([v or 0.0 for v in spread]))
        centers = [[0.05] * len(features), [0.95] * len(features)]
        for _ in range(self.max_iter):
            match = self._distance(features, centers[1]) < self._distance(features, centers[0])
            sums = points.groupBy(match.cast("int").alias("__k")).agg(F.sum("__n").alias("__n"), *(F.sum(F.col(f).cast("double") * F.col("__n")).alias(f) for f in features)).collect()
            new = [list(c) for c in centers]
            for r in sums:
                new[r["__k"]] = [r[f] / r["__n"] for f in features]
            moved = sum((x - y) ** 2 for a, b in zip(new, centers) for x, y in zip(a, b))
            centers = new
            if moved <= still:
                break
        self.nonmatch_cluster_center, self.match_cluster_center = centers

    def _decide(self, features):
        return self._distance(features, self.match_cluster_center) < self._distance(features, self.nonmatch_cluster_center)


class FellegiSunter(PairClassifier):
    """Parameters per feature and level: m = P(level | match), u = P(level | non-match), p = P(match).

    ``binarize``: levels are 0 and 1, with 1 for values above it.
    """

    def __init__(self, binarize: float | None = None, use_col_names: bool = True):
        self.binarize = None if binarize is None else float(binarize)
        self.use_col_names = use_col_names
        self.log_prior: tuple[float, float] | None = None  # non-match, match
        self.tables: dict[str, dict[float, tuple[float, float]]] = {}  # feature -> level -> log P given non-match, match

    def _level(self, f: str) -> Column:
        c = F.col(f).cast("double")
        return F.when(c > self.binarize, 1.0).otherwise(0.0) if self.binarize is not None else c

    def _score(self, features):
        if len(features) != len(self.tables):
            raise ValueError("the vectors have other features than the training vectors")
        total = F.lit(_safe(self.log_prior[1]) - _safe(self.log_prior[0]))
        for f, levels in zip(features, self.tables.values()):
            term = F.lit(0.0)
            expression = None
            for level, (u, m) in levels.items():
                hit = self._level(f) == F.lit(level)
                expression = F.when(hit, _safe(m) - _safe(u)) if expression is None else expression.when(hit, _safe(m) - _safe(u))
            total = total + (expression.otherwise(0.0) if expression is not None else term)
        return total

    def _view(self, side: int | None, function) -> dict:
        self._check()
        out = {}
        for i, (f, levels) in enumerate(self.tables.items()):
            out[f if self.use_col_names else i] = {int(x) if float(x).is_integer() else x: function(v if side is None else v[side]) for x, v in levels.items()}
        return out

    @property
    def log_p(self) -> float:
        self._check()
        return self.log_prior[1]

    @property
    def p(self) -> float:
        return math.exp(self.log_p)

    @property
    def log_m_probs(self) -> dict:
        return self._view(1, lambda v: v)

    @property
    def log_u_probs(self) -> dict:
        return self._view(0, lambda v: v)

    @property
    def m_probs(self) -> dict:
        return self._view(1, math.exp)

    @property
    def u_probs(self) -> dict:
        return self._view(0, math.exp)

    @property
    def log_weights(self) -> dict:
        return self._view(None, lambda v: v[1] - v[0])

    @property
    def weights(self) -> dict:
        return self._view(None, lambda v: math.exp(min(v[1] - v[0], 700.0)))

    def params_frame(self, spark) -> DataFrame:
        """(feature, level, m, u, weight) as a table."""
        rows = [(f, float(x), math.exp(m), math.exp(u), math.exp(min(m - u, 700.0))) for f, levels in self.tables.items() for x, (u, m) in levels.items()]
        return spark.createDataFrame(rows, "feature string, level double, m double, u double, weight double")


def _safe(log: float) -> float:
    """A probability of 0 weighs heavily but stays a number."""
    return max(log, -700.0)


class NaiveBayesClassifier(FellegiSunter):
    """Naive Bayes over levels, smoothed as (count + alpha) / (class + 2 alpha) whatever the number of levels."""

    def __init__(self, binarize=None, alpha: float = 1e-4, use_col_names: bool = True, fit_prior: bool = True, class_prior: Sequence[float] | None = None):
        super().__init__(binarize, use_col_names)
        self.alpha, self.fit_prior, self.class_prior = alpha, fit_prior, class_prior

    def _fit(self, data, features):
        if self.alpha < 0:
            raise ValueError("alpha must not be negative")
        if self.alpha < 1e-10:
            warnings.warn("alpha is too small and set to 1e-10", stacklevel=2)
        alpha = max(self.alpha, 1e-10)
        levels = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), self._level(f).alias("x")) for i, f in enumerate(features)))).alias("l")
        counts = data.select("label", levels).groupBy("label", "l.i", "l.x").agg(F.count("*").alias("n")).collect()
        total = [0, 0]
        table: dict[int, dict[float, list[int]]] = {i: {} for i in range(len(features))}
        for r in counts:
            if r["i"] == 0:
                total[r["label"]] += r["n"]
            if r["x"] is not None:
                table[r["i"]].setdefault(r["x"], [0, 0])[r["label"]] += r["n"]
        if total[1] == 0:
            raise LearningError("no match among the training pairs")
        if self.class_prior is not None:
            if len(self.class_prior) != 2:
                raise ValueError("number of priors must match number of classes")
            prior = self.class_prior
        else:
            prior = [t / sum(total) for t in total] if self.fit_prior else [0.5, 0.5]
        self.log_prior = tuple(math.log(x) if x > 0 else -math.inf for x in prior)
        self.tables = {f: {x: tuple(math.log(n + alpha) - math.log(t + 2 * alpha) for n, t in zip(table[i][x], total)) for x in sorted(table[i])} for i, f in enumerate(features)}


class ECMClassifier(FellegiSunter):
    """The Fellegi-Sunter model by expectation maximisation, without labels."""

    supervised = False

    def __init__(self, init: str = "jaro", binarize=None, max_iter: int = 100, atol: float | None = 1e-4, use_col_names: bool = True, seed: int | None = None, max_patterns: int = 200_000):
        super().__init__(binarize, use_col_names)
        if init not in ("jaro", "random"):
            raise ValueError("init is 'jaro' or 'random'")
        self.init, self.max_iter, self.atol, self.seed, self.max_patterns = init, max_iter, atol, seed, max_patterns

    def _start(self, levels: list[list[float]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(prior, P(level | class) per feature), class 0 the non-matches."""
        if self.init == "random":
            rng = np.random.default_rng(self.seed)
            prior = rng.random(2)
            return prior / prior.sum(), [(lambda x: x / x.sum(1, keepdims=True))(rng.random((2, len(v)))) for v in levels]
        for i, v in enumerate(levels):
            if not set(v) <= {0.0, 1.0}:
                raise ValueError(f"feature {i} has levels other than 0 and 1, which the 'jaro' start doesn't allow")
        return np.array([0.9, 0.1]), [np.array([[0.9 if x == 0 else 0.1 for x in v], [0.1 if x == 0 else 0.9 for x in v]]) for v in levels]

    def _fit(self, data, features):
        scratch = Scratch(data.sparkSession, "ecm")
        names = [f"x{i}" for i in range(len(features))]
        patterns = scratch.save(data.select(*(self._level(f).alias(n) for f, n in zip(features, names))).groupBy(*names).agg(F.count("*").alias("n")))
        levels = [sorted(r[0] for r in patterns.select(n).filter(F.col(n).isNotNull()).distinct().limit(10_001).collect()) for n in names]
        if max(map(len, levels), default=0) > 10_000:
            raise ValueError("a feature has too many levels for this model; use binarize")
        small = patterns.count() <= self.max_patterns
        local = None
        if small:
            pdf = patterns.toPandas()
            codes = [np.array([v.index(x) if x in v else -1 for x in pdf[n]]) for n, v in zip(names, levels)]
            local = (codes, pdf["n"].to_numpy(dtype=float))
        prior, probs = self._start(levels)
        for _ in range(self.max_iter):
            old = (prior, probs)
            prior, probs = self._local(local, prior, probs) if small else self._shared(patterns, names, levels, prior, probs)
            if self.atol is not None:
                close = lambda a, b: np.allclose(a, b, atol=self.atol)
                if close(old[0], prior) and all(close(a, b) for a, b in zip(old[1], probs)):
                    break
        with np.errstate(divide="ignore"):
            self.log_prior = tuple(float(x) for x in np.log(prior))
            self.tables = {f: {x: (float(np.log(t[0, j])), float(np.log(t[1, j]))) for j, x in enumerate(v)} for f, v, t in zip(features, levels, probs)}

    @staticmethod
    def _local(local, prior, probs):
        codes, n = local
        with np.errstate(divide="ignore"):
            joint = [np.full(len(n), max(math.log(x) if x > 0 else -700.0, -700.0)) for x in prior]
            logs = [np.maximum(np.log(t), -700.0) for t in probs]
        for c, t in zip(codes, logs):
            for k in (0, 1):
                joint[k] = joint[k] + np.where(c >= 0, t[k, np.maximum(c, 0)], 0.0)
        g = 1 / (1 + np.exp(np.clip(joint[0] - joint[1], -700, 700)))
        weight = [n * (1 - g), n * g]
        total = n.sum()
        prior = np.array([w.sum() / total for w in weight])
        new = []
        for c, t in zip(codes, probs):
            sums = np.array([np.bincount(c[c >= 0], w[c >= 0], t.shape[1]) for w in weight])
            new.append(sums / np.maximum(np.array([w.sum() for w in weight])[:, None], 1e-300))
        return prior, new

    def _shared(self, patterns, names, levels, prior, probs):
        """The same step as grouped sums, for more patterns than the driver should hold."""
        odds = F.lit(float(np.log(prior[1]) - np.log(prior[0])))
        with np.errstate(divide="ignore"):
            for n, v, t in zip(names, levels, probs):
                step = np.maximum(np.log(t[1]), -700) - np.maximum(np.log(t[0]), -700)
                table = F.map_from_arrays(F.array(*(F.lit(x) for x in v)), F.array(*(F.lit(float(x)) for x in step)))
                odds = odds + F.coalesce(F.element_at(table, F.col(n)), F.lit(0.0))
        g = patterns.withColumn("g", F.col("n") / (1 + F.exp(-odds)))
        cells = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(n).alias("x")) for i, n in enumerate(names)))).alias("l")
        rows = g.select("n", "g", cells).groupBy("l.i", "l.x").agg(F.sum("g").alias("m"), F.sum(F.col("n") - F.col("g")).alias("u")).collect()
        m = sum(r["m"] for r in rows if r["i"] == 0)
        u = sum(r["u"] for r in rows if r["i"] == 0)
        new = [np.zeros((2, len(v))) for v in levels]
        for r in rows:
            if r["x"] is not None:
                new[r["i"]][:, levels[r["i"]].index(r["x"])] = (r["u"] / max(u, 1e-300), r["m"] / max(m, 1e-300))
        return np.array([u, m]) / (u + m), new


class SparkMLClassifier(PairClassifier):
    """Adapter of a Spark ML estimator that reads ``features`` and ``label`` and writes ``prediction`` (and ``probability``)."""

    def __init__(self, estimator: Any, supervised: bool = True):
        self.estimator, self.supervised = estimator, supervised

    def _transform(self, vectors: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        names = _features(vectors) if "label" not in vectors.columns else [c for c in _features(vectors) if c != "label"]
        numeric = vectors.withColumns({f: F.col(f).cast("double") for f in names})
        return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error").transform(numeric)

    def _fit(self, data, features):
        self.model = self.estimator.fit(self._transform(data))

    def predict(self, vectors):
        self._check()
        one, two = vectors.columns[:2]
        labelled = self.model.transform(self._transform(vectors)).select(one, two, F.col("prediction").cast("int").alias("classification"))
        kind = get_option("classification.return_type")
        if kind == "index":
            return labelled.filter("classification = 1").select(one, two)
        return labelled if kind == "series" else np.array([r[0] for r in labelled.select("classification").collect()])

    def prob(self, vectors):
        from pyspark.ml.functions import vector_to_array

        self._check()
        one, two = vectors.columns[:2]
        return self.model.transform(self._transform(vectors)).select(one, two, F.get(vector_to_array("probability"), F.lit(1)).alias("prob"))


class DriverModelClassifier(PairClassifier):
    """Adapter of a local model with fit(X, y), predict(X) and perhaps predict_proba(X).

    Training takes the distinct vectors and their counts to the driver, at most ``max_rows`` of them, and
    refuses more.  The model gets up to ``max_rows`` rows one by one.  More rows it gets as distinct vectors
    under ``sample_weight``, if its fit takes that, and not at all otherwise.  Prediction runs in the tasks.
    """

    def __init__(self, kernel: Any, supervised: bool = True, max_rows: int = 1_000_000):
        self.kernel, self.supervised, self.max_rows = kernel, supervised, max_rows

    def _fit(self, data, features):
        distinct = data.groupBy(*features, *["label"] * self.supervised).agg(F.count("*").alias("__n"))
        pdf = distinct.limit(self.max_rows + 1).toArrow().to_pandas()
        if len(pdf) > self.max_rows:
            raise ValueError(f"more than {self.max_rows} different training rows")
        x, n = pdf[list(features)].to_numpy(dtype=float), pdf["__n"].to_numpy()
        weights = {}
        if n.sum() > self.max_rows:
            if "sample_weight" not in inspect.signature(self.kernel.fit).parameters:
                raise ValueError(f"more than {self.max_rows} training rows, and the model's fit takes no sample_weight")
            weights = {"sample_weight": n.astype(float)}
            at = np.arange(len(n))
        else:
            # equal rows apart, for models that learn row by row
            at = np.random.default_rng(0).permutation(np.repeat(np.arange(len(n)), n))
        y = [pdf["label"].to_numpy()[at]] if self.supervised else []
        self.kernel.fit(x[at], *y, **weights)

    def _apply(self, vectors: DataFrame, out: str, function) -> DataFrame:
        model = vectors.sparkSession.sparkContext.broadcast(cloudpickle.dumps(self.kernel))
        ids, names = vectors.columns[:2], _features(vectors)
        kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ids)

        def run(batches):
            kernel = cloudpickle.loads(model.value)
            for pdf in batches:
                values = function(kernel, pdf[names].to_numpy(dtype=float)) if len(pdf) else []
                yield pdf[ids].assign(**{out: np.asarray(values, dtype=float)})

        return vectors.mapInPandas(run, f"{kinds}, {out} double")

    @staticmethod
    def _classes(model: Any, x: np.ndarray) -> np.ndarray:
        return model.predict(x)

    def predict(self, vectors):
        self._check()
        one, two = vectors.columns[:2]
        labelled = self._apply(vectors, "classification", self._classes).withColumn("classification", F.col("classification").cast("int"))
        kind = get_option("classification.return_type")
        if kind == "index":
            return labelled.filter("classification = 1").select(one, two)
        return labelled if kind == "series" else np.array([r[0] for r in labelled.select("classification").collect()])

    def prob(self, vectors):
        self._check()
        return self._apply(vectors, "prob", lambda model, x: np.asarray(model.predict_proba(x))[:, -1])


class NetworkModelClassifier(DriverModelClassifier):
    """Adapter of a neural network whose predict(X) gives one probability per row."""

    @staticmethod
    def _classes(model: Any, x: np.ndarray) -> np.ndarray:
        return (np.asarray(model.predict(x)).reshape(len(x), -1)[:, 0] > 0.5).astype(float)

    def prob(self, vectors):
        self._check()
        return self._apply(vectors, "prob", lambda model, x: np.asarray(model.predict(x)).reshape(len(x), -1)[:, 0])


SKLearnAdapter, KerasAdapter = DriverModelClassifier, NetworkModelClassifier

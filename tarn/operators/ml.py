"""Train and predict: models of pyspark.ml under names, with their metrics."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import evaluation as E
from pyspark.ml import regression as R
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALGORITHMS = {
    "linear_regression": lambda o: R.LinearRegression(**o),
    "logistic_regression": lambda o: C.LogisticRegression(**o),
    "svm_classification": lambda o: C.LinearSVC(**o),
    "multiclass": lambda o: C.OneVsRest(classifier=C.LogisticRegression(**o)),
    "kmeans": lambda o: K.KMeans(**({"seed": 1} | o)),
    "pca": lambda o: PCA(inputCol="features", outputCol="prediction", **o),
    "xgboost_regression": lambda o: R.GBTRegressor(**({"seed": 1, "maxIter": 10} | o)),
    "xgboost_classification": lambda o: C.GBTClassifier(**({"seed": 1, "maxIter": 10} | o)),
    "bayes": lambda o: C.NaiveBayes(**o),
}
UNSUPERVISED = ("kmeans", "pca")
#: Rows that a task of a tree model holds, about; tree models keep their rows in memory at about 280 bytes each.
TREE_ROWS = 1_000_000


def create_model(algorithm: str, df: DataFrame, features: list[str], target: str | None = None, **options) -> PipelineModel:
    """Fits a model on ``features`` (columns of numbers or vectors)."""
    rows = df.select(*features, *([F.col(target).cast("double").alias("label")] if target else [])).dropna()
    if algorithm.startswith("xgboost"):
        parts = -(-rows.count() // TREE_ROWS)
        rows = rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows
    stage = ALGORITHMS[algorithm](options)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), stage]).fit(rows)


def predict_by(model: PipelineModel, df: DataFrame, target: str | None = None) -> DataFrame:
    return model.transform(df.withColumn("label", F.col(target).cast("double")) if target else df)


def explain_model(model: PipelineModel) -> str:
    last = model.stages[-1]
    told = {str(p.name): str(last.getOrDefault(p)) for p in last.params if last.isDefined(p)}
    return json.dumps({"model": type(last).__name__} | told, sort_keys=True)


def metric(predicted: DataFrame, name: str) -> float:
    if name in ("rmse", "mse", "mae", "r2"):
        return E.RegressionEvaluator(metricName=name).evaluate(predicted)
    if name in ("auc", "areaUnderROC"):
        return E.BinaryClassificationEvaluator().evaluate(predicted)
    return E.MulticlassClassificationEvaluator(metricName=name).evaluate(predicted)


def mmd(x: DataFrame, y: DataFrame, bandwidth: float, vector: str = "embedding") -> DataFrame:
    """Maximum mean discrepancy of two samples (stated sets of bounded size) with an RBF kernel, as one row."""
    from ..functions import vectors as V

    def mean(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        pairs = a.select(F.col(vector).alias("p")).crossJoin(F.broadcast(b.select(F.col(vector).alias("q"))))
        return pairs.agg(F.avg(F.exp(-V.l2_squared("p", "q") * bandwidth / 2)).alias(name))

    parts = mean(x, x, "xx").crossJoin(mean(y, y, "yy")).crossJoin(mean(x, y, "xy"))
    return parts.select(F.round(F.col("xx") + F.col("yy") - 2 * F.col("xy"), 6).alias("mmd"))


def mmd_linear(df: DataFrame, order: str, bandwidth: float, vector: str = "embedding") -> DataFrame:
    """Maximum mean discrepancy of even against odd rows of ``order`` in linear time, as one row: mmd, blocks.

    Each block of four consecutive numbers gives k(x1, x2) + k(y1, y2) - k(x1, y2) - k(x2, y1); their mean is an
    unbiased estimate, so tables of any size take one aggregation where all pairs would grow with its square.
    Blocks that lack a row or a vector are left out.
    """
    from ..functions import vectors as V

    held = df.filter(F.col(vector).isNotNull()).select(F.floor(F.col(order) / 4).alias("block"), F.col(order).alias("at"), V.doubles(vector).alias("e"))
    blocks = held.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "e"))).alias("v")).filter(F.size("v") == 4)
    rows = blocks.select(*[F.col("v")[i]["e"].alias(f"e{i}") for i in range(4)])
    k = lambda a, b: F.exp(-V.l2_squared(f"e{a}", f"e{b}") * bandwidth / 2)
    return rows.agg(F.round(F.avg(k(0, 2) + k(1, 3) - k(0, 3) - k(1, 2)), 6).alias("mmd"), F.count("*").alias("blocks"))


def mmd_test(x: DataFrame, y: DataFrame, n: int, order: str, permutations: int = 100, level: float = 0.05, seed: int = 7, vector: str = "embedding") -> DataFrame:
    """Two-sample test by the maximum mean discrepancy, as one row: mmd, p_value, differs, n_x, n_y.

    The samples are the ``n`` rows of each side least by hash of ``order`` (a stated size: the test holds all distances between
    them). The kernel is exp(-|a - b|^2 / (2 m^2)), m the median distance of all pairs; the p-value is the share of random divisions of the
    pooled rows, the one found included, whose discrepancy is no smaller. Null vectors are left out; an empty side gives nulls.
    """
    from ..functions import vectors as V

    def drawn(df: DataFrame) -> np.ndarray:
        held = df.filter(F.col(vector).isNotNull()).select(F.col(order).alias("at"), V.doubles(vector).alias("e"))
        return np.array([r.e for r in held.orderBy(F.xxhash64("at"), "at").limit(n).collect()])

    a, b = drawn(x), drawn(y)
    row = (None, None, None, len(a), len(b))
    if len(a) and len(b):
        rows = np.vstack([a, b])
        lengths = (rows * rows).sum(axis=1)
        squared = np.maximum(lengths[:, None] + lengths[None, :] - 2 * rows @ rows.T, 0)
        median = np.median(np.sqrt(squared[np.triu_indices(len(rows), 1)]))
        kernel = np.exp(-squared / (2 * median * median)) if median > 0 else (squared == 0).astype(float)

        def between(first: np.ndarray) -> float:
            w = np.where(first, 1 / len(a), -1 / len(b))
            return float(w @ kernel @ w)

        first = np.arange(len(rows)) < len(a)
        found = between(first)
        rng = np.random.default_rng(seed)
        p = (1 + sum(between(rng.permutation(first)) >= found - 1e-12 for _ in range(permutations))) / (1 + permutations)
        row = (round(found, 9), p, bool(p < level), len(a), len(b))
    return x.sparkSession.createDataFrame([row], "mmd double, p_value double, differs boolean, n_x int, n_y int")


def report(predicted: DataFrame) -> DataFrame:
    """One row of measures over numeric columns prediction and label (1: positive), from one pass of sums."""
    p, y = F.col("prediction"), F.col("label")
    sums = predicted.agg(F.avg((p == y).cast("double")).alias("accuracy"), F.sum(p * y).alias("hit"), F.sum(p).alias("said"), F.sum(y).alias("so"), F.avg((p - y) * (p - y)).alias("mse"))
    return sums.select(
        F.round("accuracy", 6).alias("accuracy"),
        F.round(F.try_divide("hit", "said"), 6).alias("precision"),
        F.round(F.try_divide("hit", "so"), 6).alias("recall"),
        F.round(F.try_divide(2 * F.col("hit"), F.col("said") + F.col("so")), 6).alias("f1"),
        F.round("mse", 6).alias("mse"),
    )


def cluster(df: DataFrame, id_col: str, k: int, metric: str = "l1", rounds: int = 5, vector: str = "embedding") -> DataFrame:
    """(id, cluster, distance) of every row with a vector, by the distances that KMeans lacks: l1 (medians) and linf (means).

    Centres are k vectors, so what a round gathers doesn't grow with the rows; the first are the k rows least by hash.
    Medians are those of percentile_approx. A cluster that loses its last row keeps its centre.
    """
    from ..functions import vectors as V

    e = V.doubles(vector)
    rows = df.filter(F.col(vector).isNotNull())
    centres = [list(r.e) for r in rows.select(e.alias("e")).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(k).collect()]
    fold = (lambda s, x: s + x) if metric == "l1" else (lambda s, x: F.greatest(s, x))
    middle = F.percentile_approx("x", 0.5, 10_000) if metric == "l1" else F.avg("x")

    def assign() -> DataFrame:
        far = [F.aggregate(F.zip_with(F.col("e"), F.array(*[F.lit(x) for x in c]), lambda x, y: F.abs(x - y)), F.lit(0.0), fold) for c in centres]
        best = F.array_min(F.array(*[F.struct(d.alias("distance"), F.lit(i).alias("cluster")) for i, d in enumerate(far)]))
        return rows.select(id_col, e.alias("e")).withColumn("best", best).select(id_col, "e", "best.cluster", "best.distance")

    if not centres:
        return rows.select(id_col, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("distance"))
    for _ in range(rounds):
        moved = assign().select("cluster", F.posexplode("e").alias("at", "x")).groupBy("cluster", "at").agg(middle.alias("x"))
        for r in moved.collect():  # k times the dimension
            centres[r.cluster][r["at"]] = float(r.x)
    return assign().select(id_col, "cluster", F.round("distance", 6).alias("distance"))

"""Classification of samples into known populations.

Input ``(sample_id, region, features)``. A fit returns a model whose ``transform`` adds ``label``
and ``prediction`` (class codes); ``predicted`` turns that into the common output columns.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import ElementwiseProduct, IndexToString, PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demescope.operators.distance import nearest_neighbours
from demescope.operators.labels import label_index, metrics_of, predicted
from demescope.operators.reshape import best_by, hash_share, split_rows
from demescope.operators.trees import BaggedForest, pruned_tree
from demescope.session import fit_table, held

KERNELS = ("linear", "quadratic", "RBF")
FOURIER_FEATURES = 256


def class_names(df: DataFrame) -> list[str]:
    return label_index().fit(df).labels


def with_class_names(predictions: DataFrame, names: list[str]) -> DataFrame:
    """Adds the region named by each prediction code."""
    return IndexToString(inputCol="prediction", outputCol="predicted_region", labels=names).transform(predictions)


def f1_error(predictions: DataFrame) -> float:
    """1 minus weighted F1."""
    return 1.0 - MulticlassClassificationEvaluator(metricName="f1").evaluate(predictions)


# --- trees -------------------------------------------------------------------------------

# The grid searched by default.
TREE_BINS = (10, 15, 20)
TREE_DEPTHS = (4, 6, 8)
TREE_IMPURITIES = ("entropy", "gini")
SVM_REG = (0.01, 0.1, 10.0)


def _fit(df: DataFrame, stages: list, grid: list | None, folds: int, seed: int, parallelism: int) -> PipelineModel | CrossValidatorModel:
    pipeline = Pipeline(stages=[label_index(), *stages])
    if grid is None:
        with fit_table(df) as rows:
            return pipeline.fit(rows)
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=grid,
        evaluator=MulticlassClassificationEvaluator(metricName="f1"),
        numFolds=folds,
        seed=seed,
        parallelism=parallelism,
    )
    with fit_table(df) as rows:
        return search.fit(rows)


def _tree_grid(tree, bins, depths, impurities):
    return (
        ParamGridBuilder()
        .addGrid(tree.maxBins, list(bins))
        .addGrid(tree.maxDepth, list(depths))
        .addGrid(tree.impurity, list(impurities))
        .build()
    )


def decision_tree(
    df: DataFrame,
    cv: bool = False,
    folds: int = 10,
    bins: Sequence[int] = TREE_BINS,
    depths: Sequence[int] = TREE_DEPTHS,
    impurities: Sequence[str] = TREE_IMPURITIES,
    seed: int = 1234,
    parallelism: int = 4,
    **options,
) -> PipelineModel | CrossValidatorModel:
    tree = DecisionTreeClassifier(seed=seed, **options)
    grid = _tree_grid(tree, bins, depths, impurities) if cv else None
    return _fit(df, [tree], grid, folds, seed, parallelism)


def random_forest(
    df: DataFrame,
    cv: bool = False,
    folds: int = 10,
    bins: Sequence[int] = TREE_BINS,
    depths: Sequence[int] = TREE_DEPTHS,
    impurities: Sequence[str] = TREE_IMPURITIES,
    seed: int = 1234,
    parallelism: int = 4,
    **options,
) -> PipelineModel | CrossValidatorModel:
    forest = RandomForestClassifier(seed=seed, **options)
    grid = _tree_grid(forest, bins, depths, impurities) if cv else None
    return _fit(df, [forest], grid, folds, seed, parallelism)


def tree_text(model: PipelineModel | CrossValidatorModel) -> str:
    best = model.bestModel if isinstance(model, CrossValidatorModel) else model
    return best.stages[-1].toDebugString


def feature_importance(model: PipelineModel | BaggedForest) -> DataFrame:
    """``(feature, importance)`` of a fitted tree or forest."""
    fitted = model.stages[-1] if isinstance(model, PipelineModel) else model
    values = fitted.featureImportances.toArray()
    rows = pd.DataFrame({"feature": np.arange(1, len(values) + 1), "importance": values})
    return SparkSession.getActiveSession().createDataFrame(rows, "feature int, importance double")


# --- support vector machines --------------------------------------------------------------


class _FourierFeatures(Transformer):
    """Random cosines whose inner products approximate the Gaussian kernel ``exp(-gamma |x - y|^2)``."""

    def __init__(self, width: int, gamma: float, size: int, seed: int):
        super().__init__()
        draw = np.random.default_rng(seed)
        self.directions = draw.normal(scale=math.sqrt(2.0 * gamma), size=(width, size))
        self.phases = draw.uniform(0.0, 2.0 * math.pi, size)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w, b = self.directions, self.phases
        scale = math.sqrt(2.0 / len(b))

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=object)
            return pd.Series(list(scale * np.cos(np.stack(values.to_numpy()) @ w + b)))

        return dataset.withColumn("_kernel", array_to_vector(project(vector_to_array("features"))))


def kernel_stages(df: DataFrame, kernel: str, sigma: float, seed: int) -> tuple[list, str]:
    """Feature-map stages after which a linear machine equals (RBF: approximates) the kernel machine."""
    if kernel == "linear":
        return [], "features"
    d = len(df.select("features").first()[0])
    if kernel == "quadratic":
        # (g x.y + 1)^2 = sum of g^2 x_i^2 y_i^2 + 2 g^2 x_i x_j y_i y_j + 2 g x_i y_i + 1.
        weights = []
        for i in range(d):
            weights.append(math.sqrt(2.0 * sigma))
            weights.extend([math.sqrt(2.0) * sigma] * i + [sigma])
        return [
            PolynomialExpansion(degree=2, inputCol="features", outputCol="_poly"),
            ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="_poly", outputCol="_kernel"),
        ], "_kernel"
    if kernel == "RBF":
        return [_FourierFeatures(d, sigma, FOURIER_FEATURES, seed)], "_kernel"
    raise ValueError(f"kernel must be one of {KERNELS}")


def svm(
    df: DataFrame,
    kernel: str = "linear",
    cost: float = 10.0,
    sigma: float = 1.0,
    max_iter: int = 50,
    tol: float = 1e-6,
    intercept: bool = True,
    seed: int = 1234,
    parallelism: int = 4,
) -> PipelineModel:
    """One-versus-rest linear machines on the kernel's feature map; ``cost`` weighs errors as in C-classification."""
    stages, column = kernel_stages(df, kernel, sigma, seed)
    n = df.count()
    machine = LinearSVC(regParam=1.0 / (cost * n), maxIter=max_iter, tol=tol, fitIntercept=intercept, featuresCol=column, standardization=False)
    rest = OneVsRest(classifier=machine, featuresCol=column, parallelism=parallelism)
    with fit_table(df) as rows:
        return Pipeline(stages=[label_index(), *stages, rest]).fit(rows)


def svm_cv(
    df: DataFrame,
    folds: int = 10,
    reg: Sequence[float] = SVM_REG,
    intercept: Sequence[bool] = (True, False),
    max_iter: Sequence[int] = (20,),
    tol: Sequence[float] = (1e-6,),
    seed: int = 1234,
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Linear machines searched over regularisation, intercept, iterations and tolerance."""
    rest = OneVsRest()
    machines = [
        LinearSVC(regParam=r, fitIntercept=i, maxIter=m, tol=t)
        for r, i, m, t in itertools.product(reg, intercept, max_iter, tol)
    ]
    grid = ParamGridBuilder().addGrid(rest.classifier, machines).build()
    return _fit(df, [rest], grid, folds, seed, parallelism)


def margin_rows(model: PipelineModel, df: DataFrame) -> int:
    """Rows on or inside the margin of any of the machines (the support vectors)."""
    prepared = df
    for stage in model.stages[:-1]:
        prepared = stage.transform(prepared)
    rest = model.stages[-1]
    near = F.lit(False)
    for code, machine in enumerate(rest.models):
        raw = f"_raw{code}"
        side = F.when(F.col("label") == code, 1.0).otherwise(-1.0)
        prepared = machine.setRawPredictionCol(raw).setPredictionCol(f"_p{code}").transform(prepared)
        near = near | (side * vector_to_array(raw)[1] <= 1.0)
    return prepared.filter(near).count()


def svm_grid(
    train: DataFrame,
    kernel: str = "RBF",
    costs: Sequence[float] = (10, 100, 1000, 10000),
    sigmas: Sequence[float] = (0.01, 0.1, 1.0, 10.0),
    folds: int = 10,
    seed: int = 1234,
) -> DataFrame:
    """``(kernel, cost, sigma, cv_error, n_support)``: cross-validated error in percent per setting."""
    fold = F.floor(hash_share("sample_id", seed) * folds)
    out = []
    with held(train) as rows:
        total = rows.count()
        for cost, sigma in itertools.product(costs, [1.0] if kernel == "linear" else sigmas):
            wrong = 0
            for f in range(folds):
                fit, judged = rows.filter(fold != f), rows.filter(fold == f)
                model = svm(fit, kernel, cost, sigma, seed=seed)
                wrong += predicted(model, judged).filter("label <> prediction").count()
            whole = svm(rows, kernel, cost, sigma, seed=seed)
            out.append((kernel, float(cost), float(sigma), 100.0 * wrong / total, margin_rows(whole, rows)))
    return train.sparkSession.createDataFrame(out, "kernel string, cost double, sigma double, cv_error double, n_support long")


# --- neighbours, Bayes, discriminants -----------------------------------------------------


def knn_votes(neighbours: DataFrame, ks: Sequence[int]) -> DataFrame:
    """``(query_id, k, prediction)``: majority among the first k neighbours; ties to the smaller label."""
    listed = neighbours.filter(F.col("rank") <= max(ks)).withColumn("k", F.explode(F.lit(list(ks))))
    votes = listed.filter(F.col("rank") <= F.col("k")).groupBy("query_id", "k", "label").agg(F.count("*").alias("votes"))
    best = F.min_by("label", F.struct(-F.col("votes"), F.col("label")))
    return votes.groupBy("query_id", "k").agg(best.alias("prediction"))


def knn_predict(train: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """``(query_id, k, prediction)`` for test points by the k nearest training points.

    Both are ``(id, features array, label)``.
    """
    return knn_votes(nearest_neighbours(test, train, k), [k])


def knn_errors(points: DataFrame, ks: Sequence[int] = tuple(range(1, 11))) -> DataFrame:
    """Leave-one-out error (percent) for every k, all from one ranking."""
    near = nearest_neighbours(points, points, max(ks), exclude_self=True)
    truth = points.select(F.col("id").alias("query_id"), F.col("label").alias("truth"))
    judged = knn_votes(near, ks).join(truth, "query_id")
    return judged.groupBy("k").agg((F.avg((F.col("prediction") != F.col("truth")).cast("double")) * 100).alias("error"))


def naive_bayes(df: DataFrame) -> PipelineModel:
    """Gaussian naive Bayes."""
    return Pipeline(stages=[label_index(), NaiveBayes(modelType="gaussian")]).fit(df)


class DiscriminantModel:
    """Class means and covariances with the scores they imply."""

    def __init__(self, names, means, precisions, offsets):
        self.names, self.means, self.precisions, self.offsets = names, means, precisions, offsets

    def transform(self, df: DataFrame) -> DataFrame:
        means, precisions, offsets, names = self.means, self.precisions, self.offsets, self.names

        @F.pandas_udf(T.DoubleType())
        def best(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=float)
            x = np.stack(values.to_numpy())
            scores = np.stack(
                [o - 0.5 * np.einsum("ij,jk,ik->i", x - m, p, x - m) for m, p, o in zip(means, precisions, offsets)], axis=1
            )
            return pd.Series(scores.argmax(axis=1).astype(float))

        code = F.element_at(F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (n, float(i))]), F.col("region"))
        return df.withColumn("label", code).withColumn("prediction", best(vector_to_array("features")))


def discriminant(df: DataFrame, quadratic: bool = False, ridge: float = 1e-9) -> DiscriminantModel:
    """Linear (pooled covariance) or quadratic (one per class) discriminant analysis.

    Each task adds up counts, sums and cross products per class; only those totals are collected.
    """
    shift = df.select(F.posexplode(vector_to_array("features")).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    centre = np.array([r["m"] for r in shift.orderBy("i").collect()])
    d = len(centre)

    def moments(batches):
        totals: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, part in pdf.groupby("region"):
                x = np.stack(part["x"].to_numpy()) - centre
                ones = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                totals[name] = totals.get(name, 0.0) + ones.T @ ones
        for name, m in totals.items():
            yield pd.DataFrame({"region": name, "cell": np.arange(m.size), "v": m.ravel()})

    parts = df.select("region", vector_to_array("features").alias("x")).mapInPandas(moments, "region string, cell int, v double")
    totals = parts.groupBy("region", "cell").agg(F.sum("v").alias("v")).collect()
    sums: dict[str, np.ndarray] = {}
    for r in totals:
        sums.setdefault(r["region"], np.zeros((d + 1) ** 2))[r["cell"]] = r["v"]
    names = sorted(sums)
    n, means, scatter = [], [], []
    for name in names:
        m = sums[name].reshape(d + 1, d + 1)
        n.append(m[0, 0])
        mean = m[0, 1:] / m[0, 0]
        means.append(mean + centre)
        scatter.append(m[1:, 1:] - m[0, 0] * np.outer(mean, mean))
    size = sum(n)
    if quadratic:
        covariances = [s / max(c - 1, 1) for s, c in zip(scatter, n)]
    else:
        covariances = [sum(scatter) / max(size - len(names), 1)] * len(names)
    covariances = [c + ridge * np.eye(d) for c in covariances]
    precisions = [np.linalg.pinv(c) for c in covariances]
    offsets = [math.log(c / size) - 0.5 * np.linalg.slogdet(v)[1] for c, v in zip(n, covariances)]
    return DiscriminantModel(names, means, precisions, offsets)


# --- comparisons -------------------------------------------------------------------------

CLASSIFIERS: dict[str, Callable] = {
    "svml": lambda df, o: svm(df, "linear", o["cost"], o["sigma"]),
    "svmq": lambda df, o: svm(df, "quadratic", o["cost"], o["sigma"]),
    "svmr": lambda df, o: svm(df, "RBF", o["cost"], o["sigma"]),
    "dt": lambda df, o: pruned_tree(df, o["cp"], folds=o["folds"])[0],
    "rf": lambda df, o: random_forest(df, numTrees=o["trees"]),
}
DEFAULTS = {"cost": 10.0, "sigma": 1.0, "cp": 0.001, "trees": 500, "folds": 10}


def _options(options: dict) -> dict:
    unknown = set(options) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}; known are {sorted(DEFAULTS)}")
    return {**DEFAULTS, **options}


def train_test_errors(
    df: DataFrame,
    classifiers: Sequence[str] = tuple(CLASSIFIERS),
    train_share: float = 0.67,
    seed: int = 1234,
    **options,
) -> DataFrame:
    """``(algorithm, train_error, test_error)`` in percent on one disjoint split."""
    o = _options(options)
    out = []
    with held(df) as rows:
        train, test = split_rows(rows, train_share, seed)
        for name in classifiers:
            model = CLASSIFIERS[name](train, o)
            errors = [metrics_of(predicted(model, part)).first()["error"] for part in (train, test)]
            out.append((name, *map(float, errors)))
    return df.sparkSession.createDataFrame(out, "algorithm string, train_error double, test_error double")


def repeated_metrics(
    df: DataFrame,
    fit: Callable[[DataFrame], Transformer],
    repeats: int = 5,
    train_share: float = 0.7,
    seed: int = 1234,
) -> DataFrame:
    """Macro metrics of train and test rows for every repeat, each on a split of its own seed."""
    out = []
    with held(df) as rows:
        for repeat in range(repeats):
            train, test = split_rows(rows, train_share, seed + repeat)
            model = fit(train)
            for name, part in (("train", train), ("test", test)):
                out.append((repeat, name, *metrics_of(predicted(model, part)).first()))
    names = "n long, error double, accuracy double, precision double, recall double, f1 double, f1_error double, kappa double"
    return df.sparkSession.createDataFrame(out, f"repeat int, split string, {names}")


def best_classifier(errors: DataFrame) -> DataFrame:
    """The algorithm with the least test error; the smaller gap, then the name, on equal ones."""
    gap = errors.withColumn("gap", F.abs(F.col("train_error") - F.col("test_error")))
    return best_by(gap, "test_error", ["gap", "algorithm"], lowest=True)

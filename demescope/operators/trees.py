"""Trees cut back by their complexity, and forests judged by the trees that did not see a row.

Input ``(sample_id, region, features)``, one row per sample. Both models' ``transform`` adds ``label``
and ``prediction`` (class codes), as those of ``classify`` do.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Transformer
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demescope.operators.labels import label_index, metrics_of, predicted
from demescope.operators.reshape import hash_share
from demescope.session import fit_table, scratch_path

# --- cost-complexity pruning -------------------------------------------------------------

_LEAF = "_leaf"


@dataclass
class Nodes:
    """A fitted tree's nodes by id: rows of each class, children (-1 at a leaf). The root is 0, children follow parents."""

    counts: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def of(cls, model: DecisionTreeClassificationModel, spark: SparkSession) -> Nodes:
        """Read from the saved model; a tree of depth d has less than 2^(d+1) of them."""
        path = scratch_path(spark, "tree")
        model.save(path)
        rows = spark.read.parquet(f"{path}/data").orderBy("id").select("impurityStats", "leftChild", "rightChild").collect()
        return cls(np.array([r[0] for r in rows], dtype=float), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    def errors(self) -> np.ndarray:
        return self.counts.sum(axis=1) - self.counts.max(axis=1)

    def links(self) -> list[tuple[float, np.ndarray]]:
        """``(complexity, inner nodes still open)`` of the nested subtrees, from the smallest as good as the whole tree, at 0, on.

        Each step closes the inner nodes whose branch saves the fewest errors for each leaf more than one, as a
        share of the root's errors; the last one closes the root.
        """
        own = self.errors()
        root = max(float(own[0]), 1.0)
        open_ = self.left >= 0
        out, at = [(0.0, open_.copy())], 0.0
        while open_[0]:
            kept, leaves = own.copy(), np.ones(len(own))
            for k in np.flatnonzero(open_)[::-1]:
                kept[k] = kept[self.left[k]] + kept[self.right[k]]
                leaves[k] = leaves[self.left[k]] + leaves[self.right[k]]
            reached = self.reached(open_)
            gain = np.where(open_ & reached, (own - kept) / np.maximum(leaves - 1, 1) / root, np.inf)
            at = max(at, float(gain.min()))
            open_ = open_ & reached & (gain > at + 1e-12)
            open_ &= self.reached(open_)
            if at > out[-1][0] + 1e-12:
                out.append((at, open_.copy()))
            else:
                out[-1] = (out[-1][0], open_.copy())
        return out

    def reached(self, open_: np.ndarray) -> np.ndarray:
        """Nodes all of whose ancestors are open."""
        out = np.zeros(len(open_), bool)
        out[0] = True
        for k in range(len(open_)):
            if out[k] and open_[k]:
                out[self.left[k]] = out[self.right[k]] = True
        return out

    def predictions(self, open_: np.ndarray) -> np.ndarray:
        """The class that each leaf of the whole tree, left to right, has in the subtree."""
        out, stack = [], [(0, -1)]
        while stack:
            k, decided = stack.pop()
            if decided < 0 and not open_[k]:
                decided = int(self.counts[k].argmax())
            if self.left[k] < 0:
                out.append(decided)
            else:
                stack += [(self.right[k], decided), (self.left[k], decided)]
        return np.array(out)


def subtree_at(links: list[tuple[float, np.ndarray]], complexity: float) -> np.ndarray:
    """The inner nodes that stay open at a complexity: those of the last subtree that begins at or below it."""
    return [o for c, o in links if c <= complexity + 1e-12][-1]


class PrunedTree(Transformer):
    """A fitted tree whose leaves carry the class of the subtree they were cut back to."""

    def __init__(self, index: StringIndexerModel, tree: DecisionTreeClassificationModel, classes: np.ndarray):
        super().__init__()
        self.index, self.tree, self.classes = index, tree, classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        judged = self.tree.transform(self.index.transform(dataset))
        at = (F.col(_LEAF) + 1).cast("int")
        return judged.withColumn("prediction", F.element_at(F.lit([float(c) for c in self.classes]), at)).drop(_LEAF)


def pruned_tree(
    train: DataFrame,
    cp: float = 0.001,
    impurity: str = "gini",
    max_depth: int = 10,
    folds: int = 10,
    seed: int = 1234,
) -> tuple[PrunedTree, DataFrame]:
    """A tree cut back to the complexity with the least cross-validated error.

    Returns the model and the table ``(cp, n_splits, rel_error, cv_error, cv_std)`` of the nested subtrees from
    the root alone to the one at ``cp``; errors are shares of the root's. Each fold's tree, grown on the other
    rows, has its own sequence; for a row of the table it is cut at the geometric mean of that row's and the
    row above's complexity. Of equal errors the smaller tree wins. The driver sees nodes, and counts per leaf and class.
    """
    spark = train.sparkSession
    index = label_index().fit(train)
    grower = DecisionTreeClassifier(impurity=impurity, maxDepth=max_depth, seed=seed, leafCol=_LEAF)
    fold = F.floor(hash_share("sample_id", seed) * folds)
    with fit_table(index.transform(train).withColumn("_fold", fold)) as rows:
        whole = grower.fit(rows)
        nodes = Nodes.of(whole, spark)
        links = nodes.links()
        steps = [(c, o) for c, o in links if c > cp + 1e-12][::-1] + [(cp, subtree_at(links, cp))]

        def judge(f: int) -> np.ndarray:
            model = grower.fit(rows.filter(F.col("_fold") != f))
            part = Nodes.of(model, spark)
            met = model.transform(rows.filter(F.col("_fold") == f)).groupBy(_LEAF, "label").count().collect()
            own = part.links()
            cuts = [math.inf] + [math.sqrt(a[0] * b[0]) for a, b in zip(steps, steps[1:])]
            classes = [part.predictions(subtree_at(own, c)) for c in cuts]
            return np.array([sum(r["count"] for r in met if by[int(r[_LEAF])] != r["label"]) for by in classes], dtype=float)

        used = [r[0] for r in rows.select("_fold").distinct().collect()]
        with ThreadPoolExecutor(4) as pool:
            wrong = sum(pool.map(judge, used)) if len(used) > 1 else np.full(len(steps), np.nan)
    n, root = nodes.counts[0].sum(), max(nodes.errors()[0], 1.0)
    table = []
    for (c, open_), w in zip(steps, wrong):
        left = [k for k in np.flatnonzero(nodes.reached(open_)) if not open_[k]]
        table.append((float(c), int(open_.sum()), float(nodes.errors()[left].sum() / root), float(w / root), float(np.sqrt(w * (1 - w / n)) / root)))
    best = int(np.nanargmin(wrong)) if len(used) > 1 else len(steps) - 1
    made = spark.createDataFrame(table, "cp double, n_splits int, rel_error double, cv_error double, cv_std double")
    return PrunedTree(index, whole, nodes.predictions(steps[best][1])), made


# --- forests with out-of-bag votes -------------------------------------------------------


def bag_weight(key: Column | str, tree: int, seed: int) -> Column:
    """How often a row is in a tree's bag: Poisson(1) by a hash of its key, 0 for about 37 of 100 rows."""
    k = F.col(key) if isinstance(key, str) else key
    share = hash_share(F.concat_ws("#", k.cast("string"), F.lit(str(tree))), seed)
    below = np.cumsum([math.exp(-1) / math.factorial(j) for j in range(9)])
    return sum((share >= float(b)).cast("double") for b in below)


TREES_PER_PLAN = 20


class BaggedForest(Transformer):
    """Trees grown on their own bags; the class with the most votes, of equal ones the smaller code."""

    def __init__(self, index: StringIndexerModel, trees: list[RandomForestClassificationModel], seed: int):
        super().__init__()
        self.index, self.trees, self.seed = index, trees, seed

    @property
    def featureImportances(self) -> DenseVector:
        total = sum(t.featureImportances.toArray() for t in self.trees)
        return DenseVector(total / max(total.sum(), 1e-300))

    def votes(self, df: DataFrame, unseen: bool = False) -> DataFrame:
        """sample_id, v0, v1, ...: votes for each class code; ``unseen`` counts the trees alone whose bag lacks the row."""
        rows = self.index.transform(df).select("sample_id", "features")
        classes, out = range(len(self.index.labels)), None
        for first in range(0, len(self.trees), TREES_PER_PLAN):
            part, given = rows, []
            for k in range(first, min(first + TREES_PER_PLAN, len(self.trees))):
                part = self.trees[k].transform(part)
                vote = F.col(self.trees[k].getPredictionCol())
                given.append(F.when(bag_weight("sample_id", k, self.seed) == 0, vote) if unseen else vote)
            part = part.select("sample_id", F.array_compact(F.array(*given)).alias("given"))
            counted = part.select("sample_id", *[(F.size("given") - F.size(F.array_remove("given", float(c)))).alias(f"v{c}") for c in classes])
            out = counted if out is None else out.unionByName(counted)
        return out.groupBy("sample_id").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in classes])

    def elected(self, df: DataFrame, unseen: bool = False) -> DataFrame:
        """The rows with label and prediction; those without any vote are left out."""
        names = [f"v{c}" for c in range(len(self.index.labels))]
        most = F.greatest(*names) if len(names) > 1 else F.col(names[0])
        votes = self.votes(df, unseen).filter(most > 0)
        votes = votes.select("sample_id", (F.array_position(F.array(*names), most) - 1).cast("double").alias("prediction"))
        return self.index.transform(df).join(votes, "sample_id")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.elected(dataset)


def bagged_forest(train: DataFrame, trees: int = 500, seed: int = 1234, parallelism: int = 8, **options) -> BaggedForest:
    """Each tree is fitted to the rows of its bag, weighted, with features drawn at each split."""
    index = label_index().fit(train)
    with fit_table(index.transform(train)) as rows:

        def grow(k: int) -> RandomForestClassificationModel:
            grower = RandomForestClassifier(
                numTrees=1, bootstrap=False, weightCol="_weight", featureSubsetStrategy="sqrt", seed=seed + k,
                predictionCol=f"_tree{k}", rawPredictionCol="", probabilityCol="", **options,
            )
            return grower.fit(rows.withColumn("_weight", bag_weight("sample_id", k, seed)).filter("_weight > 0"))

        with ThreadPoolExecutor(parallelism) as pool:
            return BaggedForest(index, list(pool.map(grow, range(trees))), seed)


def forest_report(train: DataFrame, test: DataFrame, trees: int = 500, seed: int = 1234, **options) -> tuple[BaggedForest, DataFrame]:
    """A forest with its out-of-bag error on training rows and its test error: ``(split, ...metrics)``.

    A training row is judged by the trees whose bag lacks it; one that all trees saw is not judged.
    """
    model = bagged_forest(train, trees, seed, **options)
    rows = metrics_of(model.elected(train, unseen=True)).withColumn("split", F.lit("train"))
    return model, rows.unionByName(metrics_of(predicted(model, test)).withColumn("split", F.lit("test")))

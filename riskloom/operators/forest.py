"""Permutation importance: a forest as flat arrays, and a task for each shuffle of a feature.

Spark fits the forest on the bounded sample; its nodes are read back as arrays, which with
the sample are all that a task needs. No copy of the sample is made but the column a task shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import numeric

TREES, DEPTH, REPEATS, SEED = 80, 6, 5, 42


@dataclass
class Forest:
    """Nodes of all trees: the feature a node asks for (-1: a leaf), its threshold, where its
    children stand, and what a leaf says (class shares, or one number). Row 0 of a tree is its root."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    @staticmethod
    def of(nodes: pd.DataFrame, classification: bool) -> Forest:
        """From the nodes Spark ML saves, one a row."""
        data = nodes.sort_values(["treeID", "id"], kind="stable").reset_index(drop=True)
        size = data.groupby("treeID").size()
        roots = np.r_[0, np.cumsum(size.to_numpy())[:-1]]
        base = np.repeat(roots, size.to_numpy())
        threshold = np.array([t[0] if t is not None and len(t) else 0.0 for t in data.leftCategoriesOrThreshold])
        if classification:
            stats = np.stack([np.asarray(x, float) for x in data.impurityStats])
            value = stats / np.maximum(stats.sum(1, keepdims=True), 1e-300)
        else:
            value = data.prediction.to_numpy(float)[:, None]
        leaf = data.leftChild.to_numpy() < 0
        return Forest(np.where(leaf, -1, data.featureIndex), threshold, base + data.leftChild.to_numpy(), base + data.rightChild.to_numpy(), value, roots)

    def says(self, x: np.ndarray) -> np.ndarray:
        """(rows, values): the mean of the trees' leaves."""
        total, rows = np.zeros((len(x), self.value.shape[1])), np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            open_ = rows[self.feature[at] >= 0]
            while len(open_):
                node = at[open_]
                at[open_] = np.where(x[open_, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
                open_ = open_[self.feature[at[open_]] >= 0]
            total += self.value[at]
        return total / len(self.roots)


def fitted(spark: SparkSession, x: np.ndarray, y: np.ndarray, classification: bool, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    columns = [f"f{i}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=columns).assign(label=y)
    if classification:
        counts = np.bincount(y.astype(int))
        pdf["w"] = (len(y) / (np.count_nonzero(counts) * counts[y.astype(int)])).astype(float)
    rows = spark.createDataFrame(pa.Table.from_pandas(pdf, preserve_index=False))
    learner = RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="w", seed=seed) if classification else RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed)
    model = learner.fit(VectorAssembler(inputCols=columns, outputCol="features").transform(rows))
    since = scratch.mark()
    try:
        path = scratch.place(spark, "forest")
        model.write().save(path)
        # At most 2 ** (depth + 1) nodes a tree.
        return Forest.of(spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*", "nodeData.split.*").drop("split").toPandas(), classification)
    finally:
        scratch.release(since)


def score(said: np.ndarray, y: np.ndarray, classification: bool) -> float:
    """AUC of two classes, weighted F1 of more, mean absolute error (negative) of a number."""
    if not classification:
        return -float(np.abs(y - said[:, 0]).mean())
    if len(np.unique(y)) == 2:
        return numeric.auc(said[:, int(y.max())], y == y.max())
    return numeric.weighted_f1(y.astype(int), said.argmax(1), int(y.max()) + 1)


def permutation_importance(spark: SparkSession, sample: pd.DataFrame, target: str, classification: bool, trees: int = TREES, depth: int = DEPTH, repeats: int = REPEATS, seed: int = SEED) -> dict[str, float]:
    """Fall of a forest's score on its own rows when a feature is shuffled, over the largest fall; empty below 2 features or 100 rows."""
    names = [n for n in sample.columns if n != target]
    rows = sample.dropna(subset=[target])
    if len(names) < 2 or len(rows) < 100:
        return {}
    x, y = rows[names].fillna(rows[names].median()).fillna(0.0).to_numpy(float), rows[target].to_numpy(float)
    forest = fitted(spark, x, y, classification, trees, depth, seed)
    base = score(forest.says(x), y, classification)
    # The sample is bounded by its size, the forest by trees and depth.
    shared = spark.sparkContext.broadcast((forest, x, y))

    def run(batches):
        for batch in batches:
            f, own, label = shared.value
            out = []
            for i, k in zip(batch.feature.tolist(), batch.repeat.tolist()):
                column = own[:, i].copy()
                own[:, i] = column[np.random.default_rng([seed, i, k]).permutation(len(column))]
                out.append((i, score(f.says(own), label, classification)))
                own[:, i] = column
            yield pd.DataFrame(out, columns=["feature", "score"])

    tasks = len(names) * repeats
    asked = spark.createDataFrame([(i, k) for i in range(len(names)) for k in range(repeats)], "feature int, repeat int").repartition(min(tasks, 4 * spark.sparkContext.defaultParallelism))
    got = asked.mapInPandas(run, "feature int, score double").groupBy("feature").agg(F.avg("score").alias("score")).collect()
    fall = {names[r.feature]: max(0.0, base - r.score) for r in got}
    most = max(fall.values(), default=0.0)
    return {k: (v / most if most > 0 else 0.0) for k, v in sorted(fall.items())}

"""Forests whose bags follow the record key, not the partition layout.

Spark draws bootstrap weights per partition, so the same rows in another
layout grow another forest.  Here the weight of a row in a tree is a Poisson(1)
number drawn from a hash of (seed, tree, key) and handed to the tree as its
``weightCol``; feature subsets are seeded by the tree.  The same keys thus give
the same bags on any cluster, a tree does not depend on how many others there
are, and a forest can be extended without growing its trees again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.functions.exprs import col_of
from paysift.operators import train as TR

WEIGHT = "__weight"


def poisson_steps(most: int = 12) -> list[float]:
    """P(X <= k) of Poisson(1), k = 0..most - 1; beyond it is rounded to 1
    at the hash's 32 bits."""
    out, total = [], 0.0
    for k in range(most):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(total)
    return out


def bag_weight(key: str, tree: int, seed: int = TR.SEED) -> Column:
    """How often a row is in a tree's bag: 0, 1, 2, ... as a double."""
    text = F.concat(F.lit(f"{seed}:{tree}:"), col_of(key).cast("string"))
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") \
        / F.lit(4294967296.0)
    steps = poisson_steps()
    out = F.when(u < F.lit(steps[0]), F.lit(0.0))
    for k, p in enumerate(steps[1:], 1):
        out = out.when(u < F.lit(p), F.lit(float(k)))
    return out.otherwise(F.lit(float(len(steps))))


def _tree_seed(seed: int, tree: int) -> int:
    own = hashlib.md5(f"{seed}/{tree}".encode()).digest()
    return int.from_bytes(own[:7], "big")


class BaggedForest:
    """Trees of ``fit_bagged_forest``: the mean of their predictions, the
    mean of their importances."""

    def __init__(self, trees: Sequence, prediction: str = "prediction"):
        self.trees, self.prediction = list(trees), prediction

    def copy(self) -> BaggedForest:
        return BaggedForest(self.trees, self.prediction)

    def setPredictionCol(self, name: str) -> BaggedForest:
        self.prediction = name
        return self

    @property
    def featureImportances(self):
        total = np.sum([t.featureImportances.toArray()
                        for t in self.trees], axis=0)
        return Vectors.dense(total / (total.sum() or 1.0))

    def transform(self, df: DataFrame) -> DataFrame:
        names = [f"__{self.prediction}_{i}" for i in range(len(self.trees))]
        for t, name in zip(self.trees, names):
            df = t.copy().setPredictionCol(name).transform(df)
        total = F.lit(0.0)
        for name in names:
            total = total + F.col(name)
        return df.withColumn(self.prediction, total / len(names)) \
            .drop(*names)


def fit_bagged_forest(train: DataFrame, label: str, features: str, key: str,
                      trees: int | Sequence[int] = 20, seed: int = TR.SEED,
                      subset: str = "onethird", parallelism: int | None = None,
                      **params) -> BaggedForest:
    """A forest of ``trees`` trees (a number, or the numbers of the trees to
    grow), bagged by ``key``.  Trees are fitted side by side; ``params`` are
    those of ``train.forest``."""
    train = TR.packed(train)
    params.setdefault("max_bins", TR.safe_max_bins(train, features,
                                                   TR.L.MAX_BINS))
    numbers = range(trees) if isinstance(trees, int) else trees

    def fit(i: int):
        est = TR.forest(label, features, numTrees=1, bootstrap=False,
                        featureSubsetStrategy=subset,
                        seed=_tree_seed(seed, i), weightCol=WEIGHT, **params)
        bag = train.withColumn(WEIGHT, bag_weight(key, i, seed))
        return est.fit(bag.filter(F.col(WEIGHT) > 0))
    found = TR.run_concurrently({i: (lambda i=i: fit(i)) for i in numbers},
                                parallelism or TR.in_flight(train),
                                train.sparkSession)
    return BaggedForest([found[i] for i in numbers])


def bag_leaves(model: BaggedForest, df: DataFrame, key: str,
               seed: int = TR.SEED) -> DataFrame:
    """(tree, leaf, weight, prediction) of a forest whose trees are numbered
    from 0: the weight of the bag in each leaf, from one scan."""
    rows = []
    for i, t in enumerate(model.trees):
        m = t.copy().setLeafCol(f"__l{i}").setPredictionCol(f"__p{i}")
        df = m.transform(df)
        leaf = TR.vector_to_array(F.col(f"__l{i}"))[0].cast("int")
        rows.append(F.struct(
            F.lit(i).alias("tree"), leaf.alias("leaf"),
            bag_weight(key, i, seed).alias("w"),
            F.col(f"__p{i}").alias("p")))
    return df.select(F.inline(F.array(*rows))).filter("w > 0") \
        .groupBy("tree", "leaf").agg(F.sum("w").alias("weight"),
                                     F.max("p").alias("prediction"))

"""Gradient-boosted trees: trained by Spark's own learner on a bounded sample, then held as plain trees.

The trees can be scored as one Column expression, which stays inside code generation, or by numpy inside a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Forest:
    names: list[str]
    trees: list[tuple] = field(default_factory=list)  # (weight, node); node: a value, or (feature, threshold, left, right)
    scale: float = 2.0  # of the margin: probability = 1 / (1 + exp(-scale * margin))

    def column(self) -> Column:
        """The margin as nested conditions on the columns of ``names``; nulls go right."""

        def tree(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            i, at, left, right = node
            return F.when(F.col(self.names[i]) <= at, tree(left)).otherwise(tree(right))

        return sum((F.lit(float(w)) * tree(t) for w, t in self.trees), F.lit(0.0))

    def margin(self, x):
        """The margins of the rows of a numpy matrix."""
        import numpy as np

        def tree(node, rows):
            if not isinstance(node, tuple):
                return np.full(len(rows), float(node))
            i, at, left, right = node
            out, small = np.empty(len(rows)), x[rows, i] <= at
            out[small], out[~small] = tree(left, rows[small]), tree(right, rows[~small])
            return out

        rows = np.arange(len(x))
        return sum((w * tree(t, rows) for w, t in self.trees), np.zeros(len(x)))

    def probability(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-self.scale * self.margin(x)))


def train(sample: DataFrame, names: list[str], label: str = "label", rounds: int = 12, depth: int = 4, seed: int = 7) -> Forest:
    """Fit on a sample (bounded by the caller) with a double column for each name and a 0/1 label.

    A sample of one class, or an empty one, gives one tree that always says that class (an empty one: 0).
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = sample.select(*[F.col(x).cast("double") for x in names], F.col(label).cast("double").alias("label"))
    low, high = rows.agg(F.min("label"), F.max("label")).first()
    if low == high:
        return Forest(names, [(1.0, 4.0 if low == 1.0 else -4.0)])
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label")
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.3, minInstancesPerNode=4, maxBins=64).fit(data)

    def node(n):
        if n.subtreeDepth() == 0:
            return n.prediction()
        return (n.split().featureIndex(), n.split().threshold(), node(n.leftChild()), node(n.rightChild()))

    weights = model.treeWeights
    return Forest(names, [(w, node(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode"))) for w, t in zip(weights, model.trees, strict=True)])

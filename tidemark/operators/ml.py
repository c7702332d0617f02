"""Churn models: training frame, boosted trees, batch scores and metrics."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import impute
from ..schemas import FEATURES
from .labels import class_weight
from .ranges import running
from .serving import DECISION, assign

ENRICHMENT = ("avg_delivery_delay_days", "avg_review_score", "avg_payment_installments")


def training_frame(features: DataFrame, labels: DataFrame | None = None, enrichment: DataFrame | None = None) -> DataFrame:
    """Features, enrichment and ``label``. Without labels the label is more than 7 days since the last
    purchase, which is a function of a feature: scores on it only prove that the parts fit."""
    frame = features if enrichment is None else features.join(enrichment, "user_id", "left")
    if labels is not None:
        frame = frame.join(labels.select("user_id", "label"), "user_id")
    else:
        frame = frame.withColumn("label", (F.col("days_since_last_purchase") > 7).cast("int"))
    return impute(frame, (*FEATURES, *(ENRICHMENT if enrichment is not None else ())))


def train(frame: DataFrame, features: tuple[str, ...] = FEATURES, trees: int = 30, depth: int = 4, rate: float = 0.1, seed: int = 42) -> PipelineModel:
    """Boosted trees with the positive class weighted by n_neg / n_pos."""
    weight = class_weight(frame, "label").first().scale_pos_weight
    weighted = frame.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="features"),
        GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed),
    ]
    return Pipeline(stages=stages).fit(weighted)


def score(model: PipelineModel | Ensemble, frame: DataFrame) -> DataFrame:
    """(user_id, score, churn_prediction) of every row."""
    if isinstance(model, Ensemble):
        return model.score(frame)
    scored = model.transform(frame).withColumn("score", vector_to_array("probability")[1])
    return scored.select("user_id", "score", (F.col("score") >= DECISION).alias("churn_prediction"))


def predict(champion: PipelineModel | Ensemble, challenger: PipelineModel | Ensemble, frame: DataFrame, champion_share: float = 0.9) -> DataFrame:
    """Scores by the model of each user's group."""
    routed = assign(frame, champion_share)
    parts = [score(m, routed.filter(F.col("ab_group") == g)).withColumn("ab_group", F.lit(g)) for g, m in (("champion", champion), ("challenger", challenger))]
    return parts[0].unionByName(parts[1])


def binary_metrics(scored: DataFrame, label: str = "label") -> DataFrame:
    """One row of precision, recall, F1 and base rate at the decision threshold; 0 where undefined."""
    hit, real = F.col("score") >= DECISION, F.col(label) == 1
    counts = scored.agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.count("*").alias("n"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "n", "tp", "fp", "fn",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + fn, F.col("n")).alias("base_rate"),
    )


def auc(scored: DataFrame, label: str = "label", buckets: int = 1024) -> DataFrame:
    """One row, ``auc``: the share of (positive, negative) pairs that the score puts in order, ties as a half.

    Exact. The negatives up to a score are a running sum over the distinct scores, in ``buckets`` ranges of about as
    many of them, however they bunch. Null without both classes.
    """
    counts = scored.groupBy("score").agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    ordered = running(counts, {"upto": ("sum", F.col("neg"))}, "score", ranges=buckets)
    pairs = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    return ordered.agg((pairs / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def feature_importance(model: PipelineModel, features: tuple[str, ...] = FEATURES) -> list[tuple[str, float]]:
    weights = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, weights, strict=True), key=lambda p: -p[1])


@dataclass(frozen=True)
class Leaf:
    """A leaf's value, and for each feature on its path the range (low, high] that leads there and the share of rows it keeps."""

    value: float
    ranges: dict[int, tuple[float, float, float]]


#: A tree as (feature, cut, left, right), left where the feature is at most the cut, or a leaf as (value, rows).
Tree = tuple


def leaves_of(tree: Tree, weight: float = 1.0) -> list[Leaf]:
    """The leaves of a tree, values times ``weight``."""

    def rows(node: Tree) -> float:
        return node[1] if len(node) == 2 else rows(node[2]) + rows(node[3])

    def walk(node: Tree, ranges: dict[int, tuple[float, float, float]]) -> list[Leaf]:
        if len(node) == 2:
            return [Leaf(node[0] * weight, ranges)]
        feature, cut, *children = node
        low, high, share = ranges.get(feature, (-math.inf, math.inf, 1.0))
        bounds = ((low, min(high, cut)), (max(low, cut), high))
        return [leaf for child, b in zip(children, bounds, strict=True) for leaf in walk(child, ranges | {feature: (*b, share * rows(child) / rows(node))})]

    return walk(tree, {})


@dataclass(frozen=True)
class Ensemble:
    """Boosted trees as column expressions over an array of feature values: margin, probability, Shapley values.

    An expression folds over a constant table of the leaves, so a row is scored where it is, in the JVM, without a model
    to load. The table is as large as the model: a leaf's path, and for each of its features one number for every
    subset of the path's conditions that a row may meet, 2 ** 4 at depth 4.
    """

    features: tuple[str, ...]
    leaves: tuple[Leaf, ...]

    @classmethod
    def of_trees(cls, features: tuple[str, ...], trees: list[Tree]) -> Ensemble:
        return cls(tuple(features), tuple(leaf for t in trees for leaf in leaves_of(t)))

    @classmethod
    def of_model(cls, model: PipelineModel, features: tuple[str, ...] = FEATURES) -> Ensemble:
        """The trees of a fitted model, whose splits are on numbers."""
        boosted = model.stages[-1]

        def read(node) -> Tree:
            if node.subtreeDepth() == 0:
                return node.prediction(), node.impurityStats().count()
            return node.split().featureIndex(), node.split().threshold(), read(node.leftChild()), read(node.rightChild())

        trees = zip(boosted.trees, boosted.treeWeights, strict=True)
        return cls(tuple(features), tuple(leaf for tree, weight in trees for leaf in leaves_of(read(tree._call_java("rootNode")), weight)))

    @property
    def base(self) -> float:
        """The margin of a row of which nothing is known."""
        return sum(leaf.value * math.prod(share for *_, share in leaf.ranges.values()) for leaf in self.leaves)

    @staticmethod
    def _path(leaf: Leaf) -> list[dict]:
        finite = lambda x: x if math.isfinite(x) else None
        return [{"f": f + 1, "low": finite(low), "high": finite(high)} for f, (low, high, _) in leaf.ranges.items()]

    @staticmethod
    def _effects(leaf: Leaf, feature: int) -> list[float]:
        """The Shapley value of a feature for every set of the path's conditions that hold, the first condition in the highest bit."""
        own = list(leaf.ranges)
        n, share = len(own), [s for *_, s in leaf.ranges.values()]
        i = own.index(feature)
        others = [j for j in range(n) if j != i]
        out = []
        for met in range(1 << n):
            holds = [met >> (n - 1 - j) & 1 for j in range(n)]
            total = 0.0
            for size in range(n):
                weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                for known in combinations(others, size):
                    total += weight * math.prod(holds[j] if j in known else share[j] for j in others)
            out.append(leaf.value * (holds[i] - share[i]) * total)
        return out

    @staticmethod
    def _table(entries: list[dict]) -> Column:
        return F.from_json(F.lit(json.dumps(entries)), "array<struct<path: array<struct<f: int, low: double, high: double>>, v: array<double>>>")

    @staticmethod
    def _met(x: Column, step: Column) -> Column:
        value = F.element_at(x, step["f"])
        return F.coalesce(value > step["low"], F.lit(True)) & F.coalesce(value <= step["high"], F.lit(True))

    def _values(self) -> Column:
        return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features])

    def margin(self, x: Column) -> Column:
        """The sum of the leaves that a row falls into; ``x`` is the array of its features' values."""
        table = self._table([{"path": self._path(leaf), "v": [leaf.value]} for leaf in self.leaves])
        return F.aggregate(table, F.lit(0.0), lambda s, e: s + F.when(F.forall(e["path"], lambda p: self._met(x, p)), e["v"][0]).otherwise(0.0))

    def contributions(self, x: Column) -> Column:
        """An array of Shapley values of the margin, one for each feature in order."""

        def one(feature: int) -> Column:
            table = self._table([{"path": self._path(leaf), "v": self._effects(leaf, feature)} for leaf in self.leaves if feature in leaf.ranges])
            met = lambda e: F.aggregate(e["path"], F.lit(0), lambda m, p: 2 * m + F.when(self._met(x, p), 1).otherwise(0))
            return F.aggregate(table, F.lit(0.0), lambda s, e: s + F.element_at(e["v"], met(e) + 1))

        return F.array(*[one(i) for i in range(len(self.features))])

    def score(self, frame: DataFrame) -> DataFrame:
        """(user_id, score, churn_prediction) of every row, as ``score`` gives them."""
        scored = frame.select("user_id", (1 / (1 + F.exp(-2 * self.margin(self._values())))).alias("score"))
        return scored.withColumn("churn_prediction", F.col("score") >= DECISION)


def contributions(model: PipelineModel | Ensemble, frame: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(user_id, base, margin, contributions): Shapley values of each row's margin, one for each feature in order.

    Path-dependent values of trees (Lundberg and others, 2018): of a feature that is not known, a split is followed both ways in
    proportion to the training rows. Each leaf is a product of one factor for each feature on its path, so its
    Shapley values are sums over subsets of these few features. ``base`` plus the contributions is ``margin``; the probability
    is the logistic function of twice the margin. One narrow pass of column expressions.
    """
    trees = model if isinstance(model, Ensemble) else Ensemble.of_model(model, features)
    rows = impute(frame, trees.features).select("user_id", trees._values().alias("x"))
    return rows.select("user_id", F.lit(trees.base).alias("base"), trees.margin(F.col("x")).alias("margin"), trees.contributions(F.col("x")).alias("contributions"))


def global_importance(explained: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(feature, mean_abs_shap): the mean size of each feature's contribution over all rows; one partial aggregation of one row."""
    means = explained.agg(*[F.avg(F.abs(F.col("contributions")[i])).alias(f"m{i}") for i in range(len(features))])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean_abs_shap")) for i, f in enumerate(features)])
    return means.select(F.inline(pairs))

"""Trained scorers on Spark ML, the scorer contract and ensemble combination."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrec.functions import arrays as A


class Scorer(Protocol):
    """Fit on a labelled table, score any table with a ``probs`` array, save and load."""

    def fit(self, df: DataFrame) -> Scorer: ...

    def score(self, df: DataFrame) -> DataFrame: ...

    def save(self, path: str) -> None: ...


@dataclass(frozen=True)
class PropensityParams:
    """Boosting settings of the purchase-propensity model."""

    trees: int = 150
    depth: int = 6
    rate: float = 0.05
    row_share: float = 0.8
    seed: int = 42


class PropensityModel:
    """Gradient-boosted trees for the probability that anything is acquired."""

    def __init__(self, features: Sequence[str], label: str = "y", params: PropensityParams = PropensityParams()):
        self.features, self.label, self.params = list(features), label, params
        self.model: PipelineModel | None = None

    def fit(self, df: DataFrame) -> PropensityModel:
        p = self.params
        trees = GBTClassifier(
            featuresCol="_features", labelCol="_buys", maxIter=p.trees, maxDepth=p.depth,
            stepSize=p.rate, subsamplingRate=p.row_share, seed=p.seed,
        )
        assembler = VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="keep")
        marked = df.withColumn("_buys", (F.col(self.label) > 0).cast("double"))
        self.model = Pipeline(stages=[assembler, trees]).fit(marked)
        return self

    def score(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df)
        return scored.select(*df.columns, vector_to_array("probability")[1].alias("p_buy"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> PropensityModel:
        self.model = PipelineModel.load(path)
        return self


class ClassModel:
    """Multiclass baseline: a random forest or a small perceptron.

    Classes that never occur in training get probability zero.
    """

    def __init__(self, features: Sequence[str], label: str = "y", n_classes: int = 16, kind: str = "forest", seed: int = 42, **settings):
        self.features, self.label, self.n_classes = list(features), label, n_classes
        self.kind, self.seed, self.settings = kind, seed, settings
        self.model: PipelineModel | None = None

    def fit(self, df: DataFrame) -> ClassModel:
        assembler = VectorAssembler(inputCols=self.features, outputCol="_raw", handleInvalid="keep")
        scaler = StandardScaler(inputCol="_raw", outputCol="_features", withMean=True)
        common = {"featuresCol": "_features", "labelCol": self.label, "seed": self.seed}
        if self.kind == "forest":
            last = RandomForestClassifier(**{"numTrees": 50, "maxDepth": 8, **self.settings}, **common)
        elif self.kind == "perceptron":
            layers = [len(self.features), *self.settings.get("hidden", (32,)), self.n_classes]
            last = MultilayerPerceptronClassifier(layers=layers, maxIter=self.settings.get("iterations", 50), **common)
        else:
            raise ValueError(f"unknown kind {self.kind}")
        self.model = Pipeline(stages=[assembler, scaler, last]).fit(df)
        return self

    def score(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df)
        return scored.select(
            *df.columns, A.pad(vector_to_array("probability"), self.n_classes).alias("probs")
        )

    def recommend(self, df: DataFrame, held: str, k: int = 7) -> DataFrame:
        ranked = A.ranked_classes(F.col("probs"))
        return self.score(df).withColumn("recs", A.unheld_topk(ranked, F.col(held), k))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> ClassModel:
        self.model = PipelineModel.load(path)
        return self


def plug_in_scorer(
    make_predict: Callable, vector: str, width: int, batch_size: int = 1024
) -> Callable[[DataFrame], DataFrame]:
    """Scorer from a foreign model: ``make_predict`` loads it once per Python worker.

    The model gets batches of shape (rows, ``width``) and returns (rows, classes).
    """
    udf = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )

    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("probs", udf(F.col(vector)))

    return score


def ensemble_average(members: DataFrame, key: str, temperature: float = 1.0) -> DataFrame:
    """Mean logit of each (row, class) over members, softmaxed per row.

    ``members`` holds (key, member, class_id, logit), class_id already in the
    original order; see ``undo_permutation``.
    """
    means = members.groupBy(key, "class_id").agg(F.avg("logit").alias("logit"))
    rows = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("class_id", "logit"))).alias("_l"))
    return rows.select(
        key, A.tempered(F.transform("_l", lambda s: s["logit"]), temperature).alias("probs")
    )


def undo_permutation(members: DataFrame, permutations: dict[int, Sequence[int]]) -> DataFrame:
    """Map a member's permuted class position back: position i holds class perm[i]."""
    pairs = F.lit(-1)
    for member, perm in permutations.items():
        order = F.array(*[F.lit(int(c)) for c in perm])
        pairs = F.when(F.col("member") == member, F.get(order, F.col("class_id"))).otherwise(pairs)
    return members.withColumn("class_id", pairs)


def ensemble_mean(members: DataFrame, key: str, value: str = "prediction") -> DataFrame:
    return members.groupBy(key).agg(F.avg(value).alias(value))


def target_stats(df: DataFrame, target: str, sample: bool = False) -> tuple[float, float]:
    spread = F.stddev_samp(target) if sample else F.stddev_pop(target)
    mean, std = df.agg(F.avg(target), spread).first()
    return mean, std

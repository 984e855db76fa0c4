"""K2/K3 re-aimed: the reference fine-tunes transformers on one machine; here
the same training data (oversampled, class-weighted) trains models that run
distributed: tokens -> hashed term frequencies -> IDF -> logistic regression,
K2 as a Spark ML pipeline, K3 by one joint fit of all label positions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogset.functions.text import TOKEN_PATTERN
from dialogset.operators.splits import class_ratio, oversample
from dialogset.plans.joint import JointModel, fit_joint, predict_joint


def _features(text_col: str, num_features: int):
    return [
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_feat"),
    ]


def class_weighted(train: DataFrame, label: str = "label") -> DataFrame:
    """F4 oversampling, then the row weight ``class_ratio[label]`` (A7 after
    oversampling), as the reference's weighted cross-entropy."""
    over = oversample(train, label)
    ratio = class_ratio(over, label).select("ratio").scalar()
    return over.withColumn("weight", F.get(ratio, F.col(label).cast("int")))


def train_binary(train: DataFrame, text_col: str = "text", label: str = "label",
                 num_features: int = 1 << 18, max_iter: int = 50) -> PipelineModel:
    """K2: binary classifier on oversampled, class-weighted rows."""
    data = class_weighted(train, label).withColumn("_y", F.col(label).cast("double"))
    lr = LogisticRegression(featuresCol="_feat", labelCol="_y", weightCol="weight", maxIter=max_iter,
                            rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="_pred")
    return Pipeline(stages=[*_features(text_col, num_features), lr]).fit(data)


def predict_binary(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Scores as ``logits`` (raw margins) and ``probs`` (softmax of them)."""
    out = model.transform(df)
    return out.select(*keep, vector_to_array("_raw").alias("logits"), vector_to_array("_prob").alias("probs"))


def train_multilabel(train: DataFrame, width: int, text_col: str = "text", label: str = "multi",
                     num_features: int = 1 << 18, max_iter: int = 50) -> JointModel:
    """K3: one logistic regression per label position, all fitted by the same
    passes over the rows."""
    return fit_joint(train, width, text_col, label, num_features, max_iter)


def predict_multilabel(model: JointModel, df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``probs``: per-position positive-class probability (sigmoid of the margin)."""
    return predict_joint(model, df, keep, text_col)

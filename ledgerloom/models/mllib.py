"""Naive Bayes as an MLlib pipeline over hashed terms, an alternative to the exact table form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import (
    IDF,
    HashingTF,
    IndexToString,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places that terms are hashed to; the model has as many weights for each label, whatever the vocabulary.
PLACES = 1 << 18


def stages(places: int = PLACES) -> list:
    """Words and pairs of words, counted by place, weighted by rarity, to unit length; naive Bayes on top."""
    return [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\w\w+", gaps=False),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        HashingTF(inputCol="terms", outputCol="counts", numFeatures=places),
        IDF(inputCol="counts", outputCol="rare"),
        Normalizer(inputCol="rare", outputCol="tfidf"),
        NaiveBayes(modelType="multinomial", smoothing=0.1, featuresCol="tfidf", labelCol="label", weightCol="weight"),
    ]


@dataclass(frozen=True)
class LabelModel:
    """A fitted pipeline with its label names."""

    pipeline: PipelineModel
    labels: StringIndexerModel

    def predict(self, df: DataFrame) -> DataFrame:
        named = IndexToString(inputCol="prediction", outputCol="predicted_category", labels=self.labels.labels)
        said = named.transform(self.pipeline.transform(df))
        return said.withColumn("predicted_probability", F.array_max(vector_to_array("probability"))).select(
            *df.columns, "predicted_category", "predicted_probability"
        )


def fit(frame: DataFrame, places: int = PLACES) -> LabelModel:
    """Fit on a training frame (text, category_name, weight)."""
    kept = frame.persist()  # every stage of the pipeline passes over it
    try:
        labels = StringIndexer(
            inputCol="category_name", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"
        ).fit(kept)
        return LabelModel(Pipeline(stages=stages(places)).fit(labels.transform(kept)), labels)
    finally:
        kept.unpersist()

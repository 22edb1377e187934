"""Class codes of regions, and what models predict for them."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame

from demescope.operators.class_metrics import macro_metrics
from demescope.operators.contingency import confusion


def label_index() -> StringIndexer:
    """Regions to codes in alphabetical order, so codes do not depend on counts."""
    return StringIndexer(inputCol="region", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep")


def predicted(model: Transformer, df: DataFrame) -> DataFrame:
    """sample_id, region, features, label, prediction."""
    return model.transform(df).select("sample_id", "region", "features", "label", "prediction")


def metrics_of(predictions: DataFrame) -> DataFrame:
    return macro_metrics(confusion(predictions))

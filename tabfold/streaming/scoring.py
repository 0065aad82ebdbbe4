from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stream(model, stream: DataFrame) -> DataFrame:
    """Predictions for every arriving row (same columns as batch ``transform``)."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame (spark.readStream...)")
    return model.transform(stream)


def streaming_confusion(scored: DataFrame, label_col: str = "indexedLabel",
                        pred_col: str = "prediction") -> DataFrame:
    """Running ``(label, prediction, n)`` counts; write with outputMode
    'complete' or 'update'. State is one row per class pair."""
    return scored.groupBy(label_col, pred_col).agg(F.count(F.lit(1)).alias("n"))

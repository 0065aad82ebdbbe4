"""Scoring with fitted pipelines over Structured Streaming sources.

The reference has no streams. What carries over is scoring (M7) and the
confusion counts behind its metrics (A9): a fitted ``PipelineModel`` is a
chain of row-wise transformers, so it applies to a streaming DataFrame
unchanged, and the counts are a streaming aggregation.
"""

from tabfold.streaming.scoring import score_stream, streaming_confusion  # noqa: F401

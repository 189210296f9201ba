"""Structured Streaming forms of scoring and audit logging.

Both are stateless: the batch operators are applied unchanged to each
micro-batch. Sinks are idempotent per batch (a replayed batch id overwrites
its own partition), and progress lives in a checkpoint location on shared
storage, so a restarted query neither loses nor duplicates rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import vector_to_columns
from ..operators import records as R
from ..operators import scoring as SC


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def score_requests_batch(df: DataFrame, scorer, threshold: float, features: Sequence[str],
                         json_col: str = "body", key: str = "request_id"):
    """One micro-batch (or a static table) of JSON requests → (scored
    predictions with audit details, rejects)."""
    valid, rejects = R.parse_feature_requests(df, json_col, len(features), keep=[key])
    rows = vector_to_columns(valid, "features", features, keep=[key])
    scored = SC.score_cases(rows, scorer, threshold, key)
    return scored, rejects


def score_stream(stream: DataFrame, scorer, threshold: float, features: Sequence[str],
                 out_path: str, rejects_path: str, checkpoint: str,
                 json_col: str = "body", key: str = "request_id",
                 available_now: bool = False, processing_time: str | None = None
                 ) -> StreamingQuery:
    """K1: a stream of JSON feature requests → scored records and rejects,
    two sinks written per batch in ``foreachBatch``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        scored, rejects = score_requests_batch(batch, scorer, threshold, features, json_col, key)
        _write_batch(scored, out_path, batch_id)
        _write_batch(rejects, rejects_path, batch_id)

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def audit_stream(events: DataFrame, path: str, checkpoint: str,
                 available_now: bool = False) -> StreamingQuery:
    """K2: append audit events (Timestamp, Case_ID, Event_Type, Details) to a
    parquet table; the file sink's commit log makes replays exactly-once."""
    w = (events.select("Timestamp", "Case_ID", "Event_Type", "Details")
               .writeStream.format("parquet").option("path", path)
               .option("checkpointLocation", checkpoint).outputMode("append"))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()

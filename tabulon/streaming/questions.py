"""Questions that arrive one by one: the batch prediction step on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabulon.plans.answer_questions import predict_questions
from tabulon.sources.models import SavedModel


def predict_stream(questions: DataFrame, model: SavedModel) -> DataFrame:
    """Routing, number extraction and scoring are row-wise, so the stream needs no state and no watermark."""
    return predict_questions(questions, model)


def write_predictions(predicted: DataFrame, path: str) -> StreamingQuery:
    """Append to parquet; the checkpoint, which belongs to the sink, makes every question's row appear once, also when
    the stream is started again."""
    return (
        predicted.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{path.rstrip('/')}-checkpoint").start(path)
    )

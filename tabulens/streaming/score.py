"""Scoring an unbounded input with the same model and preprocessing as a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tabulens.operators.meta import Meta
from tabulens.operators.models import Fitted
from tabulens.operators.scoring import predict_batch
from tabulens.session import shared_dir


def read_stream(spark: SparkSession, folder: str, schema: StructType, files: str | None = None) -> DataFrame:
    """New Parquet files of a folder, optionally only those matching a name pattern."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    return reader.parquet(folder)


def stream_score(
    fitted: Fitted,
    meta: Meta,
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keep: list[str] | None = None,
    available_now: bool = False,
    digits: int = 6,
) -> StreamingQuery:
    """Append predictions of each micro-batch as Parquet; stateless and exactly once per file."""
    writer = (
        predict_batch(fitted, meta, stream, keep, digits=digits)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def score_available(
    fitted: Fitted, meta: Meta, stream: DataFrame, keep: list[str] | None = None, digits: int = 6
) -> DataFrame:
    """Score all input available now through the stream and read the sink back."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream_score(fitted, meta, stream, f"{base}/out", f"{base}/state", keep, True, digits)
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")

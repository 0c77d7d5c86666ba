"""New recordings as a stream: decode each file once, detect calls batch by batch.

Recordings are independent of each other, so a micro-batch is a batch job over the files that came in; there is no
state and no watermark to keep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.audio import CHUNK, decode


def stream_chunks(spark: SparkSession, path: str, channel: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Chunks of the WAV files that appear under ``path``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*wav").option("recursiveFileLookup", "true").load(path)
    return decode(files, channel, chunk)


def detect_stream(chunks: DataFrame, detect: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Applies ``detect`` (chunks to boxes) to every micro-batch and writes its boxes under ``path``, one folder for
    each batch: a batch that runs again after a failure replaces its own."""

    def batch(df: DataFrame, number: int) -> None:
        detect(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

"""Applying a caller's model, and what is done with its predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stash
from .boxes import merge_boxes_si


def score_batches(chunks: DataFrame, load_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Batch inference: ``load_model`` runs once in each task and returns the function applied to its batches. A
    batch's size is ``spark.sql.execution.arrow.maxRecordsPerBatch``."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load_model()
        for pdf in it:
            yield predict(pdf)

    return chunks.mapInPandas(run, schema)


def combine_chunk_predictions(predictions: DataFrame, stride: int, confidence: float) -> DataFrame:
    """``predictions``: recording, chunk_id, coordinates (double), label_id, score. Those scoring more than
    ``confidence``, coordinates cut to whole pixels, time moved to the recording's."""
    whole = lambda c: F.col(c).cast("long")
    return predictions.filter(F.col("score") > confidence).select(
        "recording", F.xxhash64("chunk_id", "t_start", "t_end", "freq_start", "freq_end", "label_id", "score").alias("box_id"), whole("freq_start").alias("freq_start"), whole("freq_end").alias("freq_end"), (whole("t_start") + F.col("chunk_id") * stride).alias("t_start"), (whole("t_end") + F.col("chunk_id") * stride).alias("t_end"), "label_id", "score"
    )


def merge_predictions_per_label(boxes: DataFrame, meta: DataFrame, labels: dict[int, str], freq_offset: int = 0, delta_time: float = 0.01) -> DataFrame:
    """Merges the boxes of each label (touching in frequency, at most ``delta_time`` seconds apart), names them and
    moves them up by the bins that were dropped below. Boxes with other label ids (background) are left out."""
    spark = boxes.sparkSession
    names = spark.createDataFrame(list(labels.items()), "label_id int, name string")
    own = stash(boxes.join(F.broadcast(names), "label_id"))  # one row for each label
    merged = merge_boxes_si(own, meta, 0.0, delta_time, keys=("recording", "label_id", "name"))
    return merged.select("recording", "box_id", (F.col("freq_start") + freq_offset).alias("freq_start"), (F.col("freq_end") + freq_offset).alias("freq_end"), "t_start", "t_end", F.col("name").alias("label"), "score")

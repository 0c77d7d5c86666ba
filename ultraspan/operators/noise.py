"""Spans of a recording without calls, to learn its noise from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import time_to_pixels, unit_hash
from ..schemas import GRID_COLUMNS
from .intervals import earlier_end, same
from .spectrogram import exact_percentile, frames_in


def find_noise_spans(boxes: DataFrame, meta: DataFrame, noise_len: float = 1.0) -> DataFrame:
    """recording, span_start, span_end (pixels): gaps of at least ``noise_len`` seconds before a box, or before the end
    of the recording, after the last end of all earlier boxes (0 before the first). Recordings without boxes are one
    gap."""
    px = meta.select("recording", time_to_pixels(F.lit(float(noise_len))).alias("least"), time_to_pixels(F.col("t0") + F.col("dt") * (F.col("n_time") - 1)).alias("stop"))
    ends = px.select("recording", F.col("stop").alias("t_start"), F.col("stop").alias("t_end"), F.lit(1).alias("last"))
    rows = boxes.select("recording", "t_start", "t_end", F.lit(0).alias("last")).unionByName(ends)
    before = F.greatest(F.lit(0).cast("long"), F.coalesce("before", F.lit(0).cast("long")))
    return earlier_end(rows, ("recording",), ("t_start", "last", "t_end")).withColumn("span_start", before).join(px, "recording").filter(F.col("t_start") - F.col("span_start") >= F.col("least")).select("recording", "span_start", F.col("t_start").alias("span_end"))


def weigh_noise_spans(spans: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds ``weight``: mean over bins of the 75 % quantile over time. Only spans longer than one frame are returned."""
    wide = spans.filter("span_end - span_start > 1").select("recording", F.col("span_start").alias("first"), (F.col("span_end") - 1).alias("last"))
    values = frames_in(frames, wide).select("recording", "first", "last", F.posexplode("mags").alias("bin", "mag"))
    bins = exact_percentile(values, ("recording", "first", "last", "bin"), "mag", 0.75, "q")
    return bins.groupBy("recording", F.col("first").alias("span_start"), (F.col("last") + 1).alias("span_end")).agg(F.avg("q").alias("weight"))


def choose_noise_span(weights: DataFrame, meta: DataFrame, noise_len: float = 1.0, seed: int = 0) -> DataFrame:
    """One span for each recording, chosen with probability proportional to its weight (the smallest of -log(u) / w, u
    from a hash of the span and the seed); without one the whole recording. A longer span than ``noise_len`` gives a
    window of that length at a place chosen by hash."""
    u = lambda *cols: unit_hash(F.lit(seed), *cols)
    key = -F.ln(1 - u(F.col("recording"), F.col("span_start"), F.col("span_end"))) / F.col("weight")
    best = weights.filter("weight > 0").groupBy("recording").agg(F.min_by(F.struct("span_start", "span_end"), F.struct(key, F.col("span_start"))).alias("s"))
    rows = meta.join(best, "recording", "left").select(
        "recording", time_to_pixels(F.lit(float(noise_len))).alias("least"), F.coalesce("s.span_start", F.lit(0).cast("long")).alias("a"), F.coalesce("s.span_end", F.col("n_time") - 1).alias("b"), F.col("s").isNull().alias("fallback")
    )
    room = F.col("b") - F.col("a") - F.col("least")
    start = F.when(room > 0, F.col("a") + F.floor(u(F.col("recording"), F.lit("place")) * (room + 1))).otherwise(F.col("a"))
    return rows.withColumn("span_start", start).select("recording", "span_start", F.when(room > 0, F.col("span_start") + F.col("least")).otherwise(F.col("b")).alias("span_end"), "fallback")


def noise_frames(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """The frames of one span for each recording."""
    own = spans.select("recording", F.col("span_start").alias("first"), (F.col("span_end") - 1).alias("last"))
    return frames_in(frames, own).select("recording", "frame", "mags")


def _in_span(noise_spans: DataFrame, boxes: DataFrame, meta: DataFrame, how: str, width: int = 256) -> DataFrame:
    """Spans joined with the boxes that remain after clipping to them, found by an equality join on buckets of time."""
    px = lambda v: time_to_pixels(F.col(v) - F.col("t0"))
    spans = noise_spans.join(meta.select(*GRID_COLUMNS), "recording").select(*noise_spans.columns, px("start").alias("_lo"), px("end").alias("_hi"))
    bucket = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.greatest(F.col(lo), F.col(hi)) / width)))
    b = boxes.filter("t_end >= t_start").select(F.col("recording").alias("_r"), F.col("t_start").alias("_s"), F.col("t_end").alias("_e"))
    hit = spans.withColumn("_b", bucket("_lo", "_hi")).join(b.withColumn("_c", bucket("_s", "_e")), (F.col("recording") == F.col("_r")) & (F.col("_b") == F.col("_c")) & (F.col("_e") > F.col("_lo")) & (F.col("_s") < F.col("_hi")), "left_semi")
    return same(spans.select(noise_spans.columns), hit.select(noise_spans.columns).distinct(), noise_spans.columns, how)


def spans_with_calls(noise_spans: DataFrame, boxes: DataFrame, meta: DataFrame) -> DataFrame:
    """``noise_spans``: recording, config_id, start, end (seconds). Those that hold part of a call, to be rejected."""
    return _in_span(noise_spans, boxes, meta, "left_semi")


def spans_without_calls(noise_spans: DataFrame, boxes: DataFrame, meta: DataFrame) -> DataFrame:
    return _in_span(noise_spans, boxes, meta, "left_anti")

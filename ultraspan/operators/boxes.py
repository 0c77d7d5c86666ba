"""Operators on boxes: conversion, filters, clipping, merging, labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.geometry import position_features as _position
from ..functions.grid import axis_end, axis_value, freq_to_pixels, nearest_index, pixel_span, time_to_pixels, to_pixels
from ..schemas import COORDS, KEYS
from ..shared import stash
from .components import connected_components
from .grouped import longs, map_groups

#: Frames in a block when touching boxes are looked for.
BLOCK = 4096


def _meta(df: DataFrame, meta: DataFrame) -> DataFrame:
    """``meta`` has a row for each recording; Spark broadcasts it when it is small."""
    return df.join(meta.select("recording", "t0", "dt", "n_time", "f0", "df", "n_freq"), "recording")


GRID = ("t0", "dt", "n_time", "f0", "df", "n_freq")


def annotations_to_boxes(annotations: DataFrame, meta: DataFrame) -> DataFrame:
    """``annotations``: begin_file, begin_time, end_time, low_freq, high_freq, usv_type, box_id. Values are clipped to
    the spectrogram, empty ones dropped; starts round down, ends up. ``unknown_files`` lists files without meta."""
    rows = _meta(annotations.withColumnRenamed("begin_file", "recording"), meta)
    t_end, f_end = axis_end(F.col("t0"), F.col("dt"), F.col("n_time")), axis_end(F.col("f0"), F.col("df"), F.col("n_freq"))
    clip = lambda c, lo, hi: F.least(F.greatest(F.col(c), F.col(lo)), hi)
    tspan, fspan = pixel_span(F.col("t0"), F.col("dt"), F.col("n_time")), pixel_span(F.col("f0"), F.col("df"), F.col("n_freq"))
    rows = rows.withColumn("_b", clip("begin_time", "t0", t_end)).withColumn("_e", clip("end_time", "t0", t_end)).withColumn("_l", clip("low_freq", "f0", f_end)).withColumn("_h", clip("high_freq", "f0", f_end))
    return rows.filter("_l < _h and _b < _e").select(
        "recording",
        "box_id",
        F.floor((F.col("_l") - F.col("f0")) / fspan).alias("freq_start"),
        F.ceil((F.col("_h") - F.col("f0")) / fspan).alias("freq_end"),
        F.floor((F.col("_b") - F.col("t0")) / tspan).alias("t_start"),
        F.ceil((F.col("_e") - F.col("t0")) / tspan).alias("t_end"),
        F.col("usv_type").alias("label"),
    )


def unknown_files(annotations: DataFrame, meta: DataFrame) -> DataFrame:
    """Files that annotations name and that have no spectrogram; an error if it isn't empty."""
    return annotations.select(F.col("begin_file").alias("recording")).distinct().join(meta, "recording", "left_anti")


def si_to_boxes(boxes_si: DataFrame, meta: DataFrame) -> DataFrame:
    """Nearest index on both axes, ties to the lower one. Other columns stay."""
    rows = _meta(boxes_si, meta)
    t = lambda c: nearest_index(F.col(c), F.col("t0"), F.col("dt"), F.col("n_time"))
    f = lambda c: nearest_index(F.col(c), F.col("f0"), F.col("df"), F.col("n_freq"))
    return rows.select(*[c for c in boxes_si.columns if c not in ("time_start", "time_end", "freq_start", "freq_end")], f("freq_start").alias("freq_start"), f("freq_end").alias("freq_end"), t("time_start").alias("t_start"), t("time_end").alias("t_end"))


def boxes_to_si(boxes: DataFrame, meta: DataFrame) -> DataFrame:
    """Axis values of the indices; an empty label becomes null. Other columns stay."""
    rows = _meta(boxes, meta)
    t = lambda c: axis_value(F.col(c), F.col("t0"), F.col("dt"), F.col("n_time"))
    f = lambda c: axis_value(F.col(c), F.col("f0"), F.col("df"), F.col("n_freq"))
    label = F.when(F.col("label") != "", F.col("label")).alias("label")
    return rows.select(*[c for c in boxes.columns if c not in (*COORDS, "label")], t("t_start").alias("time_start"), t("t_end").alias("time_end"), f("freq_start").alias("freq_start"), f("freq_end").alias("freq_end"), label)


def filter_boxes(boxes: DataFrame, meta: DataFrame, min_time_span: float = 0.002, min_freq_span: float = 2000.0) -> DataFrame:
    """Boxes longer than both spans, by axis values."""
    t = axis_value(F.col("t_end"), F.col("t0"), F.col("dt"), F.col("n_time")) - axis_value(F.col("t_start"), F.col("t0"), F.col("dt"), F.col("n_time"))
    f = axis_value(F.col("freq_end"), F.col("f0"), F.col("df"), F.col("n_freq")) - axis_value(F.col("freq_start"), F.col("f0"), F.col("df"), F.col("n_freq"))
    return _meta(boxes, meta).filter((t > min_time_span) & (f > min_freq_span)).select(boxes.columns)


def filter_by_ratio(boxes: DataFrame, cutoff: float) -> DataFrame:
    """Boxes with a width whose height / width is below ``cutoff`` (both as end - start)."""
    width, height = F.col("t_end") - F.col("t_start"), F.col("freq_end") - F.col("freq_start")
    return boxes.filter((width > 0) & (height < cutoff * width))


def filter_detection_size(boxes: DataFrame, meta: DataFrame | None = None, max_bins: int = 100, max_frames: int = 5000, min_mean_freq: float | None = None) -> DataFrame:
    """Boxes lower than ``max_bins`` and shorter than ``max_frames``; with ``min_mean_freq`` (Hz) also high enough."""
    out = boxes.filter((F.col("freq_end") - F.col("freq_start") < max_bins) & (F.col("t_end") - F.col("t_start") < max_frames))
    if min_mean_freq is None:
        return out
    least = freq_to_pixels(F.lit(float(min_mean_freq)))
    return _meta(out, meta).filter((F.col("freq_start") + F.col("freq_end")) / 2 >= least).select(boxes.columns)


def label_components(boxes: DataFrame, delta_time: int, delta_freq: int, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Adds ``component``: equal for boxes of a key that touch, directly or through others, after one of them grows by
    the deltas (pixels).

    A box goes to the blocks of ``block`` frames that it reaches, so boxes that touch share a block. A sweep over a block
    (see ``kernels.sweep_components``) costs its boxes times their height, however many of them touch, and links each box
    to one other at most. Components inside one block are done; of those that reach into the next one, the links go
    through the distributed components: as many as boxes, never pairs.
    """
    boxes = stash(boxes.withColumn("_id", F.monotonically_increasing_id()))
    first = F.floor(F.col("t_start") / block)
    last = F.greatest(first, F.floor((F.col("t_end") + delta_time) / block))
    dealt = boxes.withColumns({"_first": first, "_last": last}).withColumn("_block", F.explode(F.sequence("_first", "_last")))

    def label(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        ts, te, fs, fe, ids = (longs(rows, c) for c in ("t_start", "t_end", "freq_start", "freq_end", "_id"))
        crosses = longs(rows, "_last") > longs(rows, "_first")
        root, open_ = ids.copy(), crosses.copy()
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
            if hi - lo > 1:
                of = kernels.sweep_components(ts[lo:hi], te[lo:hi], fs[lo:hi], fe[lo:hi], delta_time, delta_freq)
                least = np.full(hi - lo, np.iinfo(np.int64).max)
                np.minimum.at(least, of, ids[lo:hi])
                crossed = np.zeros(hi - lo, bool)
                np.logical_or.at(crossed, of, crosses[lo:hi])
                root[lo:hi], open_[lo:hi] = least[of], crossed[of]
        own = longs(rows, "_block") == longs(rows, "_first")
        out = rows.drop_columns(["_first", "_last", "_block"])
        for name, x in (("_own", own), ("_root", root), ("_open", open_)):
            out = out.append_column(name, pa.array(x))
        return out

    extra = [T.StructField("_own", T.BooleanType()), T.StructField("_root", T.LongType()), T.StructField("_open", T.BooleanType())]
    out = stash(map_groups(dealt, [*keys, "_block"], ["t_start"], label, T.StructType([*boxes.schema.fields, *extra])))
    closed = out.filter("_own AND NOT _open").withColumn("component", F.col("_root"))
    links = out.filter("_open").select(F.col("_id").alias("u"), F.col("_root").alias("v"))
    if links.isEmpty():
        return closed.drop("_id", "_own", "_root", "_open")
    roots = connected_components(links).select(F.col("node").alias("_node"), F.col("root").alias("_to"))
    crossing = out.filter("_own AND _open").join(roots, F.col("_id") == F.col("_node"), "left").withColumn("component", F.coalesce("_to", "_id")).drop("_node", "_to")
    return closed.unionByName(crossing).drop("_id", "_own", "_root", "_open")


def merge_boxes(boxes: DataFrame, delta_freq: int, delta_time: int, label: str | None = None, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Boxes that touch after growing one by the deltas (pixels; see ``merge_boxes_si`` for Hz and seconds) become one
    box around them, with the mean of their scores and the given label; ``n_merged`` counts them. One closure over the
    input: merged boxes may still touch each other."""
    parts = label_components(boxes, delta_time, delta_freq, keys, block)
    score = F.avg("score") if "score" in boxes.columns else F.lit(None).cast("double")
    return (
        parts.groupBy(*keys, "component")
        .agg(F.min("box_id").alias("box_id"), F.min("freq_start").alias("freq_start"), F.max("freq_end").alias("freq_end"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), score.alias("score"), F.count(F.lit(1)).alias("n_merged"))
        .withColumn("label", F.lit(label or None).cast("string"))
        .drop("component")
    )


def deltas_in_pixels(meta: DataFrame, delta_freq: float, delta_time: float) -> DataFrame:
    """recording, ``df_px``, ``dt_px``: Hz and seconds as numbers of pixels, rounded up."""
    return meta.select("recording", freq_to_pixels(F.lit(float(delta_freq))).alias("df_px"), time_to_pixels(F.lit(float(delta_time))).alias("dt_px"))


def merge_boxes_si(boxes: DataFrame, meta: DataFrame, delta_freq: float, delta_time: float, label: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """``merge_boxes`` with deltas in Hz and seconds. Recordings on the same grid are merged together."""
    per = deltas_in_pixels(meta, delta_freq, delta_time)
    grids = per.select("df_px", "dt_px").distinct().collect()  # one row for each kind of spectrogram
    out = None
    for g in grids:
        own = boxes.join(per.filter((F.col("df_px") == g["df_px"]) & (F.col("dt_px") == g["dt_px"])).select("recording"), "recording", "left_semi")
        merged = merge_boxes(own, int(g["df_px"]), int(g["dt_px"]), label, keys)
        out = merged if out is None else out.unionByName(merged)
    return out


def _bound(value: float | None, default: Column) -> Column:
    return default if value is None else F.lit(float(value))


def clip_bounds(t_start=None, t_end=None, freq_start=None, freq_end=None) -> dict[str, Column]:
    """Pixel bounds of a clip, from the columns of ``spec_meta``; a missing bound is the end of the axis."""
    te, fe = axis_end(F.col("t0"), F.col("dt"), F.col("n_time")), axis_end(F.col("f0"), F.col("df"), F.col("n_freq"))
    px = lambda v, origin, step, n: to_pixels(v - F.col(origin), pixel_span(F.col(origin), F.col(step), F.col(n)))
    return {
        "t_lo": px(_bound(t_start, F.col("t0")), "t0", "dt", "n_time"),
        "t_hi": px(_bound(t_end, te), "t0", "dt", "n_time"),
        "f_lo": px(_bound(freq_start, F.col("f0")), "f0", "df", "n_freq"),
        "f_hi": px(_bound(freq_end, fe), "f0", "df", "n_freq"),
    }


def clip_boxes(boxes: DataFrame, meta: DataFrame, t_start=None, t_end=None, freq_start=None, freq_end=None) -> DataFrame:
    """Boxes that reach strictly into the clip, cut to it and moved to its origin. Bounds in seconds and Hz."""
    rows = _meta(boxes, meta).withColumns(clip_bounds(t_start, t_end, freq_start, freq_end))
    inside = rows.filter("t_end > t_lo and t_start < t_hi and freq_end > f_lo and freq_start < f_hi")
    cut = lambda c, lo, hi: (F.least(F.greatest(F.col(c), F.col(lo)), F.col(hi)) - F.col(lo)).alias(c)
    other = [c for c in boxes.columns if c not in COORDS]
    return inside.select(*other, cut("freq_start", "f_lo", "f_hi"), cut("freq_end", "f_lo", "f_hi"), cut("t_start", "t_lo", "t_hi"), cut("t_end", "t_lo", "t_hi"))


def classify_by_frequency(boxes: DataFrame, threshold: int | float, low: str, high: str, meta: DataFrame | None = None) -> DataFrame:
    """Label by the mean pixel: above ``threshold`` is ``high``. A float is in Hz (needs ``meta``), an int in pixels."""
    mean = (F.col("freq_start") + F.col("freq_end")) / 2
    if isinstance(threshold, float):
        rows, limit = _meta(boxes, meta), freq_to_pixels(F.lit(threshold))
    else:
        rows, limit = boxes, F.lit(threshold)
    return rows.withColumn("label", F.when(mean > limit, high).otherwise(low)).select(*dict.fromkeys([*boxes.columns, "label"]))


def classification_windows(boxes: DataFrame, meta: DataFrame, max_call_len: int, stride: float, context_time: int = 0, context_freq: int = 0) -> DataFrame:
    """Examples for a classifier: a short box is one, a longer one gives windows of ``max_call_len`` every
    ``int(max_call_len * stride)`` frames; all grow by the context, cut to the spectrogram. Adds ``window`` (from 0)."""
    step = int(max_call_len * stride)
    last = F.col("t_end") - max_call_len
    short = F.col("t_end") - F.col("t_start") <= max_call_len
    starts = F.when(short, F.array("t_start")).otherwise(F.sequence(F.col("t_start"), F.greatest("t_start", last), F.lit(step).cast("long")))
    rows = _meta(boxes, meta).select("*", F.posexplode(starts).alias("window", "_start"), short.alias("_short"))
    end = F.when(F.col("_short"), F.col("t_end")).otherwise(F.col("_start") + max_call_len)
    zero = F.lit(0).cast("long")
    other = [c for c in boxes.columns if c not in COORDS]
    return rows.select(
        *other,
        "window",
        F.greatest(zero, F.col("_start") - context_time).alias("t_start"),
        F.least(F.col("n_time"), end + context_time).alias("t_end"),
        F.greatest(zero, F.col("freq_start") - context_freq).alias("freq_start"),
        F.least(F.col("n_freq"), F.col("freq_end") + context_freq).alias("freq_end"),
    )


def position_features(boxes: DataFrame, max_pos: float) -> DataFrame:
    return boxes.select("*", *_position(max_pos))


def reduce_window_predictions(boxes: DataFrame, predictions: DataFrame, confidence: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """``predictions``: keys, box_id, window, class, score. A box gets the class of its best window with a score of
    ``confidence`` or more (ties: the first window); without one it keeps its label."""
    order = F.struct(F.col("score"), (-F.col("window")).alias("w"))
    best = predictions.filter(F.col("score") >= confidence).groupBy(*keys, "box_id").agg(F.max_by("class", order).alias("_class"))
    return boxes.join(best, [*keys, "box_id"], "left").withColumn("label", F.coalesce("_class", "label")).drop("_class")


def union_detections(**models: DataFrame) -> DataFrame:
    """All boxes, with the name they are given under as ``model``."""
    out = None
    for name, df in models.items():
        own = df.withColumn("model", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out

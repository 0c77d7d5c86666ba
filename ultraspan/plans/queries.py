"""The registered queries of the library's own operators. Doubles are rounded to 6 digits: sums differ in order."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.grid import freq_to_pixels, time_to_pixels
from ..operators import boxes as bx
from ..operators import contour as ct
from ..operators import denoise as dn
from ..operators import detect as de
from ..operators import inference as nf
from ..operators import intervals as iv
from ..operators import metrics as mt
from ..operators import noise as nz
from ..operators import search as se
from ..operators import spectrogram as sp
from ..shared import shared_dir, stash
from ..sources import annotations as sa
from ..sources import audio
from ..sources import detections as sd
from . import tables as tb
from . import workflows as wf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: A bucket about as long as a usual box of these tables.
WIDTH = 64
THRESHOLDS = (0.05, 0.1, 0.2)
MASK = 0.13


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def _values(df: DataFrame, value: str = "value") -> DataFrame:
    """Frames as rounded cells, to compare every value."""
    return df.select("recording", "frame", F.posexplode("mags").alias("bin", value)).withColumn("bin", F.col("bin").cast("long")).withColumn(value, F.round(value, 6))


# metrics


@query
def detection_scores(s, d):
    out = mt.metrics_at_thresholds(tb.pred(s, d), tb.truth(s, d), [0.1], recordings=tb.recordings(s, d), width=WIDTH)
    return _r(out, "precision", "recall", "f_score")


@query
def iou_elementwise(s, d):
    pairs = mt.iou_elementwise(tb.truth(s, d), tb.pred(s, d), width=WIDTH)
    return _r(pairs.select("recording", F.col("a_box_id").alias("target_id"), F.col("b_box_id").alias("cover_id"), "iou"), "iou")


@query
def matches(s, d):
    return _r(mt.matches(tb.truth(s, d), tb.pred(s, d), width=WIDTH).select("recording", "target_id", "cover_id", "iou"), "iou")


def _global(axis):
    return lambda s, d: _r(mt.iou_global(tb.pred(s, d), tb.truth(s, d), axis), "iou")


QUERIES |= {"iou_global_2d": _global(None), "iou_global_time": _global("time"), "iou_global_freq": _global("freq")}


@query
def coverage_2d(s, d):
    return _r(mt.coverage(tb.pred(s, d), tb.truth(s, d)), "a_covered", "b_covered")


@query
def coverage_time(s, d):
    return _r(mt.coverage(tb.pred(s, d), tb.truth(s, d), "time"), "a_covered", "b_covered")


@query
def coverage_freq(s, d):
    return _r(mt.coverage(tb.pred(s, d), tb.truth(s, d), "freq"), "a_covered", "b_covered")


@query
def iou_per_target_max(s, d):
    return _r(mt.iou_per_target(tb.truth(s, d), tb.pred(s, d), "max", width=WIDTH), "value")


@query
def iou_per_target_sum(s, d):
    return _r(mt.iou_per_target(tb.truth(s, d), tb.pred(s, d), "sum", width=WIDTH), "value")


@query
def iou_by_label(s, d):
    per = _r(mt.iou_per_target(tb.truth(s, d), tb.pred(s, d), width=WIDTH), "value")
    return mt.iou_by_label(per).select("recording", "label", F.posexplode("values").alias("place", "value")).withColumn("place", F.col("place").cast("long"))


@query
def count_hits(s, d):
    return mt.count_hits(mt.iou_per_target(tb.truth(s, d), tb.pred(s, d), width=WIDTH), 0.1)


@query
def hits_per_label(s, d):
    return mt.count_hits_per_label(mt.iou_per_target(tb.truth(s, d), tb.pred(s, d), width=WIDTH), 0.1)


@query
def detection_precision(s, d):
    return _r(mt.detection_precision(tb.pred(s, d), tb.truth(s, d), 0.1, width=WIDTH), "precision")


@query
def detection_recall(s, d):
    return _r(mt.detection_recall(tb.pred(s, d), tb.truth(s, d), 0.1, width=WIDTH), "recall")


@query
def recall_per_label(s, d):
    return _r(mt.recall_per_label(tb.pred(s, d), tb.truth(s, d), 0.1, width=WIDTH), "recall")


@query
def metrics_at_thresholds(s, d):
    return _r(mt.metrics_at_thresholds(tb.pred(s, d), tb.truth(s, d), THRESHOLDS, beta=2.0, width=WIDTH), "precision", "recall", "f_score")


@query
def metrics_at_thresholds_sum(s, d):
    return _r(mt.metrics_at_thresholds(tb.pred(s, d), tb.truth(s, d), THRESHOLDS, mode="sum", width=WIDTH), "precision", "recall", "f_score")


@query
def f_beta(s, d):
    rows = tb.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount").cast("double") * 10).alias("p"), (F.col("l_tax").cast("double") * 10).alias("r"))
    return _r(rows.select("l_orderkey", "l_linenumber", geo.f_beta(F.col("p"), F.col("r"), 0.5).alias("f_score")), "f_score")


def _models(s, d) -> DataFrame:
    """Three detectors: all predictions, the high-scoring ones, the low ones."""
    p = tb.pred(s, d)
    return bx.union_detections(every=p, high=p.filter("score > 30"), low=p.filter("freq_end < 32"))


def _model_scores(s, d) -> DataFrame:
    every = tb.recordings(s, d).select("recording", F.explode(F.array(F.lit("every"), F.lit("high"), F.lit("low"))).alias("model"))
    sides = tb.truth(s, d).join(every, "recording")
    return mt.metrics_at_thresholds(_models(s, d), sides, [0.1], keys=wf.MODEL_KEYS, recordings=every, width=WIDTH)


@query
def union_detections(s, d):
    return _models(s, d).groupBy("model", "label").agg(F.count(F.lit(1)).alias("n"), F.min("box_id").alias("first_id"))


@query
def model_summary(s, d):
    long = _model_scores(s, d).select("model", "recording", F.explode(F.create_map(F.lit("precision"), F.col("precision"), F.lit("recall"), F.col("recall"))).alias("metric", "value"))
    return _r(mt.summarise_models(long, tb.recordings(s, d)), "value")


@query
def model_summary_wide(s, d):
    long = _model_scores(s, d).select("model", "recording", F.lit("recall").alias("metric"), F.col("recall").alias("value"))
    return _r(mt.wide(mt.summarise_models(long, tb.recordings(s, d)), ["every", "high", "low"]), "every", "high", "low")


@query
def recall_per_class_macro(s, d):
    r = mt.recall_per_label(tb.pred(s, d), tb.truth(s, d), 0.1, width=WIDTH).select(F.lit("every").alias("model"), "recording", "label", F.lit(0.1).alias("threshold"), "recall")
    return _r(mt.summarise_recall_per_class(r, tb.recordings(s, d)), "value")


@query
def match_labels(s, d):
    return mt.match_labels(tb.pred(s, d), tb.truth(s, d), width=WIDTH)


@query
def confusion_matrix(s, d):
    return mt.confusion_matrix(mt.match_labels(tb.pred(s, d), tb.truth(s, d), width=WIDTH), ["click", "error", "purchase", "signup", "view"])


@query
def accuracy(s, d):
    return _r(mt.accuracy(mt.match_labels(tb.pred(s, d), tb.truth(s, d), width=WIDTH)), "accuracy")


@query
def evaluate_detectors(s, d):
    """The whole evaluation of three detectors: its summary."""
    out = wf.evaluate_detectors(_models(s, d), tb.truth(s, d), tb.recordings(s, d), ["click", "view"], (0.1,), WIDTH)
    return _r(out["summary"], "value")


# boxes


@query
def annotations_to_boxes(s, d):
    return bx.annotations_to_boxes(tb.annotations(s, d), tb.box_meta(s, d))


@query
def unknown_files(s, d):
    return bx.unknown_files(tb.annotations(s, d), tb.box_meta(s, d).filter(F.col("recording").cast("long") % 3 != 0))


@query
def boxes_to_si(s, d):
    b = tb.boxes(s, d).withColumn("label", F.when(F.col("label") == "view", "").otherwise(F.col("label")))
    return _r(bx.boxes_to_si(b.drop("score", "side"), tb.box_meta(s, d)), "time_start", "time_end", "freq_start", "freq_end")


@query
def nearest_index_boxes(s, d):
    a = tb.annotations(s, d).select(F.col("begin_file").alias("recording"), "box_id", F.col("begin_time").alias("time_start"), F.col("end_time").alias("time_end"), F.col("low_freq").alias("freq_start"), F.col("high_freq").alias("freq_end"))
    return bx.si_to_boxes(a, tb.box_meta(s, d))


@query
def filter_boxes(s, d):
    return bx.filter_boxes(tb.boxes(s, d), tb.box_meta(s, d), 1800.0, 4000.0).select("recording", "box_id")


@query
def filter_by_ratio(s, d):
    return bx.filter_by_ratio(tb.boxes(s, d), 0.2).select("recording", "box_id")


@query
def filter_detection_size(s, d):
    return bx.filter_detection_size(tb.boxes(s, d), tb.box_meta(s, d), 8, 120, 18_000.0).select("recording", "box_id")


@query
def distinct_boxes(s, d):
    b = tb.boxes(s, d)
    return mt.distinct_boxes(b.unionByName(b))


@query
def box_distances(s, d):
    near = iv.overlap_join(tb.truth(s, d), tb.pred(s, d), width=WIDTH, delta_time=10, delta_freq=5)
    t, f = geo.box_distances("a_", "b_")
    return near.select("recording", "a_box_id", "b_box_id", t.cast("long").alias("time_px"), f.cast("long").alias("freq_px"))


@query
def merge_boxes(s, d):
    return _r(bx.merge_boxes(tb.pred(s, d), 1, 2).drop("label"), "score")


@query
def merge_boxes_si(s, d):
    return _r(bx.merge_boxes_si(tb.truth(s, d), tb.box_meta(s, d), 900.0, 100.0, "call"), "score")


@query
def clip_boxes(s, d):
    return bx.clip_boxes(tb.boxes(s, d), tb.box_meta(s, d), t_start=18_000.0, t_end=54_000.0, freq_start=10_000.0).drop("score")


@query
def train_test_split(s, d):
    return sp.train_test_split_by_time(tb.boxes(s, d).drop("score"), tb.box_meta(s, d), 36_000.0)


@query
def classify_by_frequency(s, d):
    return bx.classify_by_frequency(tb.boxes(s, d), 30_000.0, "22-khz", "50-khz", tb.box_meta(s, d)).select("recording", "box_id", "label")


@query
def classification_windows(s, d):
    return bx.classification_windows(tb.boxes(s, d).drop("score", "side", "label"), tb.box_meta(s, d), 40, 0.5, 5, 3).withColumn("window", F.col("window").cast("long"))


@query
def position_features(s, d):
    return _r(bx.position_features(tb.boxes(s, d).select("recording", "box_id", "freq_start", "freq_end"), 60.0), "start_cos", "start_sin", "end_cos", "end_sin").drop("freq_start", "freq_end")


@query
def reduce_window_predictions(s, d):
    b = tb.boxes(s, d)
    preds = bx.classification_windows(b, tb.box_meta(s, d), 40, 0.5).select("recording", "box_id", "window", F.concat(F.lit("c"), (F.col("box_id") + F.col("window")) % 4).alias("class"), ((F.col("box_id") * 13 + F.col("window") * 7) % 10 / 10.0).alias("score"))
    return bx.reduce_window_predictions(b, preds, 0.6).select("recording", "box_id", "label")


@query
def clean_labels(s, d):
    a = tb.annotations(s, d).withColumn("usv_type", sa.clean_label(F.when(F.col("usv_type") == "view", "Junk").when(F.col("usv_type") == "click", "22-KHz call").when(F.col("usv_type") != "error", F.col("usv_type"))))
    return sa.clean_labels(a).groupBy("begin_file", "usv_type").agg(F.count(F.lit(1)).alias("n"))


@query
def align_annotation_times(s, d):
    rec = tb.recordings(s, d).select("folder", "name", "duration")
    return _r(sa.align_annotation_times(tb.annotations(s, d), rec).select("folder", "begin_file", "box_id", "begin_time", "end_time", "in_order"), "begin_time", "end_time")


@query
def get_signal(s, d):
    return audio.get_signal(tb.recordings(s, d), "7").select("recording", "name", "folder", "n_samples")


@query
def read_annotations(s, d):
    """Annotations written as tab-separated files, a folder for each box, and read back."""
    names = {k: v for v, (k, _) in sa.COLUMNS.items()}
    a = tb.annotations(s, d).withColumnRenamed("box_id", "selection")
    path = f"{shared_dir(s)}/annotations-{uuid.uuid4().hex}"
    a.select("folder", *[F.col(c).alias(names[c]) for c in a.columns if c != "folder"]).write.partitionBy("folder").csv(path, sep="\t", header=True)
    return sa.read_annotations(s, path).select("folder", "selection", "begin_file", "begin_time", "end_time", "low_freq", "high_freq", "usv_type")


@query
def read_recordings(s, d):
    """Signals written as WAV files, a folder for each box, and read back by ranges of 100 bytes: every sample, beside
    what the headers say."""
    path = f"{shared_dir(s)}/recordings-{uuid.uuid4().hex}"
    whole = F.transform("samples", lambda x: (F.least(F.floor(x), F.lit(127)) / 128).cast("double"))
    own = tb.signal_chunks(s, d, 1 << 30).join(tb.recordings(s, d).select("recording", "folder", "name", "sample_rate"), "recording").withColumn("samples", whole)
    audio.write_recordings(own, path).write.format("noop").mode("overwrite").save()
    recordings, chunks = audio.read_recordings(s, path, chunk=16, range_bytes=100)
    samples = chunks.select("recording", "chunk_id", F.posexplode("samples").alias("place", "value"), "sample_start")
    return recordings.select("recording", "name", "sample_rate", "n_samples", "duration").join(samples, "recording").select("recording", "name", "sample_rate", "n_samples", "duration", "chunk_id", (F.col("sample_start") + F.col("place")).alias("sample"), F.col("value").cast("double").alias("value"))


@query
def read_noise_spans(s, d):
    """Spans of every prediction written as JSON, a folder for each recording, and read back."""
    path = f"{shared_dir(s)}/spans-{uuid.uuid4().hex}"
    sd.write_noise_spans(_config_spans(s, d), path)
    return sd.read_noise_spans(s, path)


@query
def read_detections(s, d):
    """Predictions written in seconds and Hz by recording and configuration, twice over, and read back."""
    path = f"{shared_dir(s)}/detections-{uuid.uuid4().hex}"
    own = tb.pred(s, d).withColumn("config_id", F.lit("c"))
    for _ in range(2):
        sd.write_detections(own, tb.box_meta(s, d), path)
    return _r(sd.read_detections(s, path), "time_start", "time_end", "freq_start", "freq_end")


@query
def write_metrics(s, d):
    """Trials of even and of odd configurations as two runs in one folder of files, the second written twice."""
    path = f"{shared_dir(s)}/metrics-{uuid.uuid4().hex}"
    for odd in (0, 1, 1):
        sd.write_metrics(_r(_trials(s, d).filter(F.col("config_id").cast("int") % 2 == odd), "score"), path, f"odd {odd}")
    return sd.read_metrics(s, path, "recording string, config_id string, score double, n_boxes long").drop("run")


@query
def pending_configs(s, d):
    every = tb.recordings(s, d).select("recording", F.explode(F.array(*[F.lit(str(i)) for i in range(4)])).alias("config_id"))
    done = tb.boxes(s, d).filter("freq_end > 60").select("recording", (F.col("box_id") % 4).cast("string").alias("config_id"))
    return sd.pending_configs(every, done)


# noise spans


@query
def noise_spans(s, d):
    return nz.find_noise_spans(tb.truth(s, d), tb.box_meta(s, d), 1200.0)


def _config_spans(s, d) -> DataFrame:
    return tb.pred(s, d).select("recording", F.col("box_id").cast("string").alias("config_id"), (F.col("t_start") * 60.0).alias("start"), (F.col("t_end") * 60.0).alias("end"))


@query
def noise_spans_with_calls(s, d):
    return nz.spans_with_calls(_config_spans(s, d), tb.truth(s, d), tb.box_meta(s, d)).select("recording", "config_id")


@query
def noise_spans_without_calls(s, d):
    return nz.spans_without_calls(_config_spans(s, d), tb.truth(s, d), tb.box_meta(s, d)).select("recording", "config_id")


def _frame_spans(s, d) -> DataFrame:
    """Gaps of the frames between loud ones, as noise spans."""
    loud = tb.frames(s, d).filter(F.array_max("mags") > 0.36).select("recording", F.col("frame").alias("t_start"), F.col("frame").alias("t_end"))
    return nz.find_noise_spans(loud, tb.frame_meta(s, d), 2 * tb.DT)


@query
def noise_span_weights(s, d):
    return _r(nz.weigh_noise_spans(_frame_spans(s, d), tb.frames(s, d)), "weight")


@query
def choose_noise_span(s, d):
    return nz.choose_noise_span(nz.weigh_noise_spans(_frame_spans(s, d), tb.frames(s, d)), tb.frame_meta(s, d), 3 * tb.DT, 1)


# spectrograms


@query
def spectral_entropy(s, d):
    return _r(de.spectral_entropy(tb.frames(s, d)), "entropy")


@query
def entropy_moving_average(s, d):
    return _r(de.moving_average(de.spectral_entropy(tb.frames(s, d)), "entropy", 5, ["recording"], "frame"), "entropy")


@query
def low_entropy_ranges(s, d):
    return de.low_entropy_ranges(tb.frames(s, d), 3, 0.64)


@query
def high_energy_rows(s, d):
    return de.high_energy_rows(tb.frames(s, d), de.low_entropy_ranges(tb.frames(s, d), 3, 0.64), 3, 1.3).select("recording", "t_start", "t_end", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query
def detect_entropy_energy(s, d):
    return de.detect_entropy_energy(tb.frames(s, d), tb.frame_meta(s, d), 9000.0, 3, 0.64, 3, 1.3, filter=True, filter_ratio=4.0).drop("box_id", "label")


@query
def noise_profile(s, d):
    return _r(dn.noise_profile(tb.frames(s, d).filter("frame < 20"), 1.5, top_db=40.0).withColumn("bin", F.col("bin").cast("long")), "threshold")


@query
def noise_gate(s, d):
    return _values(dn.noise_gate(tb.frames(s, d), tb.frames(s, d).filter("frame < 20"), 2, 1, 0.5, 0.8, top_db=60.0))


@query
def amplitude_to_db(s, d):
    return _values(sp.amplitude_to_db(tb.frames(s, d), 0.5, 1e-4, 40.0))


@query
def db_to_amplitude(s, d):
    return _values(sp.db_to_amplitude(tb.frames(s, d), 2.0))


@query
def display_range(s, d):
    return _r(sp.display_range(tb.frames(s, d)), "low", "high")


@query
def clip_spectrogram(s, d):
    cut, meta = sp.clip_spectrogram(tb.frames(s, d), tb.frame_meta(s, d), t_start=0.01, t_end=0.03, freq_start=5000.0, freq_end=40_000.0)
    return _values(cut)


@query
def clipped_meta(s, d):
    _, meta = sp.clip_spectrogram(tb.frames(s, d), tb.frame_meta(s, d), t_start=0.01, t_end=0.03, freq_start=5000.0)
    return _r(sp.spec_geometry(meta).select("recording", "height", "width", "t_first", "t_last", "f_first", "f_last", "t_pixel", "f_pixel"), "t_first", "t_last", "t_pixel", "f_pixel")


@query
def spec_and_boxes_clip(s, d):
    b = tb.frames(s, d).select("recording", F.col("frame").alias("box_id"), (F.col("frame") % 40).alias("freq_start"), (F.col("frame") % 40 + 6).alias("freq_end"), F.col("frame").alias("t_start"), (F.col("frame") + 4).alias("t_end"))
    _, _, out = sp.clip_spec_and_boxes(tb.frames(s, d), tb.frame_meta(s, d), b, t_start=0.01, t_end=0.03, freq_start=5000.0)
    return out


@query
def pixels(s, d):
    m = tb.frame_meta(s, d)
    return m.select("recording", time_to_pixels(F.lit(0.0205)).alias("t_px"), freq_to_pixels(F.lit(18_000.0)).alias("f_px"))


@query
def preprocess_spectrogram(s, d):
    return _values(sp.preprocess_spectrogram(tb.frames(s, d), tb.frame_meta(s, d), 10.0, 18_000.0, 2.0))


@query
def sliding_chunks(s, d):
    c = sp.sliding_chunks(tb.frames(s, d), tb.frame_meta(s, d), 12, 0.25)
    return _r(c.select("recording", "chunk_id", "first", "frame", F.posexplode("mags").alias("bin", "value")).withColumn("bin", F.col("bin").cast("long")), "value")


def _crops(s, d) -> DataFrame:
    return tb.frames(s, d).select("recording", F.col("frame").alias("box_id"), (F.col("frame") % 50).alias("freq_start"), (F.col("frame") % 50 + 8).alias("freq_end"), F.col("frame").alias("t_start"), (F.col("frame") + 5).alias("t_end"))


@query
def standardize_pad(s, d):
    crops = sp.standardize_pad(tb.frames(s, d), _crops(s, d), 4)
    rows = crops.select("recording", "box_id", "height", "width", F.posexplode("crop").alias("row", "values"))
    cells = rows.select("recording", "box_id", "height", "width", "row", F.posexplode("values").alias("column", "value"))
    return _r(cells.withColumns({c: F.col(c).cast("long") for c in ("height", "width", "row", "column")}), "value")


@query
def standardize_in_batches(s, d):
    """Crops of very different lengths, each padded to the largest of its batch of like sizes."""
    own = _crops(s, d).withColumn("t_end", F.col("t_start") + 1 + F.col("box_id") % 3 + F.when(F.col("box_id") % 29 == 0, 40).otherwise(0))
    crops = sp.standardize_pad(tb.frames(s, d), sp.size_batches(own, 1 << 30), 1, ("batch",))
    rows = crops.select("recording", "box_id", "batch", "height", "width", F.posexplode("crop").alias("row", "values"))
    cells = rows.select("recording", "box_id", "batch", "height", "width", "row", F.posexplode("values").alias("column", "value"))
    return _r(cells.withColumns({c: F.col(c).cast("long") for c in ("height", "width", "row", "column")}), "value")


@query
def stft(s, d):
    return _values(sp.spectrogram(tb.signal_chunks(s, d), 16, None, 8, 1.0))


@query
def stft_short_window(s, d):
    # power 2, scaled: squares of values with two decimals sit on rounding ties
    return _values(sp.scaled(sp.spectrogram(tb.signal_chunks(s, d), 16, 8, 4, 2.0), F.lit(1 / 7)))


@query
def signal_slice(s, d):
    frames, _ = sp.signal_slice_spectrogram(tb.signal_chunks(s, d), tb.recordings(s, d), 0.25, 0.75, 16, None, 8, 1.0)
    return _values(frames)


@query
def gaussian_filter(s, d):
    return _values(dn.gaussian_filter(tb.frames(s, d), 1.0, 2.0, 3))


@query
def diagonal_filter(s, d):
    return _values(dn.diagonal_gaussian_filter(tb.frames(s, d), 1.0, 2.0, 3))


@query
def transient_suppression(s, d):
    return _values(dn.transient_suppression(tb.frames(s, d), 0.4, 3))


@query
def bilateral_filter(s, d):
    return _values(dn.bilateral_filter(tb.frames(s, d), 3, 0.1, 2.0))


# contours


def _mask(s, d) -> DataFrame:
    return tb.frames(s, d).withColumn("mags", F.transform("mags", lambda x: (x > MASK).cast("double")))


@query
def find_bounding_boxes(s, d):
    return ct.find_bounding_boxes(_mask(s, d), 2).drop("box_id", "label")


@query
def ones_level_set(s, d):
    return _values(ct.ones_level_set(tb.frames(s, d), tb.frame_meta(s, d)))


@query
def eroded_level_set(s, d):
    return _values(ct.eroded_level_set(tb.frames(s, d), tb.frame_meta(s, d), MASK))


@query
def inverse_gaussian_gradient(s, d):
    return _values(ct.inverse_gaussian_gradient(tb.frames(s, d), 1.0, 100.0))


@query
def detect_gac(s, d):
    return ct.detect_gac(tb.frames(s, d), tb.frame_meta(s, d), 2, False, 5, 0, 0.3, -1, "ones", None, 1.0).drop("box_id", "label")


def _edges(s, d) -> DataFrame:
    return stash(ct.inverse_gaussian_gradient(tb.frames(s, d), 1.0, 100.0))


@query
def contour_ones(s, d):
    """Every pixel of the shrinking contour that ``detect_gac`` puts its boxes around."""
    edges = _edges(s, d)
    return _values(ct.evolve(edges, ct.ones_level_set(edges, tb.frame_meta(s, d)), 5, 0, 0.3, -1, block=16))


@query
def contour_eroded(s, d):
    """Every pixel of a contour that grows from an eroded level set, on tiles of 16 frames."""
    edges = _edges(s, d)
    return _values(ct.evolve(edges, ct.eroded_level_set(edges, tb.frame_meta(s, d), 0.45, block=16), 3, 0, 0.3, 1, block=16))


# models and searches


def _chunk_predictions(s, d) -> DataFrame:
    b = tb.boxes(s, d)
    return b.select("recording", (F.col("t_start") / 100).cast("long").alias("chunk_id"), (F.col("t_start") % 100 + 0.7).alias("t_start"), (F.col("freq_start") + 0.9).alias("freq_start"), (F.col("t_start") % 100 + F.col("score") + 0.2).alias("t_end"), (F.col("freq_end") + 0.1).alias("freq_end"), (F.col("box_id") % 4).cast("int").alias("label_id"), (F.col("box_id") % 10 / 10.0).alias("score"))


@query
def combine_chunk_predictions(s, d):
    return nf.combine_chunk_predictions(_chunk_predictions(s, d), 100, 0.3).drop("box_id")


@query
def merge_predictions_per_label(s, d):
    own = nf.combine_chunk_predictions(_chunk_predictions(s, d), 100, 0.3)
    return _r(nf.merge_predictions_per_label(own, tb.box_meta(s, d), {1: "sh", 2: "fm"}, 18, 60.0).drop("box_id"), "score")


@query
def score_batches(s, d):
    """A stand-in model: the mean energy of a chunk's frames."""

    def load():
        def predict(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf[["recording", "chunk_id", "frame"]].assign(score=[float(np.mean(np.square(m))) for m in pdf["mags"]])

        return predict

    chunks = sp.sliding_chunks(tb.frames(s, d), tb.frame_meta(s, d), 12, 0.25)
    return _r(nf.score_batches(chunks, load, "recording string, chunk_id long, frame long, score double"), "score")


@query
def latent_to_params(s, d):
    rows = tb.table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 19 / 10.0 + 0.1).alias("latent"))
    balloon, threshold = geo.latent_to_params(F.col("latent"))
    return _r(rows.select("p_partkey", balloon.cast("long").alias("balloon"), threshold.alias("threshold")), "threshold")


@query
def config_params(s, d):
    return _r(se.with_params(tb.configs(s, d)), "flood_threshold", "balloon_latent", "threshold").withColumns({c: F.col(c).cast("long") for c in ("num_iter", "smoothing", "balloon")})


def _trials(s, d) -> DataFrame:
    """A score for each pair of configuration and recording, by arithmetic."""
    every = tb.recordings(s, d).select("recording", "n_samples", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("n"))
    return every.select("recording", F.col("n").cast("string").alias("config_id"), ((F.col("n_samples") * 7 + F.col("n") * 13) % 17 / 17.0).alias("score"), F.col("n_samples").alias("n_boxes"))


@query
def best_config(s, d):
    return _r(se.best_config(_trials(s, d), tb.configs(s, d)).select("recording", "config_id", "score", "sigma"), "score")


@query
def trial_log(s, d):
    return se.trial_log(_trials(s, d), tb.configs(s, d), 1)


@query
def sample_configs(s, d):
    """As many draws as there are parts."""
    return _r(se.sample_configs(s, tb.table(s, d, "part").count(), 3), *se.SPACE)


@query
def run_trials(s, d):
    """Every configuration on every recording, scored against boxes around the loud cells."""
    truth = ct.find_bounding_boxes(_mask(s, d), 2)
    return _r(se.run_trials(tb.frames(s, d), tb.frame_meta(s, d), truth, tb.configs(s, d), hit_threshold=0.05, alpha=100.0), "score")


@query
def detect_and_label(s, d):
    """From signals to labelled boxes in seconds and Hz."""
    out = wf.detect_and_label(tb.signal_chunks(s, d), tb.recordings(s, d), n_fft=16, hop=4, label_threshold=4.0, freq_cutoff=0.5, entropy_window=3, entropy_threshold=0.7, energy_window=2, energy_threshold=1.2)
    return _r(out.drop("box_id"), "time_start", "time_end", "freq_start", "freq_end")


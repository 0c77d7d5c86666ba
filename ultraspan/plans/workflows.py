"""The three usual jobs: evaluate detectors, detect and label calls, tune settings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boxes as bx
from ..operators import metrics as mt
from ..operators.contour import detect_gac
from ..operators.denoise import noise_gate
from ..operators.detect import detect_entropy_energy
from ..operators.noise import choose_noise_span, find_noise_spans, noise_frames, weigh_noise_spans
from ..operators.search import best_config, run_trials
from ..operators.spectrogram import clip_spec_and_boxes, spec_meta, spectrogram
from ..shared import stash

MODEL_KEYS = ("model", "recording")


def evaluate_detectors(detections: DataFrame, truth: DataFrame, recordings: DataFrame, labels: Sequence[str], thresholds: Sequence[float] = (0.1, 0.5, 0.8), width: int = 256) -> dict[str, DataFrame]:
    """``detections``: boxes with ``model``. Per-recording scores, macro means, recall per class, confusion counts and
    accuracy of every model."""
    models = stash(detections.select("model").distinct())
    every = recordings.select("recording").distinct().join(F.broadcast(models))  # recordings x the few models compared
    sides = truth.join(every, "recording")
    scores = stash(mt.metrics_at_thresholds(detections, sides, thresholds, "max", 1.0, MODEL_KEYS, every, width))
    area = mt.iou_global(detections, sides, None, MODEL_KEYS, every)
    long = scores.select(*MODEL_KEYS, F.explode(F.create_map(*[x for m in ("precision", "recall", "f_score") for x in (F.concat_ws("@", F.lit(m), F.col("threshold")), F.col(m))])).alias("metric", "value"))
    long = long.unionByName(area.select(*MODEL_KEYS, F.lit("iou").alias("metric"), F.col("iou").alias("value")))
    hits = mt.iou_per_target(sides, detections, "max", MODEL_KEYS, width).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    per_class = hits.groupBy(*MODEL_KEYS, "label", "threshold").agg((F.count_if(mt.is_hit(F.col("threshold"))) / F.count(F.lit(1))).alias("recall"))
    pairs = stash(mt.match_labels(detections, sides, MODEL_KEYS, width))
    return {
        "scores": scores,
        "summary": mt.summarise_models(long, recordings),
        "recall_per_class": mt.summarise_recall_per_class(per_class, recordings),
        "confusion": mt.confusion_matrix(pairs, labels, ("model",)),
        "accuracy": mt.accuracy(pairs, ("model",)),
    }


def denoise(frames: DataFrame, meta: DataFrame, boxes: DataFrame, noise_len: float = 1.0, n_grad_freq: int = 3, n_grad_time: int = 3, n_std_thresh: float = 1.0, noise_decrease: float = 0.5, seed: int = 0) -> DataFrame:
    """Noise gate with a profile from a span of each recording that no box touches."""
    weights = weigh_noise_spans(find_noise_spans(boxes, meta, noise_len), frames)
    own = choose_noise_span(weights, meta, noise_len, seed)
    return noise_gate(frames, noise_frames(frames, own), n_grad_freq, n_grad_time, n_std_thresh, noise_decrease)


def detect_and_label(chunks: DataFrame, recordings: DataFrame, detector: str = "entropy", n_fft: int = 512, hop: int = 256, power: float = 1.0, label_threshold: float = 50_000.0, low: str = "22-khz", high: str = "50-khz", **options) -> DataFrame:
    """Boxes in seconds and Hz, labelled by frequency, from signal chunks."""
    meta = spec_meta(recordings, n_fft, hop)
    frames = stash(spectrogram(chunks, n_fft, None, hop, power))
    found = detect_gac(frames, meta, **options) if detector == "contour" else detect_entropy_energy(frames, meta, **options)
    return bx.boxes_to_si(bx.classify_by_frequency(found.drop("label"), label_threshold, low, high, meta), meta)


def tune(frames: DataFrame, meta: DataFrame, truth: DataFrame, configs: DataFrame, train_time: float = 10.0, apply: Callable[[DataFrame, DataFrame], DataFrame] | None = None, **options) -> dict[str, DataFrame]:
    """Trials on the first ``train_time`` seconds, and the best configuration of each recording."""
    part, part_meta, part_truth = clip_spec_and_boxes(frames, meta, truth, t_end=train_time)
    part = stash(apply(part, part_meta) if apply else part)
    trials = stash(run_trials(part, part_meta, part_truth, configs, **options))
    return {"trials": trials, "best": best_config(trials, configs)}

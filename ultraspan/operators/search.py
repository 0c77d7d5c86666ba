"""Sweeps over detector settings. Configurations are a small table; tiles of spectrograms are the work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import latent_to_params
from ..functions.grid import unit_hash
from ..shared import stash
from .contour import detect_gac_settings
from .metrics import iou_global, metrics_at_thresholds

#: The searched ranges.
SPACE = {"num_iter": (1.0, 40.0), "smoothing": (0.0, 7.99), "flood_threshold": (0.1, 0.99), "balloon_latent": (0.2, 1.8), "sigma": (1.0, 10.0)}


def sample_configs(spark: SparkSession, n: int, seed: int = 0, space: dict[str, tuple[float, float]] = SPACE) -> DataFrame:
    """config_id and a uniform draw for each parameter; the same for the same seed, whatever the partitioning."""
    u = lambda name: unit_hash(F.lit(seed), F.lit(name), F.col("id"))
    return spark.range(n).select(F.col("id").cast("string").alias("config_id"), *[(F.lit(lo) + u(name) * F.lit(hi - lo)).alias(name) for name, (lo, hi) in space.items()])


def with_params(configs: DataFrame) -> DataFrame:
    """Adds ``balloon`` and ``threshold`` from the latent value; ``num_iter`` and ``smoothing`` lose their fractions."""
    balloon, threshold = latent_to_params(F.col("balloon_latent"))
    return configs.withColumns({"num_iter": F.col("num_iter").cast("int"), "smoothing": F.col("smoothing").cast("int"), "balloon": balloon, "threshold": threshold})


def run_trials(frames: DataFrame, meta: DataFrame, truth: DataFrame, configs: DataFrame, metric: str = "f_beta", hit_threshold: float = 0.25, beta: float = 1.0, alpha: float = 200.0, min_side_length: int = 1, counted=None) -> DataFrame:
    """config_id, recording, score, n_boxes: detection with each configuration, scored by F-beta (sum mode) or the
    global IoU; 0 without boxes.

    Configurations with equal settings are one trial, and its score goes to all of them. The settings are a column of one
    plan; the driver sees the distinct settings, never data. ``counted``: an accumulator for evolution steps.
    """
    names = ("num_iter", "smoothing", "threshold", "balloon", "flood_threshold", "sigma")
    own = with_params(configs).select("config_id", *[F.col(c).cast("double").alias(c) for c in names])
    own = stash(own.withColumn("setting", F.xxhash64(*names)))
    settings = [r.asDict() for r in own.select("setting", *names).distinct().collect()]  # the sweep itself
    keys = ("setting", "recording")
    found = stash(detect_gac_settings(frames, meta, settings, min_side_length, True, alpha, counted))
    every = meta.select("recording").withColumn("setting", F.explode(F.array(*[F.lit(x["setting"]) for x in settings]).cast("array<bigint>")))
    sides = truth.join(every, "recording")
    if metric == "f_beta":
        scores = metrics_at_thresholds(found, sides, [hit_threshold], "sum", beta, keys, every).select(*keys, F.col("f_score").alias("score"))
    else:
        scores = iou_global(found, sides, None, keys, every).select(*keys, F.col("iou").alias("score"))
    n = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_boxes"))
    trials = stash(scores.join(n, list(keys), "left").select(*keys, "score", F.coalesce("n_boxes", F.lit(0)).cast("long").alias("n_boxes")))
    return own.select("config_id", "setting").join(trials, "setting").select("config_id", "recording", "score", "n_boxes")


def best_config(trials: DataFrame, configs: DataFrame, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """The configuration with the highest score for each key (ties: the smallest id), with its parameters."""
    best = trials.groupBy(*keys).agg(F.min_by(F.struct("config_id", "score"), F.struct((-F.col("score")).alias("s"), "config_id")).alias("b"))
    return best.select(*keys, "b.config_id", "b.score").join(configs, "config_id")


def trial_log(trials: DataFrame, configs: DataFrame, digits: int = 3) -> DataFrame:
    """A flat row for each trial, parameters rounded; to be appended with ``write_metrics``."""
    rounded: list[Column] = [F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in configs.dtypes]
    return trials.join(configs.select(*rounded), "config_id").withColumn("score", F.round("score", digits))

"""Scores of detections against annotations.

A *target* is matched by the *covers* that share a pixel with it. Equal boxes collapse before anything is counted.
Recordings without boxes on a side are kept (scores 0), from ``recordings`` where given, else from both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import area, box_iou, f_beta
from ..schemas import COORDS, KEYS
from .intervals import box_levels, covered, overlap_join, side_areas


def distinct_boxes(boxes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for equal coordinates and label (null is a label); the smallest id stays."""
    return boxes.groupBy(*keys, *COORDS, "label").agg(F.min("box_id").alias("box_id"))


def _all_keys(recordings: DataFrame | None, keys: Sequence[str], *sides: DataFrame) -> DataFrame:
    if recordings is not None:
        return recordings.select(*keys).distinct()
    out = sides[0].select(*keys)
    for s in sides[1:]:
        out = out.unionByName(s.select(*keys))
    return out.distinct()


def iou_elementwise(target: DataFrame, cover: DataFrame, keys: Sequence[str] = KEYS, width: int = 256) -> DataFrame:
    """All pairs that share a pixel: keys, ``a_*`` (target), ``b_*`` (cover), ``iou``."""
    levels = (box_levels(target, width), box_levels(cover, width))  # before equal boxes are looked for
    return overlap_join(distinct_boxes(target, keys), distinct_boxes(cover, keys), keys, width, levels=levels).withColumn("iou", box_iou("a_", "b_"))


def matches(target: DataFrame, cover: DataFrame, keys: Sequence[str] = KEYS, width: int = 256) -> DataFrame:
    """As ``iou_elementwise``, one row with null cover and IoU for a target that nothing matches."""
    pairs = iou_elementwise(target, cover, keys, width).select(*keys, F.col("a_box_id").alias("target_id"), F.col("a_label").alias("target_label"), F.col("b_box_id").alias("cover_id"), F.col("b_label").alias("cover_label"), "iou")
    alone = distinct_boxes(target, keys).select(*keys, F.col("box_id").alias("target_id"), F.col("label").alias("target_label"))
    return alone.join(pairs.drop("target_label"), [*keys, "target_id"], "left")


def _areas(pred: DataFrame, truth: DataFrame, keys: Sequence[str], axis) -> DataFrame:
    """keys, p, t, both: covered by predictions, by truth, by either."""
    if axis is None:
        side = lambda df, n: df.select(*keys, *COORDS, F.lit(n).alias("side"))
        return side_areas(side(pred, 1).unionByName(side(truth, 2)), keys).select(*keys, F.col("one").alias("p"), F.col("two").alias("t"), F.col("either").alias("both"))
    sets = lambda df, name: df.select(*keys, *COORDS, F.explode(F.array(F.lit(name), F.lit("both"))).alias("_set"))
    sums = covered(sets(pred, "p").unionByName(sets(truth, "t")), [*keys, "_set"], axis)
    pick = lambda name: F.coalesce(F.max(F.when(F.col("_set") == name, F.col("covered"))), F.lit(0)).alias(name)
    return sums.groupBy(*keys).agg(pick("p"), pick("t"), pick("both"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))


def iou_global(pred: DataFrame, truth: DataFrame, axis=None, keys: Sequence[str] = KEYS, recordings: DataFrame | None = None) -> DataFrame:
    """keys, ``iou`` of the unions of both sides; ``axis``: None, 0 / "time", 1 / "freq". No boxes: 0."""
    a = _areas(pred, truth, keys, axis)
    return _all_keys(recordings, keys, pred, truth).join(a, list(keys), "left").select(*keys, F.coalesce(_ratio(F.col("p") + F.col("t") - F.col("both"), F.col("both")), F.lit(0.0)).alias("iou"))


def coverage(a: DataFrame, b: DataFrame, axis=None, keys: Sequence[str] = KEYS, recordings: DataFrame | None = None) -> DataFrame:
    """keys, ``a_covered`` (share of a under b), ``b_covered``. An empty side gives 0."""
    s = _areas(a, b, keys, axis)
    shared = F.col("p") + F.col("t") - F.col("both")
    return _all_keys(recordings, keys, a, b).join(s, list(keys), "left").select(*keys, F.coalesce(_ratio(shared, F.col("p")), F.lit(0.0)).alias("a_covered"), F.coalesce(_ratio(shared, F.col("t")), F.lit(0.0)).alias("b_covered"))


def iou_per_target(target: DataFrame, cover: DataFrame, mode: str = "max", keys: Sequence[str] = KEYS, width: int = 256) -> DataFrame:
    """keys, box_id, label, ``n_matches``, ``value``: best IoU (``max``), or IoU with the union of all covers that match,
    whole covers counted (``sum``). Targets without a match have 0."""
    own = distinct_boxes(target, keys)
    pairs = iou_elementwise(target, cover, keys, width)
    if mode == "max":
        none = own.select(*keys, "box_id", "label", F.lit(0).alias("n"), F.lit(0.0).alias("iou"))
        found = pairs.select(*keys, F.col("a_box_id").alias("box_id"), F.col("a_label").alias("label"), F.lit(1).alias("n"), "iou")
        return none.unionByName(found).groupBy(*keys, "box_id", "label").agg(F.sum("n").alias("n_matches"), F.max("iou").alias("value"))
    if mode != "sum":
        raise ValueError("mode: max or sum")
    ids = [*keys, "box_id"]
    # a target and its covers are a group: one is the target's area, two the covers', either that of both
    box = lambda prefix, side: F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in COORDS], F.lit(side).alias("side"))
    boxes = pairs.select(*keys, F.col("a_box_id").alias("box_id"), F.explode(F.array(box("a_", 1), box("b_", 2))).alias("_b")).select(*ids, "_b.*")
    n = pairs.groupBy(*keys, F.col("a_box_id").alias("box_id")).agg(F.count(F.lit(1)).alias("n_matches"))
    per = side_areas(boxes, ids)
    value = _ratio(F.col("one") + F.col("two") - F.col("either"), F.col("either"))
    return own.join(per, ids, "left").join(n, ids, "left").select(*ids, "label", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce(value, F.lit(0.0)).alias("value"))


def iou_by_label(per_target: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, label, ``values``: the sorted values of the label's targets."""
    return per_target.groupBy(*keys, "label").agg(F.sort_array(F.collect_list("value")).alias("values"))


def is_hit(threshold: float | Column) -> Column:
    return (F.col("n_matches") > 0) & (F.col("value") >= threshold)


def count_hits(per_target: DataFrame, threshold: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    return per_target.groupBy(*keys).agg(F.count_if(is_hit(threshold)).alias("hits"), F.count(F.lit(1)).alias("total"))


def count_hits_per_label(per_target: DataFrame, threshold: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Null labels are a group; labels without a hit are kept."""
    return per_target.groupBy(*keys, "label").agg(F.count_if(is_hit(threshold)).alias("hits"), F.count(F.lit(1)).alias("total"))


def metrics_at_thresholds(pred: DataFrame, truth: DataFrame, thresholds: Sequence[float] = (0.1, 0.5, 0.8), mode: str = "max", beta: float = 1.0, keys: Sequence[str] = KEYS, recordings: DataFrame | None = None, width: int = 256) -> DataFrame:
    """keys, threshold, n_truth, truth_hits, n_pred, pred_hits, precision, recall, f_score.

    The IoUs are computed once; every target goes to all thresholds in one aggregation. Precision counts *truth* boxes
    hit as right and *predictions* not hit as wrong.
    """
    sides = iou_per_target(truth, pred, mode, keys, width).withColumn("side", F.lit("t")).unionByName(iou_per_target(pred, truth, mode, keys, width).withColumn("side", F.lit("p")))
    at = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    t, p = F.col("side") == "t", F.col("side") == "p"
    counts = (
        sides.select(*keys, "side", "n_matches", "value", at)
        .groupBy(*keys, "threshold")
        .agg(F.count_if(t).alias("n_truth"), F.count_if(t & is_hit(F.col("threshold"))).alias("truth_hits"), F.count_if(p).alias("n_pred"), F.count_if(p & is_hit(F.col("threshold"))).alias("pred_hits"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    every = _all_keys(recordings, keys, pred, truth).select(*keys, at)
    own = every.join(counts, [*keys, "threshold"], "left").select(*keys, "threshold", *[zero(c) for c in ("n_truth", "truth_hits", "n_pred", "pred_hits")])
    wrong = F.col("n_pred") - F.col("pred_hits")
    return (
        own.withColumn("precision", _ratio(F.col("truth_hits"), F.col("truth_hits") + wrong))
        .withColumn("recall", _ratio(F.col("truth_hits"), F.col("n_truth")))
        .withColumn("f_score", f_beta(F.col("precision"), F.col("recall"), beta))
    )


def detection_precision(pred: DataFrame, truth: DataFrame, threshold: float = 0.5, mode: str = "max", keys: Sequence[str] = KEYS, recordings: DataFrame | None = None, width: int = 256) -> DataFrame:
    return metrics_at_thresholds(pred, truth, [threshold], mode, 1.0, keys, recordings, width).select(*keys, "precision")


def detection_recall(pred: DataFrame, truth: DataFrame, threshold: float = 0.5, mode: str = "max", keys: Sequence[str] = KEYS, recordings: DataFrame | None = None, width: int = 256) -> DataFrame:
    return metrics_at_thresholds(pred, truth, [threshold], mode, 1.0, keys, recordings, width).select(*keys, "recall")


def recall_per_label(pred: DataFrame, truth: DataFrame, threshold: float = 0.5, mode: str = "max", keys: Sequence[str] = KEYS, width: int = 256) -> DataFrame:
    """keys, label, hits, total, ``recall``."""
    return count_hits_per_label(iou_per_target(truth, pred, mode, keys, width), threshold, keys).withColumn("recall", _ratio(F.col("hits"), F.col("total")))


def summarise_models(metrics: DataFrame, recordings: DataFrame, percent: bool = True) -> DataFrame:
    """``metrics``: model, recording, metric, value. Macro mean over all recordings: model, metric, ``value``."""
    n = recordings.select("recording").agg(F.count_distinct("recording").alias("n"))
    sums = metrics.groupBy("model", "metric").agg(F.sum("value").alias("s"))
    return sums.join(F.broadcast(n)).select("model", "metric", (F.col("s") / F.col("n") * (100.0 if percent else 1.0)).alias("value"))  # one row


def wide(summary: DataFrame, models: Sequence[str]) -> DataFrame:
    """One column for each model."""
    return summary.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))


def summarise_recall_per_class(recalls: DataFrame, recordings: DataFrame, percent: bool = True) -> DataFrame:
    """``recalls``: model, recording, label, threshold, recall. A label absent from a recording counts 0 there."""
    n = recordings.select("recording").agg(F.count_distinct("recording").alias("n"))
    sums = recalls.groupBy("model", "label", "threshold").agg(F.sum("recall").alias("s"))
    return sums.join(F.broadcast(n)).select("model", "label", "threshold", (F.col("s") / F.col("n") * (100.0 if percent else 1.0)).alias("value"))  # one row


def match_labels(pred: DataFrame, truth: DataFrame, keys: Sequence[str] = KEYS, width: int = 256, noise: str = "noise") -> DataFrame:
    """keys, box_id, ``predicted``, ``true``: the label of the truth box with the best IoU (ties: first by end, then
    start), or ``noise`` where none matches."""
    own = distinct_boxes(pred, keys)
    order = F.struct("iou", (-F.col("b_t_end")).alias("e"), (-F.col("b_t_start")).alias("s"), (-F.col("b_freq_start")).alias("f"), (-F.col("b_box_id")).alias("i"))
    best = iou_elementwise(pred, truth, keys, width).groupBy(*keys, F.col("a_box_id").alias("box_id")).agg(F.max_by(F.struct(F.col("b_label").alias("l")), order).alias("b"))
    return own.join(best, [*keys, "box_id"], "left").select(*keys, "box_id", F.col("label").alias("predicted"), F.when(F.col("b").isNull(), F.lit(noise)).otherwise(F.col("b.l")).alias("true"))


def confusion_matrix(pairs: DataFrame, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Counts, a row for each listed true label (zeros kept), a column for each listed predicted label."""
    spark = pairs.sparkSession
    counts = pairs.filter(F.col("true").isin(*labels)).groupBy(*keys, "true").pivot("predicted", list(labels)).count()
    names = spark.createDataFrame([(x,) for x in labels], "true string")
    if keys:
        names = pairs.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(x) for x in labels])).alias("true"))
    return names.join(counts, [*keys, "true"], "left").na.fill(0, list(labels))


def accuracy(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of equal labels over all pairs, in percent."""
    return pairs.groupBy(*keys).agg((F.avg(F.when(F.col("predicted") == F.col("true"), 1.0).otherwise(0.0)) * 100).alias("accuracy"))

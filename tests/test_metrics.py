import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import boxes, pixels, random_boxes
from ultraspan.functions.geometry import f_beta
from ultraspan.operators import intervals as iv
from ultraspan.operators import metrics as mt

TRUTH = [(1, 7, 2, 8, "sh"), (3, 5, 9, 10, "fm"), (7, 10, 9, 11, "fm")]
PRED = [(0, 5, 4, 8, None), (8, 9, 9, 11, None)]


@pytest.fixture(scope="module")
def sides(spark):
    return boxes(spark, PRED), boxes(spark, TRUTH)


@pytest.mark.parametrize(("axis", "expected"), [(None, 31 / 72), (0, 8 / 10), ("freq", 7 / 11)])
def test_iou_global(sides, axis, expected):
    assert mt.iou_global(*sides, axis).first()["iou"] == pytest.approx(expected)


def test_iou_elementwise(sides):
    rows = {(r["target_id"], r["cover_id"]): r["iou"] for r in mt.matches(sides[1], sides[0]).collect()}
    assert rows == {(0, 0): pytest.approx(25 / 54), (1, None): None, (2, 1): pytest.approx(6 / 12)}


@pytest.mark.parametrize(("axis", "expected"), [("time", (1, 0.8)), ("freq", (7 / 8, 7 / 10)), (None, (31 / 36, 31 / 67))])
def test_coverage(sides, axis, expected):
    r = mt.coverage(*sides, axis).first()
    assert (r["a_covered"], r["b_covered"]) == pytest.approx(expected)


def test_precision_and_recall(sides):
    assert mt.detection_precision(*sides, 0.4).first()["precision"] == 1
    assert mt.detection_precision(*sides, 0.5).first()["precision"] == 0.5
    assert mt.detection_recall(*sides, 0.4, "sum").first()["recall"] == pytest.approx(2 / 3)
    per = {r["label"]: r["recall"] for r in mt.recall_per_label(*sides, 0.4, "sum").collect()}
    assert per == {"sh": 1, "fm": 0.5}


@pytest.mark.parametrize(("p", "r", "beta", "f"), [(1, 1, 1, 1), (1, 1, 0, 1), (1, 1, 0.5, 1), (0.8, 1, 999999, 1), (0.83, 0.71, 1, 0.765), (0.83, 0.71, 2, 0.731), (0.71, 0.83, 2, 0.802), (0, 0, 1, 0)])
def test_f_beta(spark, p, r, beta, f):
    assert spark.range(1).select(f_beta(F.lit(float(p)), F.lit(float(r)), beta)).first()[0] == pytest.approx(f, abs=1e-3)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("width", [3, 256])
def test_against_pixels(spark, seed, width):
    p, t = random_boxes(seed, 25), random_boxes(seed + 50, 20)
    a, b = boxes(spark, p), boxes(spark, t)
    pp, tp = pixels(p), pixels(t)
    assert iv.union_area(a).first()["covered"] == len(pp)
    assert mt.iou_global(a, b).first()["iou"] == pytest.approx(len(pp & tp) / len(pp | tp))
    pairs = {(r["a_box_id"], r["b_box_id"]) for r in iv.overlap_join(a, b, width=width).collect()}
    assert pairs == {(i, j) for i, x in enumerate(p) for j, y in enumerate(t) if pixels([x]) & pixels([y])}
    got = {r["box_id"]: r["value"] for r in mt.iou_per_target(b, a, "sum", width=width).collect()}
    for i, y in enumerate(t):
        if i in got:  # equal boxes collapse
            own = pixels([y])
            cover = pixels([x for x in p if pixels([x]) & own])
            assert got[i] == pytest.approx(len(own & cover) / len(own | cover))


def test_areas_against_pixels_and_across_blocks(spark):
    rng = np.random.default_rng(2)
    for n in [1, 2, 3, 10, 60] * 8:
        rows = [(int(b), int(b + h), int(a), int(a + w)) for a, b, w, h in zip(rng.integers(0, 40, n), rng.integers(0, 30, n), rng.integers(0, 12, n), rng.integers(0, 9, n), strict=True)]
        fs, fe, ts, te = np.array(rows).T
        assert iv.area_of_union(ts, te + 1, fs, fe + 1) == len(pixels(rows))
    sides = [random_boxes(s, 40, t=90, length=30) for s in (7, 8)]
    both = boxes(spark, sides[0]).withColumn("side", F.lit(1)).unionByName(boxes(spark, sides[1]).withColumn("side", F.lit(2))).withColumn("other", F.lit(None).cast("string"))
    for width in (1, 16, 1024):
        r = iv.side_areas(both, ("recording", "other"), width).first()
        a, b = map(pixels, sides)
        assert (r["one"], r["two"], r["either"]) == (len(a), len(b), len(a | b))
    assert iv.side_areas(both.filter("side = 2"), ("recording",)).select("one").first()[0] == 0
    assert iv.side_areas(both.filter("false")).count() == 0


def test_many_boxes_in_one_block(spark):
    """Overlapping boxes over thousands of bins: their number counts, not their height."""
    n = 20_000
    rows = spark.range(n).select(F.lit("r").alias("recording"), (F.col("id") * 37 % 700).alias("t_start"), (F.col("id") * 37 % 700 + 200).alias("t_end"), (F.col("id") * 131 % 50_000).alias("freq_start"), (F.col("id") * 131 % 50_000 + 9000).alias("freq_end"))
    t, f, w, h = 700, 50_000, 200, 9000
    grid = np.zeros((t + w + 2, f + h + 2), np.int32)
    i = np.arange(n)
    a, b = i * 37 % t, i * 131 % f
    for da, db, s in ((0, 0, 1), (w + 1, 0, -1), (0, h + 1, -1), (w + 1, h + 1, 1)):
        np.add.at(grid, (a + da, b + db), s)
    expected = int((np.cumsum(np.cumsum(grid, 0, dtype=np.int32), 1, dtype=np.int32) > 0).sum())
    assert iv.union_area(rows).first()["covered"] == expected


def test_duplicates_null_labels_and_empty_sides(spark):
    p = boxes(spark, [(0, 3, 0, 3, None), (0, 3, 0, 3, None), (0, 3, 0, 3, "x")])
    t = boxes(spark, [])
    rec = spark.createDataFrame([("r",), ("silent",)], "recording string")
    assert mt.distinct_boxes(p).count() == 2
    rows = {r["recording"]: (r["n_pred"], r["precision"], r["recall"], r["f_score"]) for r in mt.metrics_at_thresholds(p, t, [0.5], recordings=rec).collect()}
    assert rows == {"r": (2, 0, 0, 0), "silent": (0, 0, 0, 0)}
    assert mt.coverage(t, t, recordings=rec).count() == 2
    assert mt.count_hits_per_label(mt.iou_per_target(p, p), 1.0).filter("label is null").first()["hits"] == 1


def test_long_cover_with_late_end_is_found(spark):
    t, p = boxes(spark, [(0, 1, 0, 5)]), boxes(spark, [(0, 1, 10, 12), (0, 1, 1, 5000)])
    assert [r["b_box_id"] for r in iv.overlap_join(t, p, width=16).collect()] == [1]


@pytest.mark.parametrize("deltas", [(0, 0), (3, 2)])
def test_boxes_of_all_lengths(spark, deltas):
    rng = np.random.default_rng(11)
    length = lambda n: np.exp(rng.random(n) * 9).astype(int)
    make = lambda n: [(int(b), int(b) + 2, int(a), int(a + w)) for a, b, w in zip(rng.integers(0, 9000, n), rng.integers(0, 12, n), length(n), strict=True)]
    a, b = make(120), make(150)
    dt, df = deltas
    pairs = [(r["a_box_id"], r["b_box_id"]) for r in iv.overlap_join(boxes(spark, a), boxes(spark, b), width=4, delta_time=dt, delta_freq=df).collect()]
    assert sorted(pairs) == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[2] - dt <= y[3] and y[2] <= x[3] + dt and x[0] - df <= y[1] and y[0] <= x[1] + df]


def test_rows_of_a_recording_long_box(spark):
    day = 977 * 86_400
    long, short = boxes(spark, [(0, 1, 5, day)]), boxes(spark, [(0, 1, 3 * i, 3 * i + 40) for i in range(50)])
    assert iv.box_levels(short) == [0] and iv.box_levels(long) == [7]
    dealt = iv._bucketed(iv._prefixed(long, ("recording",), "a_"), "a_", 256, 0, [7], [0])
    assert dealt.count() <= 2
    assert iv._bucketed(iv._prefixed(short, ("recording",), "b_"), "b_", 256, 0, [0], [7]).count() <= 4 * 50
    assert iv.overlap_join(long, short).count() == 50


def test_labels_and_confusion(spark):
    p = boxes(spark, [(0, 3, 0, 3, "a"), (0, 3, 10, 13, "b"), (0, 3, 30, 33, "a")])
    t = boxes(spark, [(0, 3, 1, 3, "a"), (0, 3, 0, 1, "b"), (0, 3, 10, 13, "a")])
    pairs = mt.match_labels(p, t)
    assert {r["box_id"]: r["true"] for r in pairs.collect()} == {0: "a", 1: "a", 2: "noise"}
    assert {r["true"]: (r["a"], r["b"]) for r in mt.confusion_matrix(pairs, ["a", "b"]).collect()} == {"a": (1, 1), "b": (0, 0)}
    assert mt.accuracy(pairs).first()["accuracy"] == pytest.approx(100 / 3)

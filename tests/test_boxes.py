import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import boxes, meta, random_boxes
from ultraspan.functions import kernels
from ultraspan.functions.geometry import box_distances
from ultraspan.operators import boxes as bx
from ultraspan.operators import spectrogram as sp


def test_box_distances(spark):
    b = {1: (1, 1, 5, 5), 2: (2, 5, 7, 10), 3: (1, 20, 11, 20), 4: (20, 35, 1, 11), 5: (25, 25, 0, 15)}
    expected = {(1, 2): (1, 2), (3, 2): (0, 1), (3, 4): (0, 0), (5, 4): (0, 0), (5, 3): (5, 0), (5, 2): (20, 0), (5, 1): (24, 0)}
    rows = [(i, j, *b[i], *b[j]) for i, j in expected]
    names = ["i", "j", *[f"{p}{c}" for p in ("a_", "b_") for c in ("t_start", "t_end", "freq_start", "freq_end")]]
    t, f = box_distances("a_", "b_")
    got = spark.createDataFrame(rows, names).select("i", "j", t.alias("t"), f.alias("f")).collect()
    assert {(r["i"], r["j"]): (r["t"], r["f"]) for r in got} == expected


def test_merge(spark):
    stay = [(0, 1, 0, 1), (8, 9, 58, 59), (1, 4, 5, 6), (1, 4, 9, 10), (8, 9, 5, 10)]
    join = [(2, 3, 20, 26), (7, 8, 28, 29), (4, 5, 27, 28)]
    m = spark.createDataFrame([("r", 0.0, 60 / 59, 60, 0.0, 10000 / 9, 10)], "recording string, t0 double, dt double, n_time long, f0 double, df double, n_freq long")
    got = {(r["freq_start"], r["freq_end"], r["t_start"], r["t_end"]) for r in bx.merge_boxes_si(boxes(spark, stay + join), m, 2000.0, 1.0).collect()}
    assert got == {*stay, (2, 8, 20, 29)}


def _brute(rows, dt, df):
    pairs = [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and a[2] - dt <= b[3] and b[2] <= a[3] + dt and a[0] - df <= b[1] and b[0] <= a[1] + df]
    root = kernels.components(len(rows), np.array(pairs).reshape(-1, 2))
    return sorted((min(rows[i][0] for i in g), max(rows[i][1] for i in g), min(rows[i][2] for i in g), max(rows[i][3] for i in g)) for g in [[i for i in range(len(rows)) if root[i] == r] for r in set(root)])


@pytest.mark.parametrize("block", [1, 7, 5000])
def test_merge_in_blocks_and_by_components_agree(spark, block):
    for seed, dt, df in ((3, 1, 1), (4, 0, 2), (5, 4, 0)):
        rows = random_boxes(seed, 60, t=150, f=40, length=5)
        got = bx.merge_boxes(boxes(spark, rows), df, dt, block=block).collect()
        assert sorted((r["freq_start"], r["freq_end"], r["t_start"], r["t_end"]) for r in got) == _brute(rows, dt, df)


def test_sweep_against_all_pairs():
    rng = np.random.default_rng(1)
    for n in [2, 3, 5, 40, 200] * 6:
        dt, df = rng.integers(0, 5, 2)
        rows = [(int(b), int(b + h), int(a), int(a + w)) for a, b, w, h in zip(rng.integers(0, 90, n), rng.integers(-20, 60, n), rng.integers(0, 12, n), rng.integers(0, 9, n), strict=True)]
        fs, fe, ts, te = np.array(rows).T
        of = kernels.sweep_components(ts, te, fs, fe, int(dt), int(df))
        got = sorted((int(fs[of == r].min()), int(fe[of == r].max()), int(ts[of == r].min()), int(te[of == r].max())) for r in set(of.tolist()))
        assert got == _brute(rows, dt, df)


def test_dense_island_gives_links_no_pairs(spark):
    """50,000 boxes that all touch: one component, and no more links than boxes and blocks."""
    n = 50_000
    rows = spark.range(n).select(F.lit("r").alias("recording"), F.col("id").alias("box_id"), (F.col("id") % 90).alias("freq_start"), (F.col("id") % 90 + 20).alias("freq_end"), (F.col("id") % 977).alias("t_start"), (F.col("id") % 977 + 300).alias("t_end"), F.lit(1.0).alias("score"))
    got = bx.merge_boxes(rows, 1, 1, block=512).collect()
    assert [(r["n_merged"], r["t_start"], r["t_end"], r["freq_end"]) for r in got] == [(n, 0, 1276, 109)]


def test_long_chain_is_one_box(spark):
    rows = [(0, 1, 2 * i, 2 * i + 2) for i in range(3000)]
    for block in (100, 10_000):
        got = bx.merge_boxes(boxes(spark, rows), 0, 0, block=block).collect()
        assert [(r["t_start"], r["t_end"], r["n_merged"]) for r in got] == [(0, 6000, 3000)]


def test_clip_keeps_the_drift(spark):
    m = meta(spark, 10, 10, 1.0, 1.0)
    # bound 3.0 s is pixel ceil(3 * 10 / 9) = 4
    got = bx.clip_boxes(boxes(spark, [(0, 5, 0, 4), (0, 5, 2, 5), (2, 3, 6, 9)]), m, t_start=3.0).orderBy("box_id").collect()
    assert [(r["box_id"], r["t_start"], r["t_end"]) for r in got] == [(1, 0, 1), (2, 2, 5)]
    parts = {(r["part"], r["box_id"]) for r in sp.train_test_split_by_time(boxes(spark, [(0, 5, 0, 4), (0, 5, 2, 5), (2, 3, 6, 9)]), m, 3.0).collect()}
    assert parts == {("train", 0), ("train", 1), ("test", 1), ("test", 2)}


def test_si_round_trip_and_filters(spark):
    m = meta(spark, 100, 50, 0.5, 100.0)
    b = boxes(spark, [(3, 9, 10, 20, ""), (0, 49, 0, 100, "x")])
    si = bx.boxes_to_si(b, m)
    assert [(r["time_end"], r["label"]) for r in si.orderBy("box_id").collect()] == [(10.0, None), (49.5, "x")]
    back = bx.si_to_boxes(si, m).orderBy("box_id").collect()
    assert [(r["freq_start"], r["freq_end"], r["t_start"], r["t_end"]) for r in back] == [(3, 9, 10, 20), (0, 49, 0, 99)]
    assert bx.filter_boxes(b, m, 5.0, 500.0).count() == 1  # strictly above: 5.0 s isn't
    assert bx.filter_by_ratio(boxes(spark, [(0, 5, 1, 1), (0, 5, 0, 10)]), 1.0).count() == 1


def test_annotations(spark):
    m = meta(spark, 11, 11, 1.0, 1000.0)
    a = spark.createDataFrame([("r", 0, 1.2, 4.1, 900.0, 3000.0, "x"), ("r", 1, -5.0, 2.0, -1.0, 99999.0, None), ("r", 2, 12.0, 15.0, 0.0, 10.0, "x"), ("other", 3, 0.0, 1.0, 0.0, 10.0, "x")], "begin_file string, box_id long, begin_time double, end_time double, low_freq double, high_freq double, usv_type string")
    got = {r["box_id"]: (r["t_start"], r["t_end"], r["freq_start"], r["freq_end"]) for r in bx.annotations_to_boxes(a, m).collect()}
    span = 10 / 11
    assert got == {0: (int(1.2 // span), int(-(-4.1 // span)), 0, int(-(-3 // span))), 1: (0, int(-(-2 // span)), 0, 11)}
    assert [r[0] for r in bx.unknown_files(a, m).collect()] == ["other"]


def test_windows_and_their_predictions(spark):
    m = meta(spark, 100, 50)
    b = boxes(spark, [(5, 9, 10, 20, "old"), (5, 9, 30, 95, "old")])
    w = bx.classification_windows(b, m, 20, 0.5, 3, 10).orderBy("box_id", "window").collect()
    assert [(r["t_start"], r["t_end"]) for r in w if r["box_id"] == 0] == [(7, 23)]
    assert [r["t_start"] for r in w if r["box_id"] == 1] == [27, 37, 47, 57, 67]
    assert w[0]["freq_start"] == 0
    preds = spark.createDataFrame([("r", 1, 0, "a", 0.7), ("r", 1, 1, "b", 0.9), ("r", 1, 2, "c", 0.9), ("r", 0, 0, "a", 0.4)], "recording string, box_id long, window int, class string, score double")
    assert {r["box_id"]: r["label"] for r in bx.reduce_window_predictions(b, preds, 0.5).collect()} == {0: "old", 1: "b"}


def test_classify(spark):
    b = boxes(spark, [(0, 10, 0, 1), (0, 11, 0, 1)])
    assert [r["label"] for r in bx.classify_by_frequency(b, 5, "lo", "hi").orderBy("box_id").collect()] == ["lo", "hi"]


def test_empty(spark):
    none, m = boxes(spark, []), meta(spark, 10, 10)
    assert bx.merge_boxes(none, 1, 1).count() == 0
    assert bx.clip_boxes(none, m).count() == 0
    assert bx.union_detections(a=none, b=none).filter(F.col("model") == "a").count() == 0

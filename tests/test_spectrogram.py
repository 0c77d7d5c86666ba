import io
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import boxes, frames, matrix, meta
from ultraspan.functions import kernels
from ultraspan.operators.intervals import runs, time_islands
from ultraspan.operators import contour as ct
from ultraspan.operators import denoise as dn
from ultraspan.operators import detect as de
from ultraspan.operators import inference as nf
from ultraspan.operators import noise as nz
from ultraspan.operators import search as se
from ultraspan.operators import spectrogram as sp
from ultraspan.plans import workflows as wf
from ultraspan.sources import annotations as sa
from ultraspan.sources import audio
from ultraspan.sources import detections as sd
from ultraspan.streaming.ingest import detect_stream, stream_chunks

SIGNAL = np.random.default_rng(0).normal(size=1000)


def chunks(spark, x, size, recording="r"):
    rows = [(recording, len(x), k, k * size, [float(v) for v in x[k * size : (k + 1) * size]]) for k in range(-(-len(x) // size))]
    return spark.createDataFrame(rows, "recording string, n_samples long, chunk_id long, sample_start long, samples array<double>")


def direct(x, n_fft, win, hop, power):
    p = np.pad(x, n_fft // 2, mode="reflect")
    return np.array([np.abs(np.fft.rfft(p[i * hop : i * hop + n_fft] * kernels.hann(n_fft, win))) ** power for i in range(1 + len(x) // hop)]).T


@pytest.mark.parametrize("size", [64, 100, 333, 2000])
def test_stft_does_not_depend_on_chunks(spark, size):
    got = matrix(sp.spectrogram(chunks(spark, SIGNAL, size), 64, 48, 20, 2.0))
    np.testing.assert_allclose(got, direct(SIGNAL, 64, 48, 20, 2.0), atol=1e-9)


def test_signal_slice(spark):
    rec = spark.createDataFrame([("r", 100, 1000)], "recording string, sample_rate int, n_samples long")
    got, m = sp.signal_slice_spectrogram(chunks(spark, SIGNAL, 128), rec, 0.2, 0.7, 64, None, 32)
    np.testing.assert_allclose(matrix(got), direct(SIGNAL[200:700], 64, 64, 32, 1), atol=1e-9)
    assert (m.first()["t0"], m.first()["n_time"]) == (2.0, 16)
    with pytest.raises(ValueError):
        sp.signal_slice(chunks(spark, SIGNAL, 128), 0.5, 0.5)


IMAGE = np.array([[1, 2, 30, 4], [5, 66, 7, 8], [90, 10, 91, 12]], float)


def _gauss(i, j, sx, sy, w):
    k = {(p, q): w(p, q, sx, sy) for p in (-1, 0, 1) for q in (-1, 0, 1)}
    return sum(IMAGE[i + q, j + p] * v for (p, q), v in k.items()) / sum(k.values())


@pytest.mark.parametrize("sigma", [(1, 1), (1, 2)])
def test_gaussian_filters(spark, sigma):
    plain = matrix(dn.gaussian_filter(frames(spark, IMAGE), *sigma, 3))
    slanted = matrix(dn.diagonal_gaussian_filter(frames(spark, IMAGE), *sigma, 3))
    for i, j in ((1, 1), (1, 2)):
        assert plain[i, j] == pytest.approx(_gauss(i, j, *sigma, lambda p, q, a, b: np.exp(-0.5 * ((p / a) ** 2 + (q / b) ** 2))))
        # the kernel's first index runs along frequency there
        assert slanted[i, j] == pytest.approx(_gauss(i, j, *sigma, lambda q, p, a, b: np.exp(-(((q - p) / a) ** 2 + ((p + q) / b) ** 2))))
    with pytest.raises(ValueError):
        dn.gaussian_filter(frames(spark, IMAGE), 1, 1, 4)


def test_halo_makes_blocks_exact(spark):
    x = np.random.default_rng(1).random((12, 50))
    whole = matrix(sp.with_halo(frames(spark, x), 4, lambda m, a, b: kernels.correlate(np.pad(m, ((4, 4), (4 - a, 4 - b)), mode="symmetric"), np.ones((9, 9)) / 81)))
    for block in (3, 7, 20):
        got = matrix(sp.with_halo(frames(spark, x), 4, lambda m, a, b: kernels.correlate(np.pad(m, ((4, 4), (4 - a, 4 - b)), mode="symmetric"), np.ones((9, 9)) / 81), block))
        np.testing.assert_allclose(got, whole)


def test_contour_tiles_agree(spark):
    x = np.random.default_rng(2).random((16, 60))
    x[5:9, 20:30] += 3
    f, m = frames(spark, x), meta(spark, 60, 16)
    edges = ct.inverse_gaussian_gradient(f, 1.0, 50.0)
    start = ct.ones_level_set(f, m)
    one = matrix(ct.evolve(edges, start, 6, 1, 0.3, -1))
    np.testing.assert_array_equal(one, matrix(ct.evolve(edges, start, 6, 1, 0.3, -1, block=7)))
    np.testing.assert_array_equal(one, kernels.active_contour(matrix(edges), matrix(start), 6, 1, 0.3, -1))
    boxed = ct.detect_gac(f, m, 2, False, 30, 0, 0.3, -1, "ones", None, 1.0, 50.0)
    assert boxed.filter("t_start <= 21 and t_end >= 28").count() >= 1


def test_components_of_masks(spark):
    mask = np.zeros((20, 20))
    mask[10:13, 3:6] = 1
    got = ct.find_bounding_boxes(frames(spark, mask), 0).collect()
    assert [(r["freq_start"], r["freq_end"], r["t_start"], r["t_end"]) for r in got] == [(10, 12, 3, 5)]
    x = (np.random.default_rng(3).random((15, 30)) < 0.45).astype(float)
    seen, comps = set(), []
    for a in zip(*np.nonzero(x), strict=True):
        if a not in seen:
            todo, own = [a], []
            seen.add(a)
            while todo:
                i, j = todo.pop()
                own.append((i, j))
                for b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                    if b not in seen and 0 <= b[0] < 15 and 0 <= b[1] < 30 and x[b]:
                        seen.add(b)
                        todo.append(b)
            comps.append((min(i for i, _ in own), max(i for i, _ in own), min(j for _, j in own), max(j for _, j in own), len(own)))
    got = ct.find_bounding_boxes(frames(spark, x), 1).collect()
    assert sorted((r["freq_start"], r["freq_end"], r["t_start"], r["t_end"], r["n_cells"]) for r in got) == sorted(comps)


def test_noise_gate_against_numpy(spark):
    x, noise = np.random.default_rng(4).random((6, 25)) + 0.01, np.random.default_rng(5).random((6, 9)) / 4 + 0.01
    got = matrix(dn.noise_gate(frames(spark, x), frames(spark, noise), 2, 1, 0.5, 0.7, top_db=60.0))
    db = lambda v: np.maximum(20 * np.log10(v), (20 * np.log10(v)).max() - 60)
    limit = db(noise).mean(axis=1) + 0.5 * db(noise).std(axis=1)
    mask = np.pad((db(x) < limit[:, None]).astype(float), ((2, 2), (1, 1)))
    k = np.outer(dn.triangle(2), dn.triangle(1))
    m = kernels.correlate(np.pad(mask, ((0, 0), (0, 0))), np.pad(k, ((0, 0), (1, 1)))[:, 1:-1]) if k.shape == (5, 3) else None
    m *= 0.7
    np.testing.assert_allclose(got, 10 ** ((db(x) * (1 - m) + db(x).min() * m) / 20), rtol=1e-9)
    loud = np.full((6, 5), 5.0)
    np.testing.assert_allclose(matrix(dn.noise_gate(frames(spark, loud), frames(spark, noise))), loud)


def test_bilateral_and_transients(spark):
    flat = np.full((7, 9), 2.0)
    np.testing.assert_allclose(matrix(dn.bilateral_filter(frames(spark, flat), 3, 1.0, 1.0)), flat)
    np.testing.assert_allclose(matrix(dn.transient_suppression(frames(spark, flat), 0.25)), flat * 0.25, atol=1e-12)


def test_entropy_edges(spark):
    x = np.array([[1.0, 0.0, 0.0], [1.0, 2.0, 0.0]])
    assert [r["entropy"] for r in de.spectral_entropy(frames(spark, x)).orderBy("frame").collect()] == [1.0, 0.0, None]
    whole = np.vstack([np.ones((1, 6)) * 9, np.zeros((3, 6))])  # low at both ends of time
    got = de.low_entropy_ranges(frames(spark, whole), 1, 0.5).collect()
    assert [(r["first"], r["last"]) for r in got] == [(0, 5)]
    with pytest.raises(ValueError):
        de.detect_entropy_energy(frames(spark, x), meta(spark, 3, 2), merge=True)


def test_noise_spans(spark):
    m = meta(spark, 100, 4)
    # nested, touching and leading boxes
    b = boxes(spark, [(0, 1, 0, 5), (0, 1, 20, 60), (0, 1, 25, 30), (0, 1, 61, 62), (0, 1, 70, 75)])
    got = sorted((r["span_start"], r["span_end"]) for r in nz.find_noise_spans(b, m, 5.0).collect())
    assert got == [(5, 20), (62, 70), (75, 100)]
    assert [(r["span_start"], r["span_end"]) for r in nz.find_noise_spans(b.limit(0), m, 5.0).collect()] == [(0, 100)]
    spans = spark.createDataFrame([("r", "c", 6.0, 15.0), ("r", "d", 50.0, 80.0)], "recording string, config_id string, start double, end double")
    assert [r["config_id"] for r in nz.spans_with_calls(spans, b, m).collect()] == ["d"]
    assert [r["config_id"] for r in nz.spans_without_calls(spans, b, m).collect()] == ["c"]
    none = nz.choose_noise_span(spark.createDataFrame([], "recording string, span_start long, span_end long, weight double"), m, 7.0).first()
    assert none["fallback"] and none["span_end"] - none["span_start"] == 8  # ceil(7 * 100 / 99)


def test_chunks_without_an_exact_fit(spark):
    assert sp.chunk_starts(meta(spark, 10, 4), 10, 0).count() == 0
    assert [(r["first"], r["last"]) for r in sp.chunk_starts(meta(spark, 11, 4), 4, 2).orderBy("first").collect()] == [(0, 3), (2, 5), (4, 7), (6, 9)]


def test_clip_outside_is_an_error(spark):
    cut, _ = sp.clip_spectrogram(frames(spark, IMAGE), meta(spark, 4, 3), t_start=9.0)
    with pytest.raises(Exception, match="outside"):
        cut.collect()


def test_standardize(spark):
    b = boxes(spark, [(0, 2, 1, 3)])
    r = sp.standardize_pad(frames(spark, IMAGE), b).first()
    own = IMAGE[0:2, 1:3]
    crop = np.array(r["crop"])
    assert crop.shape == (32, 32)
    np.testing.assert_allclose(crop[:2, :2], (own - own.mean()) / own.std())


def test_predictions(spark):
    rows = [("r", 0, 1.9, 2.0, 5.2, 4.0, 1, 0.5), ("r", 1, 1.0, 2.0, 5.0, 4.0, 1, 0.9), ("r", 1, 1.0, 2.0, 5.0, 4.0, 0, 0.9)]
    p = spark.createDataFrame(rows, "recording string, chunk_id long, t_start double, freq_start double, t_end double, freq_end double, label_id int, score double")
    own = nf.combine_chunk_predictions(p, 4, 0.5)
    assert sorted(r["t_start"] for r in own.collect()) == [5, 5]
    merged = nf.merge_predictions_per_label(own, meta(spark, 100, 50), {1: "sh"}, 10).collect()
    assert [(r["label"], r["freq_start"]) for r in merged] == [("sh", 12)]


def test_sweep_in_blocks_without_copies_of_frames(spark, monkeypatch):
    """Contours over several blocks; no table has a row for each frame and setting."""
    x = np.random.default_rng(4).random((12, 70))
    x[3:8, 10:45] += 2
    f, m = frames(spark, x), meta(spark, 70, 12)
    given = [{"num_iter": n, "smoothing": 0, "threshold": 0.7, "balloon": b, "flood_threshold": v, "sigma": 1.0} for n, b, v in ((3, 1, 0.4), (2, -1, 0.6))]
    expected = [sorted((b["t_start"], b["t_end"], b["freq_start"], b["freq_end"]) for b in ct.detect_gac(f, m, 1, False, g["num_iter"], 0, 0.7, g["balloon"], "eroded", g["flood_threshold"], 1.0, 50.0).collect()) for g in given]
    monkeypatch.setattr(ct, "BLOCK", 16)
    monkeypatch.setattr(ct, "eroded_level_set", None)  # makes such rows
    found = ct.detect_gac_settings(f, m, [{**g, "setting": i} for i, g in enumerate(given)], 1, False, 50.0).collect()
    assert [sorted((b["t_start"], b["t_end"], b["freq_start"], b["freq_end"]) for b in found if b["setting"] == i) for i in range(2)] == expected
    assert any(b[1] - b[0] > 16 for e in expected for b in e)


def test_sweep(spark):
    x = np.random.default_rng(2).random((16, 60))
    x[5:9, 20:30] += 3
    f, m = frames(spark, x), meta(spark, 60, 16)
    truth = boxes(spark, [(4, 9, 19, 30, "x")])
    configs = se.sample_configs(spark, 2, 7, {"num_iter": (3.0, 9.0), "smoothing": (0.0, 0.9), "flood_threshold": (0.5, 0.9), "balloon_latent": (1.2, 1.7), "sigma": (1.0, 2.0)})
    assert configs.collect() == se.sample_configs(spark, 2, 7, {"num_iter": (3.0, 9.0), "smoothing": (0.0, 0.9), "flood_threshold": (0.5, 0.9), "balloon_latent": (1.2, 1.7), "sigma": (1.0, 2.0)}).collect()
    # one plan for all settings finds what each setting finds by itself; equal settings are one trial
    params = se.with_params(configs.unionByName(configs.limit(1).withColumn("config_id", F.lit("again")))).collect()
    named = [{**r.asDict(), "setting": i} for i, r in enumerate(params)]
    together = ct.detect_gac_settings(f, m, named, 1, True, 50.0).groupBy("setting").agg(F.sort_array(F.collect_list(F.struct("t_start", "t_end", "freq_start", "freq_end"))).alias("b"))
    together = {r["setting"]: [tuple(b) for b in r["b"]] for r in together.collect()}
    for i, r in enumerate(params[:2]):
        alone = ct.detect_gac(f, m, 1, True, r["num_iter"], r["smoothing"], float(r["threshold"]), float(r["balloon"]), "eroded", float(r["flood_threshold"]), float(r["sigma"]), 50.0)
        assert together.get(i, []) == sorted((b["t_start"], b["t_end"], b["freq_start"], b["freq_end"]) for b in alone.collect())
    assert together.get(0) == together.get(2) and any(together.values())
    # settings that differ in their number of steps share one evolution
    ladder = [{**params[0].asDict(), "setting": 10 + n, "num_iter": n} for n in (2, 5, 9, 0, 5)]
    steps = spark.sparkContext.accumulator(0)
    rungs = ct.detect_gac_settings(f, m, [{**x, "setting": 20 + i} for i, x in enumerate(ladder)], 1, False, 50.0, steps).groupBy("setting").agg(F.sort_array(F.collect_list(F.struct("t_start", "t_end", "freq_start", "freq_end"))).alias("b"))
    rungs = {r["setting"]: r["b"] for r in rungs.collect()}
    assert steps.value == 9  # not 2 + 5 + 9 + 5
    for i, x in enumerate(ladder):
        alone = ct.detect_gac(f, m, 1, False, x["num_iter"], int(x["smoothing"]), float(x["threshold"]), float(x["balloon"]), "eroded", float(x["flood_threshold"]), float(x["sigma"]), 50.0)
        assert [tuple(b) for b in rungs.get(20 + i, [])] == sorted((b["t_start"], b["t_end"], b["freq_start"], b["freq_end"]) for b in alone.collect())
    out = wf.tune(f, m, truth, configs, 40.0, alpha=50.0)
    assert out["trials"].count() == 2
    best = out["best"].first()
    assert best["score"] == max(r["score"] for r in out["trials"].collect())


def wav(x, rate=1000, channels=1):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.asarray(x) * 32767).astype("<i2").tobytes())
    return buffer.getvalue()


def test_recordings_stream_and_detections(spark, tmp_path):
    folder = tmp_path / "in" / "box1"
    folder.mkdir(parents=True)
    x = np.sin(np.arange(3000) / 3) / 2
    (folder / "a.wav").write_bytes(wav(x))
    (folder / "b.wav").write_bytes(wav(np.column_stack([x[:10], -x[:10]]).ravel(), channels=2))
    (folder / "notes.txt").write_text("no sound")
    rec, parts = audio.read_recordings(spark, str(tmp_path / "in"), chunk=1000)
    assert {(r["recording"], r["n_samples"], r["duration"]) for r in rec.collect()} == {("box1/a.wav", 3000, 3.0), ("box1/b.wav", 10, 0.01)}
    whole = [v for r in parts.filter("name = 'a.wav'").orderBy("chunk_id").collect() for v in r["samples"]]
    np.testing.assert_allclose(whole, x, atol=1e-4)
    _, other = audio.read_recordings(spark, str(tmp_path / "in"), channel=1)
    assert other.filter("name = 'b.wav'").first()["samples"][1] < 0
    assert audio.get_signal(rec, "none").count() == 0
    query = detect_stream(stream_chunks(spark, str(tmp_path / "in")), lambda c: c.groupBy("recording").agg(F.max("n_samples").alias("n")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    m = meta(spark, 100, 50)
    own = boxes(spark, [(1, 2, 3, 4, "x")]).withColumn("config_id", F.lit("c"))
    for c in ("c", "d", "c"):
        sd.write_detections(own.withColumn("config_id", F.lit(c)), m, str(tmp_path / "found"))
    back = sd.read_detections(spark, str(tmp_path / "found"))
    assert {(r["config_id"], r["time_start"]) for r in back.collect()} == {("c", 3.0), ("d", 3.0)}
    (tmp_path / "spans").mkdir()
    (tmp_path / "spans" / "r1.json").write_text('{"c": {"start": 1.5, "end": 2.5}}')
    assert [tuple(r) for r in sd.read_noise_spans(spark, str(tmp_path / "spans")).collect()] == [("r1", "c", 1.5, 2.5)]
    sd.write_metrics(spark.range(2), str(tmp_path / "m"))
    sd.write_metrics(spark.range(3), str(tmp_path / "m"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "m")).count() == 5


def test_annotation_files(spark, tmp_path):
    folder = tmp_path / "box1"
    folder.mkdir()
    head = "Selection\tView\tChannel\tBegin Time (s)\tEnd Time (s)\tLow Freq (Hz)\tHigh Freq (Hz)\tBegin File\tNOTE"
    lines = ["1\ts\t1\t0.5\t0.7\t100\t200\tx.wav\tSH", "2\ts\t1\t10.5\t10.7\t100\t200\ty.wav\t22-kHz call", "3\ts\t1\t25.0\t25.5\t1\t2\tz.wav\t"]
    (folder / "notes.txt").write_text("\n".join([head, *lines]))
    a = sa.read_annotations(spark, str(tmp_path))
    assert [r["usv_type"] for r in a.orderBy("selection").collect()] == ["sh", "22-khz", "nan"]
    rec = spark.createDataFrame([("box1", "x.wav", 10.0), ("box1", "y.wav", 14.0), ("box1", "z.wav", 1.0)], "folder string, name string, duration double")
    got = [(r["begin_time"], r["in_order"]) for r in sa.align_annotation_times(a, rec).orderBy("selection").collect()]
    assert got == [(0.5, True), (0.5, True), (1.0, True)]
    labels = spark.createDataFrame([("junk",), ("x",), (None,)], "usv_type string")
    assert {r[0] for r in sa.clean_labels(labels).collect()} == {"x", None}


@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 0.75, 1.0])
def test_exact_percentile(spark, share):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 5000), (None, 300)) for v in rng.normal(size=n) ** 3] + [("d", 2.5)] * 50 + [("e", float(v // 10)) for v in range(95)] + [("c", None), ("f", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    for accuracy in (10, 1000):
        got = {r["k"]: r["q"] for r in sp.exact_percentile(df, ("k",), "x", share, "q", accuracy).collect()}
        assert got == {k: pytest.approx(np.quantile(v, share)) for k, v in by.items()}


def test_percentile_of_a_long_tail(spark, monkeypatch):
    """Nearly all values in a small part of their range: few of them are counted one by one."""
    rng = np.random.default_rng(5)
    x = np.exp(rng.normal(0, 3, 100_000))
    df = spark.createDataFrame(pd.DataFrame({"k": "r", "x": x}))
    tables = []
    monkeypatch.setattr(sp, "stash", lambda t: tables.append(t) or t)
    got = sp.exact_percentile(df, ("k",), "x", 0.75, "q").first()["q"]
    assert got == pytest.approx(np.quantile(x, 0.75))
    bracket = df.agg(F.percentile_approx("x", [0.748, 0.752], 1000)).first()[0]
    assert len(tables) == 1 and ((x >= bracket[0]) & (x <= bracket[1])).sum() < len(x) / 100


def test_percentile_outside_its_bracket(spark, monkeypatch):
    """A bracket that misses the rank is noticed, and the group counted whole."""
    monkeypatch.setattr(sp.F, "percentile_approx", lambda c, shares, accuracy: F.array(F.lit(7.0), F.lit(8.0)))
    df = spark.range(101).select(F.lit("r").alias("k"), F.col("id").cast("double").alias("x"))
    assert sp.exact_percentile(df, ("k",), "x", 0.5, "q").first()["q"] == 50.0


@pytest.mark.parametrize("reach", [0, 1])
def test_runs_of_masks_against_flooding(reach):
    rng = np.random.default_rng(6)
    for _ in range(60):
        mask = rng.random((int(rng.integers(1, 14)), int(rng.integers(1, 12)))) < rng.random()
        at = np.sort(rng.choice(30, mask.shape[0], replace=False)) if rng.random() < 0.4 else np.arange(5, 5 + mask.shape[0])
        row, first, last, of = kernels.mask_runs(mask, at, reach)
        label = np.full(mask.shape, -1)
        for r, a, b, c in zip(row, first, last, of, strict=True):
            label[r, a : b + 1] = c
        assert ((label >= 0) == mask).all()
        seen = np.full(mask.shape, -1)
        for start in zip(*np.nonzero(mask), strict=True):
            todo = [start]
            while todo:
                i, j = todo.pop()
                if 0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and mask[i, j] and seen[i, j] < 0:
                    seen[i, j] = start[0] * mask.shape[1] + start[1]
                    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (reach or not (a and b))]
                    todo += [(i + a, j + b) for a, b in near if a == 0 or (0 <= i + a < mask.shape[0] and abs(at[i + a] - at[i]) == 1)]
        pairs = {(a, b) for a, b in zip(label[mask].tolist(), seen[mask].tolist(), strict=True)}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_labels_and_level_sets_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.random((12, 70)), 3)
    f, m = frames(spark, x), meta(spark, 70, 12)
    level, found = [], []
    for block in (1, 3, 16, 2048):
        level.append(matrix(ct.eroded_level_set(f, m, 0.6, block=block)))
        mask = f.withColumn("mags", F.transform("mags", lambda v: (v > 0.45).cast("double")))
        found.append(sorted(tuple(r)[2:] for r in ct.find_bounding_boxes(mask, 2, block=block).collect()))
        parts = ct.block_components(mask, block=block)
        assert parts.select("_root").distinct().count() == len(ct.find_bounding_boxes(mask, 1, block=block).collect())
    assert all((a == level[0]).all() for a in level) and all(b == found[0] for b in found)
    above = np.pad(x > 0.6, 0)
    above[[0, -1]], above[:, [0, -1]] = True, True
    outside = np.zeros(x.shape, bool)
    outside[[0, -1]], outside[:, [0, -1]] = True, True
    while True:
        grown = kernels.dilate(outside.astype(np.int8)).astype(bool) & above
        if (grown == outside).all():
            break
        outside = grown
    np.testing.assert_array_equal(level[0], 1.0 - outside)


def test_eroded_contour_across_tiles(spark):
    rng = np.random.default_rng(8)
    x = rng.random((10, 90))
    x[3:7, 20:60] += 4
    f, m = frames(spark, x), meta(spark, 90, 10)
    edges = ct.inverse_gaussian_gradient(f, 1.0, 100.0)
    start = ct.eroded_level_set(edges, m, 0.3, block=16)
    whole = kernels.active_contour(matrix(edges), matrix(start), 3, 1, 0.3, -1.0)
    for block in (8, 4096):
        np.testing.assert_array_equal(matrix(ct.evolve(edges, start, 3, 1, 0.3, -1, block=block)), whole)


def test_averages_and_runs_over_block_borders(spark):
    rng = np.random.default_rng(9)
    n, width = 100, 5
    x = rng.random(n)
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)] + [(None, i, 1.0) for i in range(3)], "recording string, frame long, v double")
    padded = np.pad(x, (width // 2, (width - 1) // 2), constant_values=2.0)
    expected = [padded[i : i + width].mean() for i in range(n)]
    for block in (1, 7, 4096):
        got = de.moving_average(df, "v", width, ["recording"], "frame", 2.0, block).filter("recording = 'r'").orderBy("frame").collect()
        np.testing.assert_allclose([r["v"] for r in got], expected)
    flags = sorted(set(rng.integers(0, 200, 120).tolist()) | set(range(40, 90)))
    df = spark.createDataFrame([(k, i) for i in flags for k in ("r", None)], "recording string, frame long")
    brute = [(a, b) for a in flags if a - 1 not in flags for b in [next(c for c in range(a, 300) if c + 1 not in flags)]]
    for block in (1, 2, 16, 4096):
        got = runs(df, ["recording"], "frame", block).collect()
        assert sorted((r["first"], r["last"]) for r in got if r["recording"] == "r") == brute and len(got) == 2 * len(brute)


def test_batches_of_like_sizes_are_padded_little(spark):
    rng = np.random.default_rng(10)
    rows = [(0, int(h), 0, int(w)) for h, w in zip(rng.integers(1, 60, 400), np.exp(rng.normal(3, 1.5, 400)).astype(int) + 1, strict=True)] + [(0, 5, 0, 5000)]
    got = sp.size_batches(boxes(spark, rows), 20).groupBy("batch").agg(F.max(F.col("t_end") * 1.0).alias("w"), F.max("freq_end").alias("h"), F.sum(F.col("t_end") * F.col("freq_end")).alias("content"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in got) == len(rows)
    assert sum(r["n"] * r["w"] * r["h"] for r in got) < 2 * sum(r["content"] for r in got)
    image = np.arange(24.0).reshape(4, 6)
    small = sp.size_batches(boxes(spark, [(0, 2, 0, 2), (1, 3, 1, 3), (0, 4, 0, 6), (2, 2, 1, 5)]), 10)
    crops = {r["box_id"]: (r["height"], r["width"], np.array(r["crop"]).shape) for r in sp.standardize_pad(frames(spark, image), small, 1, ("batch",)).collect()}
    assert crops == {0: (2, 2, (2, 2)), 1: (2, 2, (2, 2)), 2: (4, 6, (4, 6))}


def test_runs_of_result_tables(spark, tmp_path):
    path = str(tmp_path / "m")
    first = sd.write_metrics(spark.range(3), path)
    sd.write_metrics(spark.range(2), path, "b/1")
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        sd.write_metrics(broken, path, "c")
    assert sd.read_metrics(spark, path, "id long").count() == 5
    for _ in range(2):
        sd.write_metrics(spark.range(5), path, "c")
    assert {r["run"]: r["count"] for r in sd.read_metrics(spark, path, "id long").groupBy("run").count().collect()} == {first: 3, "b/1": 2, "c": 5}


def test_islands_across_buckets(spark):
    rng = np.random.default_rng(4)
    rows = [("r", int(a), int(a + b)) for a, b in zip(rng.integers(0, 3000, 300), rng.integers(0, 30, 300), strict=True)] + [("s", 5, 2000), ("s", 100, 120), ("s", 2003, 2003), (None, 7, 8)]
    df = spark.createDataFrame(rows, "recording string, t_start long, t_end long")
    for gap in (0, 3):
        wide = {tuple(r) for r in time_islands(df, gap=gap, width=1 << 20).collect()}
        assert wide == {tuple(r) for r in time_islands(df, gap=gap, width=16).collect()}
        brute, end = {}, {}
        for k, a, b in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
            brute.setdefault(k, 0)
            if k not in end or a > end[k] + gap:
                brute[k] += 1
            end[k] = max(end.get(k, b), b)
            assert (k, a, b, brute[k]) in wide

"""Spectrograms from signal chunks, and work on their frames.

A frame is a row: recording, frame, mags (one value for each frequency bin). ``spec_meta`` has the two axes of each
recording. Work that needs neighbours in time goes by blocks of frames with a halo; nothing holds a whole recording.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.decibel import amplitude, decibel
from ..schemas import KEYS
from ..shared import stash
from .boxes import clip_bounds, clip_boxes
from .intervals import same


def spec_meta(recordings: DataFrame, n_fft: int = 512, hop: int = 256, start: float = 0.0) -> DataFrame:
    """``recordings``: recording, sample_rate, n_samples. Axes of their spectrograms; ``start``: first second."""
    rate = F.col("sample_rate").cast("double")
    return recordings.select(
        "recording", F.lit(float(start)).alias("t0"), (F.lit(float(hop)) / rate).alias("dt"), (1 + F.floor(F.col("n_samples") / hop)).cast("long").alias("n_time"), F.lit(0.0).alias("f0"), (rate / n_fft).alias("df"), F.lit(n_fft // 2 + 1).cast("long").alias("n_freq")
    )


def _nothing(columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def spectrogram(chunks: DataFrame, n_fft: int = 512, win_length: int | None = None, hop: int = 256, power: float = 1.0) -> DataFrame:
    """``chunks``: recording, n_samples, chunk_id, sample_start, samples (all chunks but the last of equal length, at
    least ``n_fft`` samples). Centred short-time Fourier magnitudes to ``power``: recording, frame, mags.

    A frame belongs to the chunk with its centre. Chunks hand the halves of a window at their ends to their
    neighbours; the signal is reflected at the two ends of the recording only. Recordings of at most n_fft / 2
    samples cannot be reflected and give no frames.
    """
    win_length = win_length or n_fft
    half = n_fft // 2
    part = lambda to, start, samples: F.struct(to.alias("to"), start.cast("long").alias("at"), samples.alias("part"))
    size = F.size("samples")
    pieces = F.array(
        part(F.col("chunk_id"), F.col("sample_start"), F.col("samples")),
        part(F.col("chunk_id") - 1, F.col("sample_start"), F.slice("samples", 1, half)),
        part(F.col("chunk_id") + 1, F.col("sample_start") + F.greatest(size - half, F.lit(0)), F.slice("samples", F.greatest(size - half + 1, F.lit(1)), half)),
    )
    pieces = F.filter(pieces, lambda p: (p["to"] >= 0) & ((p["to"] <= F.col("chunk_id")) | (F.col("sample_start") + size < F.col("n_samples"))))
    # a last chunk shorter than half a window is passed on with what it lacks by the chunk before it, whose frames
    # near its end need the samples anyway; frames centred in the last chunk reach back half a window at most
    dealt = chunks.filter((F.col("n_samples") > half) & (size > 0)).select("recording", "n_samples", F.col("chunk_id").alias("own"), F.explode(pieces).alias("p")).select("recording", "n_samples", "own", "p.*")

    def frames(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        core = pdf[pdf["own"] == pdf["to"]]
        if not len(core):
            return _nothing(["recording", "frame", "mags"])
        n = int(core["n_samples"].iloc[0])
        first, last = int(core["at"].iloc[0]), int(core["at"].iloc[0]) + len(core["part"].iloc[0])
        end_frame = n // hop
        f0 = -(-first // hop)
        f1 = end_frame if last >= n else min(end_frame, (last - 1) // hop)
        if f1 < f0:
            return _nothing(["recording", "frame", "mags"])
        base = int(pdf["at"].min())
        signal = np.zeros(int((pdf["at"] + pdf["part"].map(len)).max()) - base)
        for at, x in zip(pdf["at"], pdf["part"], strict=True):
            signal[at - base : at - base + len(x)] = x
        left, right = max(0, half - f0 * hop), max(0, f1 * hop + n_fft - half - n)
        padded = np.pad(signal, (left, right), mode="reflect") if left or right else signal
        out = kernels.stft(padded, f0 * hop - half - base + left, f1 - f0 + 1, n_fft, win_length, hop, power)
        return pd.DataFrame({"recording": key[0], "frame": np.arange(f0, f1 + 1), "mags": list(out)})

    return dealt.groupBy("recording", "to").applyInPandas(frames, "recording string, frame long, mags array<double>")


def signal_slice(chunks: DataFrame, start: float = 0.0, end: float = 1.0) -> DataFrame:
    """The samples from fraction ``start`` to ``end`` of each recording, as chunks of the same length."""
    if not 0 <= start < end <= 1:
        raise ValueError("0 <= start < end <= 1")
    lo, hi = F.floor(F.col("n_samples") * start), F.floor(F.col("n_samples") * end)
    a, b = F.greatest(lo, F.col("sample_start")), F.least(hi, F.col("sample_start") + F.size("samples"))
    cut = chunks.withColumns({"_lo": lo, "_n": hi - lo, "_a": a, "_b": b}).filter("_b > _a")
    lengths = chunks.groupBy("recording").agg(F.max(F.size("samples")).cast("long").alias("_len"))
    sliced = cut.join(lengths, "recording").withColumn("samples", F.slice("samples", (F.col("_a") - F.col("sample_start") + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int")))
    # pieces are dealt anew, so that all chunks but the last have the same length: a piece is in two of them at most
    at = sliced.withColumn("_at", F.col("_a") - F.col("_lo"))
    in_chunk = lambda v: F.floor(v / F.col("_len"))
    dealt = at.withColumn("chunk_id", F.explode(F.sequence(in_chunk(F.col("_at")), in_chunk(F.col("_at") + F.size("samples") - 1))))
    first = F.greatest(F.lit(0).cast("long"), F.col("chunk_id") * F.col("_len") - F.col("_at"))
    end = F.least(F.size("samples").cast("long"), (F.col("chunk_id") + 1) * F.col("_len") - F.col("_at"))
    pieces = dealt.select("recording", F.col("_n").alias("n_samples"), "_len", "chunk_id", F.struct((F.col("_at") + first).alias("at"), F.slice("samples", (first + 1).cast("int"), (end - first).cast("int")).alias("x")).alias("_piece"))
    back = F.flatten(F.transform(F.array_sort(F.collect_list("_piece")), lambda p: p["x"]))  # those of one chunk
    return pieces.groupBy("recording", "n_samples", "_len", "chunk_id").agg(back.alias("samples")).withColumn("sample_start", F.col("chunk_id") * F.col("_len")).drop("_len")


def signal_slice_spectrogram(chunks: DataFrame, recordings: DataFrame, start: float = 0.0, end: float = 1.0, n_fft: int = 512, win_length: int | None = None, hop: int = 256, power: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(frames, meta) of a part of each recording; times are shifted by its duration times ``start``."""
    frames = spectrogram(signal_slice(chunks, start, end), n_fft, win_length, hop, power)
    n = F.col("n_samples")
    part = recordings.withColumn("_shift", n / F.col("sample_rate") * start).withColumn("n_samples", F.floor(n * end) - F.floor(n * start))
    meta = spec_meta(part, n_fft, hop).join(part.select("recording", "_shift"), "recording").withColumn("t0", F.col("t0") + F.col("_shift")).drop("_shift")
    return frames, meta


def clip_spectrogram(frames: DataFrame, meta: DataFrame, t_start=None, t_end=None, freq_start=None, freq_end=None) -> tuple[DataFrame, DataFrame]:
    """(frames, meta) inside the bounds (seconds, Hz), half-open in pixels. A bound outside an axis is an error."""
    te, fe = F.col("t0") + F.col("dt") * (F.col("n_time") - 1), F.col("f0") + F.col("df") * (F.col("n_freq") - 1)
    wrong = F.lit(False)
    for v, lo, hi in ((t_start, "t0", te), (t_end, "t0", te), (freq_start, "f0", fe), (freq_end, "f0", fe)):
        if v is not None:
            wrong = wrong | ~F.lit(float(v)).between(F.col(lo), hi)
    bounds = meta.withColumns(clip_bounds(t_start, t_end, freq_start, freq_end)).withColumn("t_lo", F.when(wrong, F.raise_error(F.lit("a bound lies outside the spectrogram")).cast("long")).otherwise(F.col("t_lo")))
    cut = frames.join(bounds.select("recording", "t_lo", "t_hi", "f_lo", "f_hi"), "recording").filter("frame >= t_lo and frame < t_hi").select("recording", (F.col("frame") - F.col("t_lo")).alias("frame"), F.slice("mags", (F.col("f_lo") + 1).cast("int"), (F.col("f_hi") - F.col("f_lo")).cast("int")).alias("mags"))
    new = bounds.select(
        "recording", (F.col("t0") + F.col("t_lo") * F.col("dt")).alias("t0"), "dt", (F.least("t_hi", "n_time") - F.col("t_lo")).alias("n_time"), (F.col("f0") + F.col("f_lo") * F.col("df")).alias("f0"), "df", (F.least("f_hi", "n_freq") - F.col("f_lo")).alias("n_freq")
    )
    return cut, new


def clip_spec_and_boxes(frames: DataFrame, meta: DataFrame, boxes: DataFrame, t_start=None, t_end=None, freq_start=None, freq_end=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, meta, boxes): boxes are clipped by the first and last values of the clipped axes, which may be a pixel
    off the bounds. Several sets of boxes at once: a set column, which stays."""
    cut, new = clip_spectrogram(frames, meta, t_start, t_end, freq_start, freq_end)
    px = lambda v, origin, step, n: F.ceil((v - F.col(origin)) / ((F.col(step) * (F.col(n) - 1)) / F.col(n))).cast("long")
    ends = new.select("recording", F.col("t0").alias("c0"), (F.col("t0") + (F.col("n_time") - 1) * F.col("dt")).alias("c1"), F.col("f0").alias("g0"), (F.col("f0") + (F.col("n_freq") - 1) * F.col("df")).alias("g1"))
    rows = boxes.join(meta.join(ends, "recording"), "recording").withColumns({"t_lo": px(F.col("c0"), "t0", "dt", "n_time"), "t_hi": px(F.col("c1"), "t0", "dt", "n_time"), "f_lo": px(F.col("g0"), "f0", "df", "n_freq"), "f_hi": px(F.col("g1"), "f0", "df", "n_freq")})
    inside = rows.filter("t_end > t_lo and t_start < t_hi and freq_end > f_lo and freq_start < f_hi")
    own = lambda c, lo, hi: (F.least(F.greatest(F.col(c), F.col(lo)), F.col(hi)) - F.col(lo)).alias(c)
    other = [c for c in boxes.columns if c not in ("t_start", "t_end", "freq_start", "freq_end")]
    return cut, new, inside.select(*other, own("freq_start", "f_lo", "f_hi"), own("freq_end", "f_lo", "f_hi"), own("t_start", "t_lo", "t_hi"), own("t_end", "t_lo", "t_hi"))


def train_test_split_by_time(boxes: DataFrame, meta: DataFrame, train_time: float) -> DataFrame:
    """Boxes of both parts, with ``part``: train is up to ``train_time`` seconds, test from there."""
    train = clip_boxes(boxes, meta, t_end=train_time).withColumn("part", F.lit("train"))
    return train.unionByName(clip_boxes(boxes, meta, t_start=train_time).withColumn("part", F.lit("test")))


def spec_geometry(meta: DataFrame) -> DataFrame:
    """Height, width, ends, spans and pixel spans."""
    t, f = F.col("dt") * (F.col("n_time") - 1), F.col("df") * (F.col("n_freq") - 1)
    return meta.select(
        "recording", F.col("n_freq").alias("height"), F.col("n_time").alias("width"), F.col("t0").alias("t_first"), (F.col("t0") + t).alias("t_last"), t.alias("t_span"), (t / F.col("n_time")).alias("t_pixel"), F.col("f0").alias("f_first"), (F.col("f0") + f).alias("f_last"), f.alias("f_span"), (f / F.col("n_freq")).alias("f_pixel")
    )


def preprocess_spectrogram(frames: DataFrame, meta: DataFrame, log_base: float | None = None, min_freq: float | None = 18_000.0, gamma: float = 1.0) -> DataFrame:
    """Adds ``freq_offset``, the bins dropped below ``min_freq``; values are logged (zeros as 1e-8), then raised to
    ``gamma``."""
    keep = lambda i: F.col("f0") + i * F.col("df") >= F.lit(float(min_freq))
    rows = frames.join(meta.select("recording", "f0", "df", "n_freq"), "recording")
    x = F.col("mags")
    if log_base is not None:
        base = F.lit(float(log_base))
        x = F.transform(x, lambda v: F.ln(F.when(v == 0, F.lit(1e-8)).otherwise(v)) / F.ln(base))
    offset = F.lit(0)
    if min_freq is not None:
        offset = F.size(F.filter("mags", lambda v, i: ~keep(i)))
        x = F.filter(x, lambda v, i: keep(i))
    return rows.select("recording", "frame", offset.cast("long").alias("freq_offset"), (F.transform(x, lambda v: F.pow(v, F.lit(float(gamma)))) if gamma != 1.0 else x).alias("mags"))


def chunk_starts(meta: DataFrame, duration: float | int, overlap: float | int) -> DataFrame:
    """recording, chunk_id, first, last: windows of ``duration`` (seconds or frames); ``overlap`` is a share of it
    (float) or frames (int). A window that ends exactly at the end, and the tail, are not emitted."""
    length = F.ceil(F.lit(duration) / F.col("dt")).cast("long") if isinstance(duration, float) else F.lit(duration).cast("long")
    step = F.floor(F.lit(1.0 - overlap) * F.col("_len")).cast("long") if isinstance(overlap, float) else (F.col("_len") - overlap).cast("long")
    rows = meta.withColumn("_len", length).withColumn("_step", step).filter("n_time > _len")
    return rows.select("recording", "_len", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n_time") - F.col("_len") - 1, F.col("_step"))).alias("chunk_id", "first")).select("recording", F.col("chunk_id").cast("long").alias("chunk_id"), "first", (F.col("first") + F.col("_len") - 1).alias("last"))


def frames_in(frames: DataFrame, spans: DataFrame, keys: Sequence[str] = KEYS, width: int = 256) -> DataFrame:
    """Frames joined with spans (first, last; inclusive) by buckets of time, an equality join."""
    spread = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    return frames.withColumn("_bucket", F.floor(F.col("frame") / width)).join(spread, [*keys, "_bucket"]).filter("frame between first and last").drop("_bucket")


def sliding_chunks(frames: DataFrame, meta: DataFrame, duration: float | int, overlap: float | int) -> DataFrame:
    """Frames of each window: recording, chunk_id, first, frame, mags."""
    return frames_in(frames, chunk_starts(meta, duration, overlap)).select("recording", "chunk_id", "first", "frame", "mags")


def size_batches(boxes: DataFrame, batch_size: int) -> DataFrame:
    """Adds ``batch``: about ``batch_size`` boxes of one class of sizes, in which sides differ by less than the square
    root of 2, so that padding to the largest never doubles a batch. A class with more boxes is dealt by hash."""
    rows = boxes.filter("t_end > t_start and freq_end > freq_start")
    side = lambda a, b: F.length(F.bin((F.col(b) - F.col(a)) * (F.col(b) - F.col(a)))) - 1  # noqa: E731  (twice the logarithm, exactly)
    own = ["_w", "_h"]
    classed = rows.withColumns({"_w": side("t_start", "t_end"), "_h": side("freq_start", "freq_end")})
    classes = stash(classed.groupBy(*own).agg(F.ceil(F.count(F.lit(1)) / batch_size).alias("_parts")))  # 128 * 128 rows at most
    batch = F.concat_ws("-", "_w", "_h", F.pmod(F.xxhash64("recording", "box_id"), F.col("_parts")))
    return classed.join(classes, own).withColumn("batch", batch).drop(*own, "_parts")


def standardize_pad(frames: DataFrame, boxes: DataFrame, least: int = 32, batch_keys: Sequence[str] = ()) -> DataFrame:
    """``boxes``: recording, box_id, half-open ends. Crops as (value - mean) / std, padded with zeros to the largest
    crop of the batch and ``least`` on each side: recording, box_id, height, width, ``crop`` [frequency x time]. Without
    ``batch_keys`` the table is one batch, as a small set is shown at once; ``size_batches`` makes batches of like sizes."""
    spans = boxes.filter("t_end > t_start and freq_end > freq_start").select("recording", "box_id", *batch_keys, F.col("t_start").alias("first"), (F.col("t_end") - 1).alias("last"), "freq_start", "freq_end")
    part = frames_in(frames, spans).select("recording", "box_id", *batch_keys, "frame", F.slice("mags", (F.col("freq_start") + 1).cast("int"), (F.col("freq_end") - F.col("freq_start")).cast("int")).alias("m"))
    crops = part.groupBy("recording", "box_id", *batch_keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "m"))), lambda x: x["m"]).alias("c"))  # frames of one box
    sizes = crops.groupBy(*batch_keys).agg(F.greatest(F.max(F.size("c")), F.lit(least)).alias("width"), F.greatest(F.max(F.size(F.col("c")[0])), F.lit(least)).alias("height"))
    joined = crops.join(sizes, list(batch_keys)) if batch_keys else crops.join(F.broadcast(sizes))  # one row

    def scale(it):
        for pdf in it:
            out = []
            for c, w, h in zip(pdf["c"], pdf["width"], pdf["height"], strict=True):
                x = np.array([np.asarray(r) for r in c]).T
                s = x.std()
                x = (x - x.mean()) / s if s > 0 else np.zeros_like(x)
                out.append([list(r) for r in np.pad(x, ((0, h - x.shape[0]), (0, w - x.shape[1])))])
            yield pdf[["recording", "box_id", *batch_keys, "height", "width"]].assign(crop=out)

    kinds = ", ".join(f"{k} {boxes.schema[k].dataType.simpleString()}" for k in ("recording", "box_id", *batch_keys))
    return joined.mapInPandas(scale, f"{kinds}, height int, width int, crop array<array<double>>")


def cells(frames: DataFrame, value: str = "mag") -> DataFrame:
    """recording, frame, bin, value. For aggregations that have no array form."""
    return frames.select("recording", "frame", F.posexplode("mags").alias("bin", value))


def exact_percentile(values: DataFrame, keys: Sequence[str], value: str, share: float, name: str, accuracy: int = 1000) -> DataFrame:
    """keys and the exact quantile (linear between neighbours, nulls left out) of each group, however large it is and
    however its values are spread.

    A mergeable summary (``approx_percentile``, wrong by a share of 1 / ``accuracy`` of the ranks at most) brackets the
    wanted ranks. One aggregation then counts what lies below, inside (about 4 / ``accuracy`` of the values, equal ones as
    one row) and above, which proves the bracket or, for a group where it doesn't hold, has all its values counted instead.
    """
    rows = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    lo, hi = max(0.0, share - 2.0 / accuracy), min(1.0, share + 2.0 / accuracy)
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"), F.percentile_approx("_x", [lo, hi], accuracy).alias("_b"))
    low = F.when(F.lit(lo == 0.0), F.col("_least")).otherwise(F.col("_b")[0])
    high = F.when(F.lit(hi == 1.0), F.col("_most")).otherwise(F.col("_b")[1])
    ends = ends.select(*keys, "_n", low.alias("_low"), high.alias("_high"))
    place = F.lit(float(share)) * (F.col("_n") - 1)

    def counts(zone: Column, dealt: DataFrame) -> DataFrame:
        """Rows of each value inside the bracket, of one value below it and of one above."""
        return dealt.withColumn("_zone", zone).groupBy(*keys, "_zone", F.when(F.col("_zone") == 1, F.col("_x")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))

    def found(table: DataFrame) -> DataFrame:
        before = F.coalesce(F.sum("_c").over(W.partitionBy(*keys).orderBy("_zone", "_v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        holds = lambda rank: F.max(F.when((F.col("_zone") == 1) & (F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_c")), F.col("_v")))
        return table.withColumn("_first", before).groupBy(*keys).agg(holds(F.floor(place)).alias("_lo"), holds(F.ceil(place)).alias("_hi"), F.first(place - F.floor(place)).alias("_w"))

    dealt = same(rows, ends, keys)
    first = stash(found(counts(F.when(F.col("_x") < F.col("_low"), 0).when(F.col("_x") > F.col("_high"), 2).otherwise(1), dealt)))
    missed = first.filter("_lo IS NULL OR _hi IS NULL").select(*keys)
    out = first.filter("_lo IS NOT NULL AND _hi IS NOT NULL")
    if not missed.isEmpty():
        out = out.unionByName(found(counts(F.lit(1), same(dealt, missed, keys, "left_semi"))))
    return out.select(*keys, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((1 - F.col("_w")) * F.col("_lo") + F.col("_w") * F.col("_hi")).alias(name))


def display_range(frames: DataFrame) -> DataFrame:
    """Colour bounds: 10 to the 1 % quantile of log10 (zeros left out), and the largest value."""
    logs = cells(frames).select("recording", F.log10(F.when(F.col("mag") > 0, F.col("mag"))).alias("_log"))
    high = frames.groupBy("recording").agg(F.max(F.array_max("mags")).alias("high"))
    low = exact_percentile(logs, ("recording",), "_log", 0.01, "_q").select("recording", F.pow(F.lit(10.0), "_q").alias("low"))
    return same(high, low, ("recording",), "left").select("recording", "low", "high")


def amplitude_to_db(frames: DataFrame, ref: float = 1.0, amin: float = 1e-5, top_db: float | None = 80.0) -> DataFrame:
    """Decibels, no lower than ``top_db`` under the largest value of the recording."""
    db = frames.withColumn("mags", F.transform("mags", lambda x: decibel(x, ref, amin)))
    if top_db is None:
        return db
    most = db.groupBy("recording").agg(F.max(F.array_max("mags")).alias("_most"))
    return db.join(most, "recording").withColumn("mags", F.transform("mags", lambda x: F.greatest(x, F.col("_most") - F.lit(float(top_db))))).drop("_most")


def db_to_amplitude(frames: DataFrame, ref: float = 1.0) -> DataFrame:
    return frames.withColumn("mags", F.transform("mags", lambda x: amplitude(x, ref)))


def with_halo(frames: DataFrame, radius: int, fn: Callable[[np.ndarray, int, int, int], np.ndarray], block: int = 2048, keys: Sequence[str] = KEYS, extra: dict[str, str] | None = None) -> DataFrame:
    """Applies ``fn`` to blocks of frames with ``radius`` frames of halo.

    ``fn(matrix [frequency x time], left, right, ...)`` gets the frames of the block and of the halo that exist (``left``
    and ``right`` of them), and returns a matrix for the block's own frames. At the ends of a recording there is less
    halo. A block goes to one task; a recording to as many as it has blocks. ``extra``: columns whose value, the same in
    a block, is handed to ``fn`` by name.
    """
    extra = extra or {}
    first, last = F.floor((F.col("frame") - radius) / block), F.floor((F.col("frame") + radius) / block)
    dealt = frames.withColumn("_block", F.explode(F.sequence(first, last)))
    own = [*keys, *extra, "_block"]
    kinds = {k: frames.schema[k].dataType.simpleString() for k in (*keys, *extra)}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        at = pdf["frame"].to_numpy()
        lo, hi = int(key[-1]) * block, (int(key[-1]) + 1) * block
        core = (at >= lo) & (at < hi)
        if not core.any():
            return _nothing([*kinds, "frame", "mags"])
        m = np.array([np.asarray(x, float) for x in pdf["mags"]]).T
        out = fn(m, int((at < lo).sum()), int((at >= hi).sum()), **dict(zip(extra, key[len(keys) : len(keys) + len(extra)], strict=True)))
        return pd.DataFrame({**dict(zip(kinds, key, strict=False)), "frame": at[core], "mags": list(out.T)})

    schema = ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", frame long, mags array<double>"
    return dealt.groupBy(*own).applyInPandas(run, schema)


def scaled(frames: DataFrame, column: Column) -> DataFrame:
    return frames.withColumn("mags", F.transform("mags", lambda x: x * column))

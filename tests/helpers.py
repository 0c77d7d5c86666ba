from __future__ import annotations

import random

BOX = "recording string, box_id long, freq_start long, freq_end long, t_start long, t_end long, label string, score double"
META = "recording string, t0 double, dt double, n_time long, f0 double, df double, n_freq long"


def boxes(spark, rows, recording="r"):
    """rows: (freq_start, freq_end, t_start, t_end, label)."""
    return spark.createDataFrame([(recording, i, *map(int, r[:4]), r[4] if len(r) > 4 else None, 1.0) for i, r in enumerate(rows)], BOX)


def random_boxes(seed, n, t=60, f=30, length=8):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = rng.randrange(t), rng.randrange(f)
        out.append((b, b + rng.randrange(length), a, a + rng.randrange(length), rng.choice(["x", "y", None])))
    return out


def pixels(rows):
    return {(t, f) for r in rows for t in range(r[2], r[3] + 1) for f in range(r[0], r[1] + 1)}


def frames(spark, matrix, recording="r"):
    """matrix [frequency x time]."""
    return spark.createDataFrame([(recording, t, [float(x) for x in matrix[:, t]]) for t in range(matrix.shape[1])], "recording string, frame long, mags array<double>")


def matrix(df, recording="r"):
    import numpy as np

    rows = sorted((r["frame"], r["mags"]) for r in df.filter(df.recording == recording).collect())
    return np.array([m for _, m in rows]).T


def meta(spark, n_time, n_freq, dt=1.0, df=1000.0, recording="r"):
    return spark.createDataFrame([(recording, 0.0, float(dt), n_time, 0.0, float(df), n_freq)], META)

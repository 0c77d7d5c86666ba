"""Files: byte ranges of recordings, headers of annotation tables, noise spans."""

import io
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from ultraspan.sources import annotations as sa
from ultraspan.sources import audio
from ultraspan.sources import detections as sd


def wav_file(x, width, rate=1000):
    """x: whole numbers [frames x channels]."""
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        flat = x.ravel()
        w.writeframes((flat + 128).astype(np.uint8).tobytes() if width == 1 else flat.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
    return buffer.getvalue()


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_byte_ranges_give_every_chunk_once(tmp_path, width):
    rng = np.random.default_rng(width)
    top = 1 << (8 * width - 1)
    x = rng.integers(-top, top, (1003, 2))
    path = tmp_path / "a.wav"
    path.write_bytes(wav_file(x, width))
    size = path.stat().st_size
    for chunk, step in ((1, 64), (7, 100), (64, 33), (2000, 500)):
        for channel in (0, 1):
            rows = [r for at in range(0, size, step) for r in audio.read_range(str(path), at, step, channel, chunk)]
            assert [r[4] for r in rows] == list(range(-(-1003 // chunk))) and [r[5] for r in rows] == [k * chunk for k in range(len(rows))]
            np.testing.assert_array_equal(np.concatenate([r[6] for r in rows]), (x[:, channel] / top).astype(np.float32))
    rate, whole = audio.parse_wav(path.read_bytes())
    assert rate == 1000 and (whole == x / top).all()


def test_headers(tmp_path):
    x = np.arange(-5, 5)[:, None]
    plain = audio.wav_bytes(x, 8000)
    assert plain == wav_file(x, 2, 8000)
    other = plain[:12] + b"junk" + (3).to_bytes(4, "little") + b"abc\0" + plain[12:36] + b"LIST" + (4).to_bytes(4, "little") + b"INFO" + plain[36:]
    header = audio.read_header(io.BytesIO(other), len(other))
    assert (header.rate, header.frames, header.start) == (8000, 10, 44 + 12 + 12)
    for size in (0, 0xFFFFFFFF):  # a stream that was never closed
        opened = plain[:40] + size.to_bytes(4, "little") + plain[44:]
        assert audio.read_header(io.BytesIO(opened), len(opened)).frames == 10
    assert audio.read_header(io.BytesIO(plain[:-5]), len(plain) - 5).frames == 7  # cut off
    ds64 = b"ds64" + (28).to_bytes(4, "little") + (0).to_bytes(8, "little") + (20).to_bytes(8, "little") + bytes(12)
    long = b"RF64" + plain[4:12] + ds64 + plain[12:40] + b"\xff" * 4 + plain[44:]
    assert audio.read_header(io.BytesIO(long), len(long)).frames == 10
    floats = plain[:20] + (3).to_bytes(2, "little") + plain[22:34] + (32).to_bytes(2, "little") + plain[36:44] + np.array([0.5, -0.25], "<f4").tobytes()
    assert audio.parse_wav(floats)[1].shape[1] == 1
    for bad in (b"", b"RIFF1234WAVE", plain[:36], plain[:20] + (7).to_bytes(2, "little") + plain[22:]):
        with pytest.raises(ValueError):
            audio.read_header(io.BytesIO(bad), len(bad))


def test_file_above_two_gibibytes(spark, tmp_path):
    """Sparse: only ranges near its ends are read."""
    frames = (5 << 30) // 4
    head = bytearray(audio.wav_bytes(np.zeros((0, 2)), 250_000))
    head[40:44] = (frames * 4).to_bytes(5, "little")[:4] if frames * 4 < 1 << 32 else b"\xff" * 4
    with open(tmp_path / "long.wav", "wb") as f:
        f.write(head)
        f.seek(44 + frames * 4 - 8)
        f.write(np.array([1, 2, 16384, -8192], "<i2").tobytes())
    recordings, _ = audio.read_recordings(spark, str(tmp_path))
    row = recordings.first()
    assert (row["n_samples"], row["duration"]) == (frames, frames / 250_000)
    reader = audio.WavReader({"path": str(tmp_path), "chunk": "1000", "range": str(1 << 20)})
    parts = reader.partitions()
    assert len(parts) == -(-(44 + frames * 4) // (1 << 20)) and sum(p.length for p in parts) == 44 + frames * 4
    last = [b for p in parts[-2:] for b in reader.read(p)][-1].to_pylist()[0]
    assert last["sample_start"] + len(last["samples"]) == frames and last["samples"][-2:] == [2 ** -15, 0.5]
    chunks = [b.column("chunk_id")[0].as_py() for p in parts[2040:2060] for b in reader.read(p)]
    assert chunks == list(range(chunks[0], chunks[0] + len(chunks)))


def test_read_recordings(spark, tmp_path):
    rng = np.random.default_rng(1)
    signals = {f"box {k % 2}/r{k}.wav": rng.integers(-99, 99, (n, 1)) for k, n in enumerate((0, 1, 500, 1300))}
    for name, x in signals.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(wav_file(x, 2))
    (tmp_path / "in" / "box 1" / "notes.txt").write_text("x")
    recordings, chunks = audio.read_recordings(spark, str(tmp_path / "in"), chunk=64, range_bytes=300)
    assert chunks.rdd.getNumPartitions() > 8
    assert {(r["recording"], r["folder"], r["name"], r["n_samples"], r["duration"]) for r in recordings.collect()} == {(k, *k.split("/"), len(x), len(x) / 1000) for k, x in signals.items()}
    for r in audio.recordings_of(chunks).collect():
        assert r["n_samples"] == len(signals[r["recording"]])
    for k, x in signals.items():
        got = [v for r in chunks.filter(F.col("recording") == k).orderBy("chunk_id").collect() for v in r["samples"]]
        assert got == (x[:, 0] / 32768).tolist()
    some = audio.read_recordings(spark, [str(tmp_path / "in" / "box 1"), f"{tmp_path}/in/*/r2.wav", f"file:{tmp_path}/in/box 0/r0.wav"])[0]
    assert {r["name"] for r in some.collect()} == {"r0.wav", "r1.wav", "r2.wav", "r3.wav"}
    with pytest.raises(Exception, match="nowhere"):
        audio.read_recordings(spark, str(tmp_path / "nowhere"))[0].collect()
    (tmp_path / "none").mkdir()
    assert [x.count() for x in audio.read_recordings(spark, str(tmp_path / "none"))] == [0, 0]


def test_many_short_files_share_tasks(tmp_path):
    x = np.arange(70)[:, None]
    for k in range(3000):
        (tmp_path / f"r{k}.wav").write_bytes(audio.wav_bytes(x + k, 16))
    reader = audio.WavReader({"path": str(tmp_path), "chunk": "16", "range": "100"})
    parts = reader.partitions()
    assert 200 < len(parts) < 300 and sum(p.length for p in parts) == 3000 * 184
    read = [list(reader.read(p)) for p in parts]
    assert sum(map(len, read)) < 2000  # not a batch for each chunk
    rows = [r for batches in read for b in batches for r in b.to_pylist()]
    assert len(rows) == 3000 * 5
    for r in rows[:: 7]:
        assert r["samples"] == ((x[16 * r["chunk_id"] :, 0][:16] + int(r["name"][1:-4])) / 32768).tolist()


def test_annotations_by_each_files_own_header(spark, tmp_path):
    rng = random.Random(1)
    parse = {"int": int, "double": float, "string": str}
    expected = []
    for k in range(8):
        folder = tmp_path / f"box {k}+é"
        folder.mkdir()
        names = rng.sample(list(sa.COLUMNS), rng.randrange(6, 14))
        if k % 3 == 1:
            names = ["NOTE" if n == "USV TYPE" else n for n in names]
        if k == 2:
            names = ["NOTE", *[n for n in names if n != "USV TYPE"], "USV TYPE"]
        if k == 5:
            names.insert(1, "comment")
        lines = []
        for i in range(5):
            value = {"USV TYPE": f"Fm {i}", "NOTE": "22-kHz Call", "Begin File": '"a b.wav"', "View": ""}
            row = [value.get(n, str(i + k) if n in ("Selection", "Channel") else str(rng.randrange(999) / 4)) for n in names]
            of = dict(zip(names, row, strict=True))
            lines.append("\t".join(row[: len(row) - (i == 4 and len(row) > 6)]))  # one line is short
            if i == 4 and len(row) > 6:
                del of[names[-1]]
            label = of.get("USV TYPE") if "USV TYPE" in names else of.get("NOTE")
            record = [folder.name]
            for header, (own, kind) in sa.COLUMNS.items():
                v = label if own == "usv_type" else of.get(header)
                record.append((v or "nan").lower().replace("22-khz call", "22-khz") if own == "usv_type" else parse[kind](v.strip('"')) if v else None)
            expected.append(tuple(record))
        head = "\t".join(n.replace(" ", "_") if k == 3 else n for n in names)
        (folder / "notes.txt").write_text("\n".join([("﻿" if k == 4 else "") + head, *lines, "", *([head] if k == 6 else [])]) + "\n", encoding="utf-8")
    got = sorted(map(tuple, sa.read_annotations(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(expected, key=str)


def test_noise_spans_round_trip(spark, tmp_path):
    rows = [(f"r/{i % 3} +", f"c{i}", i / 2, i / 2 + 1) for i in range(9)]
    spans = spark.createDataFrame(rows, "recording string, config_id string, start double, end double")
    for _ in range(2):
        sd.write_noise_spans(spans, str(tmp_path / "s"))
    sd.write_noise_spans(spans.filter("recording = 'r/1 +'"), str(tmp_path / "s"))
    assert sorted(map(tuple, sd.read_noise_spans(spark, str(tmp_path / "s")).collect())) == sorted(rows)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_detections_of_many_recordings(spark, tmp_path, fmt):
    """Files go by the size of a batch, not by its recordings; the newest batch of a pair counts."""
    path = str(tmp_path / "found")
    rows = lambda score, ids: spark.createDataFrame([(f"r{i}", f"c{i % 2}", b, 1, 2, 3, 4, "x", score) for i in ids for b in range(2)], "recording string, config_id string, box_id long, freq_start long, freq_end long, t_start long, t_end long, label string, score double")
    grid = spark.createDataFrame([(f"r{i}", 0.0, 2.0, 9, 0.0, 1.0, 9) for i in range(200)], "recording string, t0 double, dt double, n_time long, f0 double, df double, n_freq long")
    for score, ids in ((1.0, range(200)), (2.0, range(50, 60)), (3.0, range(55, 57))):
        sd.write_detections(rows(score, ids), grid, path, fmt)
    got = {(r["recording"], r["box_id"]): (r["config_id"], r["score"], r["time_start"], r["time_end"], r["freq_start"], r["label"]) for r in sd.read_detections(spark, path, fmt).collect()}
    assert got == {(f"r{i}", b): (f"c{i % 2}", 3.0 if 55 <= i < 57 else 2.0 if 50 <= i < 60 else 1.0, 6.0, 8.0, 1.0, "x") for i in range(200) for b in range(2)}
    assert sd.read_detections(spark, path, fmt).count() == 400
    assert len([f for f in (tmp_path / "found").rglob("*") if f.is_file() and f.name.startswith("part-")]) < 30

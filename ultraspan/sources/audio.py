"""WAV recordings as chunks of samples, read by byte ranges. PCM (8, 16, 24, 32 bits) and IEEE float, RIFF and RF64.

``wav`` is a Spark data source (``register(spark)``, then ``spark.read.format("wav").load(path)``). A file is cut into
ranges of bytes by its length alone; a task reads the header, then the chunks of samples that begin in its range, one at
a time. So a file of any length is many tasks, and a task holds one chunk, or short ones of about 1024 samples in all;
short ranges share a task. With the option ``headers`` only headers are
read, many files to a task. Files are opened by pyarrow's file systems (local paths, ``file:``, ``hdfs:``, ``s3:``,
``gs:``, ...), on the driver for the list and in the tasks for the bytes.
"""

from __future__ import annotations

import fnmatch
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import RECORDINGS, SIGNAL_CHUNKS

#: Samples in a chunk: 8 MB as doubles.
CHUNK = 1 << 20
#: Bytes of a file in a range; headers in a task.
RANGE, HEADERS = 64 << 20, 256
#: Short ranges share a task up to so many bytes (or those of a range, if more), with so many for opening a file, as long
#: as there are so many tasks.
SHARED, OPENING, TASKS = 1 << 20, 4 << 10, 256
#: Samples in a batch of short chunks.
BATCH = 1024
#: Sizes that a header gives when the real one isn't in it.
UNKNOWN = (0, 0xFFFFFFFF)


@dataclass(frozen=True)
class Header:
    """``start``: first byte of the samples; ``frames``: samples of each channel."""

    rate: int
    channels: int
    kind: int
    bits: int
    start: int
    frames: int

    @property
    def step(self) -> int:
        """Bytes of a sample of all channels."""
        return self.channels * self.bits // 8


def read_header(f: BinaryIO, size: int) -> Header:
    """Walks the chunks of a file of ``size`` bytes by their lengths; samples are not read. Data that the file ends
    before are left out."""
    top = f.read(12)
    if top[:4] not in (b"RIFF", b"RF64") or top[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form, large, data = 12, None, None, None
    while at + 8 <= size and (form is None or data is None):
        f.seek(at)
        head = f.read(8)
        name, length = head[:4], int.from_bytes(head[4:8], "little")
        if name == b"fmt ":
            form = f.read(min(length, 40))
        elif name == b"ds64":
            large = int.from_bytes(f.read(16)[8:16], "little")
        elif name == b"data":
            length = large if large is not None and length == 0xFFFFFFFF else size - at - 8 if length in UNKNOWN else length
            data = (at + 8, min(length, size - at - 8))
        at += 8 + length + length % 2
    if form is None or data is None:
        raise ValueError("no fmt or data chunk")
    kind, channels, rate, bits = (int.from_bytes(form[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (14, 16)))
    if kind == 0xFFFE:  # extensible: the format is the start of the subformat
        kind = int.from_bytes(form[24:26], "little")
    if (kind, bits) not in {(3, 32), (3, 64), (1, 8), (1, 16), (1, 24), (1, 32)} or not channels:
        raise ValueError(f"format {kind} with {bits} bits is not read")
    return Header(rate, channels, kind, bits, data[0], data[1] // (channels * bits // 8))


def samples_of(body: bytes, header: Header) -> np.ndarray:
    """[samples x channels] in -1..1."""
    if header.kind == 3:
        x = np.frombuffer(body, f"<f{header.bits // 8}").astype(np.float64)
    elif header.bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
    elif header.bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(body, f"<i{header.bits // 8}") / float(1 << (header.bits - 1))
    return x.reshape(-1, header.channels)


def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, samples [frames x channels] in -1..1) of a small file in memory."""
    header = read_header(io.BytesIO(data), len(data))
    return header.rate, samples_of(data[header.start : header.start + header.frames * header.step], header)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. Blanks in a URI may stand as they are, as Spark gives them."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path):
        return fs.FileSystem.from_uri(quote(path, safe=":/?&=%@+,~"))
    return fs.LocalFileSystem(), path


def _names(path: str) -> tuple[str, str]:
    folder, name = ["", *path.rstrip("/").split("/")][-2:]
    return folder, name


def read_range(path: str, offset: int, length: int, channel: int = 0, chunk: int = CHUNK) -> Iterator[tuple]:
    """The chunks whose first byte lies in the range, as rows of ``SIGNAL_CHUNKS``; the first range of a file without
    samples gives one empty chunk."""
    system, place = _opened(path)
    with system.open_input_file(place) as f:
        header = read_header(f, f.size())
        folder, name = _names(path)
        row = lambda k, x: (folder, name, header.rate, header.frames, k, k * chunk, x)
        width = chunk * header.step
        first = max(0, -(-(offset - header.start) // width))
        if offset == 0 and not header.frames:
            yield row(0, np.zeros(0, np.float32))
        k = first
        while k * chunk < header.frames and header.start + k * width < offset + length:
            f.seek(header.start + k * width)
            x = samples_of(f.read(min(width, header.frames * header.step - k * width)), header)
            yield row(k, x[:, min(channel, header.channels - 1)].astype(np.float32))
            k += 1


def list_wav(paths: list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of the files ending in ``wav`` under the paths, sorted. A path is a file, a folder, or a pattern."""
    out = {}
    for path in paths:
        system, place = _opened(path)
        scheme = path[: path.index(":") + 1] + "//" if not isinstance(system, fs.LocalFileSystem) else ""
        host = re.match(r"[^:]*://([^/]*)", path).group(1) if scheme in ("hdfs://", "viewfs://") else ""
        wild = re.search(r"[*?\[]", place)
        base = place[: wild.start()].rsplit("/", 1)[0] or "/" if wild else place
        info = system.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
        for f in files:
            inside = not wild or fnmatch.fnmatch(f.path, place) or fnmatch.fnmatch(f.path, place.rstrip("/") + "/*")
            if f.type == fs.FileType.File and f.path.endswith("wav") and inside:
                out[f"{scheme}{host}{f.path}"] = f.size
    return sorted(out.items())


@dataclass
class WavRanges(InputPartition):
    """Ranges (path, offset, length)."""

    ranges: list[tuple[str, int, int]]

    @property
    def length(self) -> int:
        return sum(n for _, _, n in self.ranges)


def share_tasks(ranges: list[tuple[str, int, int]], step: int) -> list[WavRanges]:
    """The ranges dealt out to tasks, in order."""
    weights = [n + OPENING for _, _, n in ranges]
    most = min(max(step, SHARED), max(sum(weights) // TASKS, max(weights, default=0)))
    out, full = [WavRanges([])], 0
    for one, weight in zip(ranges, weights, strict=True):
        if full and full + weight > most:
            out.append(WavRanges([]))
            full = 0
        out[-1].ranges.append(one)
        full += weight
    return out


@dataclass
class WavHeaders(InputPartition):
    paths: list[str]


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        paths = options.get("paths")
        self.paths = json.loads(paths) if paths else [options["path"]]
        self.headers = options.get("headers", "false").lower() == "true"
        self.channel, self.chunk, self.range = int(options.get("channel", 0)), int(options.get("chunk", CHUNK)), int(options.get("range", RANGE))

    def partitions(self) -> list[InputPartition]:
        files = list_wav(self.paths)
        if self.headers:
            names = [p for p, _ in files]
            out = [WavHeaders(names[i : i + HEADERS]) for i in range(0, len(names), HEADERS)]
            return out or [WavHeaders([])]
        return share_tasks([(p, at, min(self.range, size - at)) for p, size in files for at in range(0, max(size, 1), self.range)], self.range)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, WavHeaders):
            rows = []
            for path in partition.paths:
                system, place = _opened(path)
                with system.open_input_file(place) as f:
                    h = read_header(f, f.size())
                rows.append((*_names(path), h.rate, h.frames, h.frames / h.rate if h.rate else None))
            if rows:
                yield _batch(rows, _HEADER_TYPES)
        else:
            yield from _batches(row for path, at, n in partition.ranges for row in read_range(path, at, n, self.channel, self.chunk))


_HEADER_TYPES = {"folder": pa.string(), "name": pa.string(), "sample_rate": pa.int32(), "n_samples": pa.int64(), "duration": pa.float64()}
_CHUNK_TYPES = {"folder": pa.string(), "name": pa.string(), "sample_rate": pa.int32(), "n_samples": pa.int64(), "chunk_id": pa.int64(), "sample_start": pa.int64(), "samples": pa.list_(pa.float32())}


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Chunks as batches: one long chunk, or short ones of about ``BATCH`` samples in all."""
    held, n = [], 0
    for row in rows:
        size = len(row[6]) + 1
        if held and n + size > BATCH:
            yield _batch(held, _CHUNK_TYPES)
            held, n = [], 0
        held.append(row)
        n += size
    if held:
        yield _batch(held, _CHUNK_TYPES)


class WavSource(DataSource):
    """Options: ``path`` or ``paths`` (a JSON list), ``channel``, ``chunk`` (samples), ``range`` (bytes), ``headers``."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return RECORDINGS if self.options.get("headers", "false").lower() == "true" else SIGNAL_CHUNKS

    def reader(self, schema) -> DataSourceReader:
        return WavReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("wav")`` known to the session."""
    spark.dataSource.register(WavSource)


def _recording(df: DataFrame) -> DataFrame:
    """``recording``: the path's last two parts, so equal names in two folders stay apart."""
    return df.withColumn("recording", F.concat_ws("/", "folder", "name"))


def decode(files: DataFrame, channel: int = 0, chunk: int = CHUNK, range_bytes: int = RANGE) -> DataFrame:
    """``files``: path, length (as ``binaryFile`` gives them, whose ``content`` is not read). The chunks of all files, each
    range of bytes a row of its own before it is read; for files that come as a stream."""
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("at").to_pylist(), strict=True):
                yield from _batches(read_range(path, at, range_bytes, channel, chunk))

    return _recording(ranges.repartition("path", "at").mapInArrow(run, SIGNAL_CHUNKS))


def read_recordings(spark: SparkSession, paths: str | list[str], channel: int = 0, chunk: int = CHUNK, range_bytes: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(recordings, signal_chunks) of all files ending in ``wav`` under the paths. Recordings come from headers alone."""
    register(spark)
    reader = lambda: spark.read.format("wav").option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).option("channel", channel).option("chunk", chunk).option("range", range_bytes)
    recordings = _recording(reader().option("headers", "true").load())
    return recordings.select("recording", *_HEADER_TYPES), _recording(reader().load())


def recordings_of(chunks: DataFrame) -> DataFrame:
    """One row for each recording, from the first chunk of each."""
    return chunks.filter("chunk_id = 0").select("recording", "folder", "name", "sample_rate", "n_samples", (F.col("n_samples") / F.col("sample_rate")).alias("duration"))


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit WAV file of whole numbers [frames x channels]."""
    data = samples.astype("<i2").tobytes()
    channels = samples.shape[1]
    form = b"".join(v.to_bytes(n, "little") for v, n in ((1, 2), (channels, 2), (rate, 4), (rate * channels * 2, 4), (channels * 2, 2), (16, 2)))
    return b"RIFF" + (36 + len(data)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + form + b"data" + len(data).to_bytes(4, "little") + data


def write_recordings(chunks: DataFrame, path: str) -> DataFrame:
    """Writes each recording of one chunk as a 16-bit WAV file ``path/folder/name.wav``; returns folder, name and the
    number of samples written. ``chunks``: folder, name, sample_rate, chunk_id, samples (-1..1). A task that is run again
    writes the same file again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for folder, name, rate, samples in zip(*[batch.column(c).to_pylist() for c in ("folder", "name", "sample_rate", "samples")], strict=True):
                whole = np.clip(np.round(np.array(samples, float) * 32768), -32768, 32767)[:, None]
                system, place = _opened(f"{path}/{folder}")
                system.create_dir(place, recursive=True)
                with system.open_output_stream(f"{place}/{name}.wav") as f:
                    f.write(wav_bytes(whole, rate))
                done.append((folder, f"{name}.wav", len(samples)))
            yield _batch(done, {"folder": pa.string(), "name": pa.string(), "n": pa.int64()})

    return chunks.filter("chunk_id = 0").select("folder", "name", "sample_rate", "samples").mapInArrow(run, "folder string, name string, n long")


def get_signal(recordings: DataFrame, name: str) -> DataFrame:
    """The first recording of that name, by folder; no row if there is none."""
    return recordings.filter(F.col("name") == name).orderBy("folder").limit(1)

"""Active-contour detector: edge map, level set, contour on tiles, components, boxes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..schemas import KEYS
from ..shared import stash
from .boxes import filter_boxes
from .components import connected_components
from .grouped import longs, map_groups
from .intervals import same
from .spectrogram import with_halo

#: Frames in a block whose mask is labelled in one task.
BLOCK = 2048
LAST = np.iinfo(np.int64).max


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """[rows x values] of a list column; shorter lists end in zeros."""
    x = column.combine_chunks()
    sizes = np.diff(x.offsets.to_numpy())
    flat = x.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None] < sizes[:, None]] = flat
    return out


_PART = "_local int, t_start long, t_end long, freq_start long, freq_end long, n_cells long, _begin array<struct<s: int, e: int>>, _final array<struct<s: int, e: int>>"


_RUN = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_PART_KINDS = {"_local": pa.int32(), **dict.fromkeys(("t_start", "t_end", "freq_start", "freq_end", "n_cells"), pa.int64()), "_begin": _RUN, "_final": _RUN}


def _parts_of(mask: np.ndarray, at: np.ndarray, b: int, block: int, reach: int) -> list[tuple]:
    """The connected parts of ``mask`` [frames x bins] of block ``b`` with frames ``at``, as rows of ``_PART``."""
    row, first, last, of = kernels.mask_runs(mask, at, reach)
    n = int(of.max(initial=-1)) + 1
    frames = at[row]
    ends = {}
    for name, x, how, start in (("t0", frames, np.minimum, LAST), ("t1", frames, np.maximum, -1), ("f0", first, np.minimum, LAST), ("f1", last, np.maximum, -1), ("n", last - first + 1, np.add, 0)):
        ends[name] = np.full(n, start, np.int64)
        how.at(ends[name], of, x)
    border: dict[int, list[list[dict[str, int]]]] = {}
    for side, frame in enumerate((b * block, (b + 1) * block - 1)):
        for i in np.flatnonzero(frames == frame).tolist():
            border.setdefault(int(of[i]), [[], []])[side].append({"s": int(first[i]), "e": int(last[i])})
    none: list[list] = [[], []]
    return [(i, *(int(ends[c][i]) for c in ("t0", "t1", "f0", "f1", "n")), *border.get(i, none)) for i in range(n)]


def _part_table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    """``rows``: values of ``kinds``, then those of ``_PART``."""
    kinds = kinds | _PART_KINDS
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _joined(found: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """``found``: keys, ``_block``, ``_PART``. Adds ``_node`` (an id) and ``_root``.

    Only the runs on both sides of a border between blocks are joined, and only the parts they belong to go through the
    distributed components.
    """
    parts = stash(found.withColumn("_node", F.monotonically_increasing_id()))
    border = lambda runs, at, to: parts.select(*keys, at.alias("_border"), F.col("_node").alias(to), F.explode(runs).alias(f"_{to}"))
    before, after = border("_final", F.col("_block") + 1, "u"), border("_begin", F.col("_block"), "v")
    meets = (F.col("_u.s") <= F.col("_v.e") + reach) & (F.col("_v.s") <= F.col("_u.e") + reach)
    links = same(before, after, [*keys, "_border"]).filter(meets).select("u", "v")
    parts = parts.drop("_begin", "_final")
    links = stash(links.distinct())
    if links.isEmpty():
        return parts.withColumn("_root", F.col("_node"))
    roots = connected_components(links).select(F.col("node").alias("_n"), F.col("root").alias("_to"))
    return parts.join(roots, F.col("_node") == F.col("_n"), "left").withColumn("_root", F.coalesce("_to", "_node")).drop("_n", "_to")


def block_components(mask: DataFrame, keys: Sequence[str] = KEYS, value: str = "mags", reach: int = 0, block: int = BLOCK) -> DataFrame:
    """``mask``: keys, frame, an array with positive values where the mask is set. The connected parts of each block of
    ``block`` frames, labelled inside its task: keys, ``_block``, ``_local``, box, ``n_cells``, ``_node`` (an id), and ``_root``, equal
    for parts that belong together. ``reach``: 0 for 4 neighbours, 1 for 8.
    """
    own = [*keys, "_block"]
    dealt = mask.select(*keys, "frame", F.col(value).alias("_m"), F.floor(F.col("frame") / block).alias("_block"))

    def label(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        out = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
            part = rows.slice(lo, hi - lo)
            found = _parts_of(_matrix(part.column("_m")) > 0, longs(part, "frame"), int(part.column("_block")[0].as_py()), block, reach)
            out += [(lo, *x) for x in found]
        table = _part_table(out, {"_row": pa.int64()})
        of = rows.select(own).take(table.column("_row"))
        return pa.table([*of.columns, *table.columns[1:]], names=[*own, *_PART_KINDS])

    kinds = T.StructType([*(dealt.schema[k] for k in own), *T.StructType.fromDDL(_PART).fields])
    return _joined(map_groups(dealt, own, ["frame"], label, kinds), keys, reach)


def find_bounding_boxes(mask: DataFrame, min_side_length: int = 1, keys: Sequence[str] = KEYS, value: str = "mags", block: int = BLOCK) -> DataFrame:
    """Inclusive boxes around the 4-connected components of the mask, both sides ``min_side_length`` at least."""
    return _boxes(block_components(mask, keys, value, 0, block), min_side_length, keys)


def _boxes(parts: DataFrame, min_side_length: int, keys: Sequence[str]) -> DataFrame:
    boxes = parts.groupBy(*keys, "_root").agg(F.min("freq_start").alias("freq_start"), F.max("freq_end").alias("freq_end"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.sum("n_cells").alias("n_cells"))
    big = boxes.filter((F.col("t_end") - F.col("t_start") + 1 >= min_side_length) & (F.col("freq_end") - F.col("freq_start") + 1 >= min_side_length))
    return big.select(*keys, F.xxhash64("t_start", "t_end", "freq_start", "freq_end", "n_cells").alias("box_id"), "freq_start", "freq_end", "t_start", "t_end", F.lit(None).cast("string").alias("label"), "n_cells")


def _edge(meta: DataFrame) -> DataFrame:
    return meta.select("recording", F.col("n_time").alias("_n"))


def ones_level_set(frames: DataFrame, meta: DataFrame) -> DataFrame:
    """1 everywhere but on the four edges (as doubles in ``mags``)."""
    last = F.size("mags") - 1
    edge = (F.col("frame") == 0) | (F.col("frame") == F.col("_n") - 1)
    return frames.join(_edge(meta), "recording").select(*frames.drop("mags").columns, F.transform("mags", lambda x, i: F.when(edge | (i == 0) | (i == last), 0.0).otherwise(1.0)).alias("mags"))


def eroded_level_set(frames: DataFrame, meta: DataFrame, threshold: float | str, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """0 for pixels that a path over pixels above the threshold (a number, or a column of ``keys``; 8 neighbours) joins to
    the edge of the spectrogram, 1 for all others. The edge pixels themselves are 0.

    The parts of such pixels in each block are labelled in its task; those whose component touches the edge are taken out
    when the block is labelled once more.
    """
    last = F.size("mags") - 1
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    edge = (F.col("frame") == 0) | (F.col("frame") == F.col("_n") - 1)
    rows = stash(frames.join(_edge(meta), "recording").select(*keys, "frame", "_n", F.size("mags").alias("_f"), F.transform("mags", lambda x, i: F.when(edge | (i == 0) | (i == last) | (x > limit), 1.0).otherwise(0.0)).alias("mags")))
    size = rows.groupBy(*keys).agg(F.max("_n").alias("_n"), F.max("_f").alias("_f"))
    parts = stash(block_components(rows, keys, "mags", 1, block))
    at_edge = (F.col("t_start") == 0) | (F.col("t_end") == F.col("_n") - 1) | (F.col("freq_start") == 0) | (F.col("freq_end") == F.col("_f") - 1)
    outside = same(parts, size, keys).filter(at_edge).select("_root").distinct()
    gone = parts.join(outside, "_root").select(*keys, "_block", "_local")
    own = [*keys, "_block"]
    dealt = rows.select(*keys, "frame", "mags", F.floor(F.col("frame") / block).alias("_block"))

    def erode(key: tuple, image: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        image = image.sort_values("frame")
        sizes = image["mags"].map(len)
        mask = np.zeros((len(image), int(sizes.max()) if len(image) else 0), bool)
        for i, m in enumerate(image["mags"]):
            mask[i, : len(m)] = np.asarray(m) > 0
        row, first, final, of = kernels.mask_runs(mask, image["frame"].to_numpy(), 1)
        result = np.ones(mask.shape)
        for i in np.flatnonzero(np.isin(of, out["_local"].to_numpy())).tolist():
            result[row[i], first[i] : final[i] + 1] = 0.0
        return image[[*keys, "frame"]].assign(mags=[result[i, :n] for i, n in enumerate(sizes)])

    schema = T.StructType([*(dealt.schema[k] for k in (*keys, "frame")), T.StructField("mags", T.ArrayType(T.DoubleType()))])
    return dealt.groupBy(*own).cogroup(gone.groupBy(*own)).applyInPandas(erode, schema)


def inverse_gaussian_gradient(frames: DataFrame, sigma: float = 5.0, alpha: float = 100.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """1 / sqrt(1 + alpha * norm of the smoothed gradient): small at edges. Halo of 4 sigma frames."""
    r = int(4 * sigma + 0.5)

    def run(m: np.ndarray, left: int, right: int) -> np.ndarray:
        return 1.0 / np.sqrt(1.0 + alpha * kernels.gradient_magnitude(m, sigma, (left, right)))

    return with_halo(frames, r, run, keys=keys)


def evolve(edges: DataFrame, start: DataFrame, num_iter: int = 230, smoothing: int = 0, threshold: float = 0.9, balloon: float = -1, keys: Sequence[str] = KEYS, block: int = 4096) -> DataFrame:
    """The contour after ``num_iter`` steps: keys, frame, mags (1 inside).

    A step moves information by two frames, and by two more for each smoothing, so a tile with that much halo for all
    steps gives its own frames exactly what the whole spectrogram would.
    """
    halo = num_iter * (2 + 2 * smoothing)
    both = edges.join(start.withColumnRenamed("mags", "_u"), [*keys, "frame"]).withColumn("mags", F.concat("mags", "_u")).drop("_u")

    def run(m: np.ndarray, left: int, right: int) -> np.ndarray:
        n = m.shape[0] // 2
        u = kernels.active_contour(m[:n], m[n:], num_iter, smoothing, threshold, balloon)
        return u[:, left : u.shape[1] - right].astype(float)

    return with_halo(both, halo, run, block=block, keys=keys)


def detect_gac_settings(frames: DataFrame, meta: DataFrame, settings: Sequence[dict], min_side_length: int = 1, filter: bool = True, alpha: float = 100.0, counted=None) -> DataFrame:
    """``detect_gac`` with eroded level sets for many settings in one plan: boxes with ``setting`` and ``recording``.

    ``settings``: setting (a number), num_iter, smoothing, threshold, balloon, flood_threshold, sigma. Frames travel once for
    each sigma, with a bit for each pixel and flood threshold: the task of a block floods, evolves and labels it for all
    settings of its sigma, one after the other, and only boxes come out. Settings that differ in ``num_iter`` only are one
    evolution. ``counted``: an accumulator for the steps of all tiles.
    """
    names = ("setting", "num_iter", "smoothing", "threshold", "balloon", "flood_threshold", "sigma")

    def edge_map(m: np.ndarray, left: int, right: int, sigma: float) -> np.ndarray:
        r = int(4 * sigma + 0.5)
        g = kernels.gradient_magnitude(m, sigma, (left, right))
        return 1.0 / np.sqrt(1.0 + alpha * g[:, max(0, left - r) : g.shape[1] - max(0, right - r)])

    settings = [{k: x[k] if k == "setting" else float(x[k]) for k in names} for x in settings]
    reach = max((int(4 * x["sigma"] + 0.5) for x in settings), default=0)
    each = frames.select("recording", "frame", "mags").withColumn("sigma", F.explode(F.array(*[F.lit(v) for v in sorted({x["sigma"] for x in settings})]).cast("array<double>")))
    edges = stash(with_halo(each, reach, edge_map, keys=("recording",), extra={"sigma": "sigma"})).join(_edge(meta), "recording")
    floods = {v: sorted({x["flood_threshold"] for x in settings if x["sigma"] == v}) for v in {x["sigma"] for x in settings}}
    halo = max((int(x["num_iter"]) * (2 + 2 * int(x["smoothing"])) for x in settings), default=0)
    # settings that differ in their number of steps only are one evolution, with a picture after each of the numbers
    families: dict[tuple, dict[int, list[int]]] = {}
    for x in settings:
        families.setdefault(tuple(x[k] for k in ("sigma", "flood_threshold", "smoothing", "threshold", "balloon")), {}).setdefault(int(x["num_iter"]), []).append(x["setting"])
    tile = ["sigma", "recording", "_block"]
    kind = edges.schema["recording"].dataType.simpleString()
    blocks = edges.withColumn("_block", F.floor(F.col("frame") / BLOCK))

    def opened(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, float, object, int, np.ndarray]:
        """Frames in order, their numbers, edge map [frames x bins], keys, and the pixels at the edge of the spectrogram."""
        rows = rows.sort_by("frame")
        at, m = longs(rows, "frame"), _matrix(rows.column("mags"))
        rim = np.zeros(m.shape, bool)
        rim[(at == 0) | (at == longs(rows, "_n") - 1)] = True
        rim[:, :1] = rim[:, -1:] = True
        return rows, at, m, *(rows.column(k)[0].as_py() for k in tile), rim

    def flooded(rows: pa.Table) -> pa.Table:
        """The parts of pixels above each flood threshold."""
        _, at, m, sigma, recording, b, rim = opened(rows)
        out = [(sigma, v, recording, b, *x) for v in floods[sigma] for x in _parts_of(rim | (m > v), at, b, BLOCK, 1)]
        return _part_table(out, {"sigma": pa.float64(), "flood_threshold": pa.float64(), "recording": pa.string(), "_block": pa.int64()})

    own = ("sigma", "flood_threshold", "recording")
    parts = stash(_joined(blocks.groupBy(*tile).applyInArrow(flooded, f"sigma double, flood_threshold double, recording {kind}, _block long, {_PART}"), own, 1))
    size = edges.groupBy("recording").agg(F.max("_n").alias("_n"), F.max(F.size("mags")).alias("_f"))
    at_edge = (F.col("t_start") == 0) | (F.col("t_end") == F.col("_n") - 1) | (F.col("freq_start") == 0) | (F.col("freq_end") == F.col("_f") - 1)
    outside = parts.join(size, "recording").filter(at_edge).select("_root").distinct()
    gone = parts.join(outside, "_root").select(*own, "_block", "_local")

    def started(rows: pa.Table, out: pa.Table) -> pa.Table:
        """The rows with ``starts``: the bits of the level sets of all flood thresholds, one after the other."""
        rows, at, m, sigma, _, _, rim = opened(rows)
        flood, local = out.column("flood_threshold").to_numpy(), out.column("_local").to_numpy()
        u = np.ones((len(at), len(floods[sigma]), m.shape[1]), bool)
        for i, v in enumerate(floods[sigma]):
            row, first, last, of = kernels.mask_runs(rim | (m > v), at, 1)
            for j in np.flatnonzero(np.isin(of, local[flood == v])).tolist():
                u[row[j], i, first[j] : last[j] + 1] = False
        bits = np.packbits(u, axis=2)
        return rows.select([*tile[:2], "frame", "mags"]).append_column("starts", pa.array([x.tobytes() for x in bits], pa.binary()))

    started_blocks = blocks.groupBy(*tile).cogroup(gone.groupBy(*tile)).applyInArrow(started, f"sigma double, recording {kind}, frame long, mags array<double>, starts binary")
    first, last = F.floor((F.col("frame") - halo) / BLOCK), F.floor((F.col("frame") + halo) / BLOCK)
    tiles = started_blocks.withColumn("_block", F.explode(F.sequence(first, last)))

    def contours(rows: pa.Table) -> pa.Table:
        """The parts inside the contour of each setting, in the block's own frames."""
        rows = rows.sort_by("frame")
        at, m = longs(rows, "frame"), _matrix(rows.column("mags"))
        sigma, recording, b = (rows.column(k)[0].as_py() for k in tile)
        core, out = at // BLOCK == b, []
        bits = np.frombuffer(b"".join(rows.column("starts").to_pylist()), np.uint8).reshape(len(at), len(floods[sigma]), -1)
        for (of_sigma, flood, smoothing, threshold, balloon), steps in families.items() if core.any() else ():
            if of_sigma != sigma:
                continue
            u = np.unpackbits(bits[:, floods[sigma].index(flood)], axis=1, count=m.shape[1])
            pictures = sorted(steps)
            for n, x in zip(pictures, kernels.contour_snapshots(m.T, u.T, pictures, int(smoothing), threshold, balloon), strict=True):
                found = _parts_of(x.T[core] > 0, at[core], b, BLOCK, 0)
                out += [(setting, recording, b, *y) for setting in steps[n] for y in found]
            if counted is not None:
                counted.add(max(pictures, default=0))
        return _part_table(out, {"setting": pa.int64(), "recording": pa.string(), "_block": pa.int64()})

    keys = ("setting", "recording")
    inside = _joined(tiles.groupBy(*tile).applyInArrow(contours, f"setting long, recording {kind}, _block long, {_PART}"), keys, 0)
    boxes = _boxes(inside, min_side_length, keys)
    return filter_boxes(boxes, meta) if filter else boxes


def detect_gac(
    frames: DataFrame,
    meta: DataFrame,
    min_side_length: int = 1,
    filter: bool = True,
    num_iter: int = 230,
    smoothing: int = 0,
    threshold: float = 0.9,
    balloon: float = -1,
    level_set: str = "ones",
    level_set_threshold: float | None = None,
    sigma: float = 5.0,
    alpha: float = 100.0,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Boxes around what the contour encloses. ``level_set``: "ones" or "eroded" (with its threshold, of the edge map)."""
    edges = stash(inverse_gaussian_gradient(frames, sigma, alpha, keys))
    if level_set == "ones":
        start = ones_level_set(edges, meta)
    elif level_set == "eroded" and level_set_threshold is not None:
        start = eroded_level_set(edges, meta, level_set_threshold, keys)
    else:
        raise ValueError("level_set: ones, or eroded with level_set_threshold")
    boxes = find_bounding_boxes(evolve(edges, start, num_iter, smoothing, threshold, balloon, keys), min_side_length, keys)
    return filter_boxes(boxes, meta) if filter else boxes

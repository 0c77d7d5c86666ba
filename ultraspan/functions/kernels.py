"""Array helpers for work on one block of a spectrogram [frequency x time] or signal. numpy only."""

from __future__ import annotations

import numpy as np


def hann(n_fft: int, win_length: int) -> np.ndarray:
    """Periodic Hann window, padded to ``n_fft`` in the middle."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win_length) / win_length)
    left = (n_fft - win_length) // 2
    return np.pad(w, (left, n_fft - win_length - left))


def stft(signal: np.ndarray, first: int, count: int, n_fft: int, win_length: int, hop: int, power: float) -> np.ndarray:
    """``count`` frames [time x frequency] of a signal that starts ``first`` samples into it; no padding."""
    view = np.lib.stride_tricks.sliding_window_view(signal[first:], n_fft)[::hop][:count]
    return np.abs(np.fft.rfft(view * hann(n_fft, win_length), axis=1)) ** power


def correlate(block: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation of a block that has the kernel's radius as margin on every side."""
    h, w = kernel.shape
    view = np.lib.stride_tricks.sliding_window_view(block, (h, w))
    return np.einsum("ijkl,kl->ij", view, kernel)


def gaussian_1d(sigma: float, m: int) -> np.ndarray:
    x = np.arange(m) - (m - 1) // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def gaussian_kernel(sigma_x: float, sigma_y: float, m: int) -> np.ndarray:
    """[frequency x time]; ``sigma_x`` runs along time."""
    return np.outer(gaussian_1d(sigma_y, m), gaussian_1d(sigma_x, m))


def diagonal_kernel(sigma_x: float, sigma_y: float, m: int) -> np.ndarray:
    r = (m - 1) // 2
    p, q = np.mgrid[-r : r + 1, -r : r + 1]
    k = np.exp(-(((q - p) / sigma_x) ** 2 + ((q + p) / sigma_y) ** 2))
    return k / k.sum()


def bilateral(block: np.ndarray, d: int, sigma_color: float, sigma_space: float) -> np.ndarray:
    """Mean over a disc of diameter ``d``, weighted by distance and by difference; the block has margin d // 2."""
    r = d // 2
    centre = block[r : block.shape[0] - r, r : block.shape[1] - r]
    total, weight = np.zeros(centre.shape), np.zeros(centre.shape)
    for i in range(-r, r + 1):
        for j in range(-r, r + 1):
            if i * i + j * j <= r * r:
                x = block[r + i : block.shape[0] - r + i, r + j : block.shape[1] - r + j]
                w = np.exp(-(i * i + j * j) / (2 * sigma_space**2) - (x - centre) ** 2 / (2 * sigma_color**2))
                total += w * x
                weight += w
    return total / weight


def gradient_magnitude(block: np.ndarray, sigma: float, margins: tuple[int, int]) -> np.ndarray:
    """Norm of the Gaussian-smoothed gradient. ``margins``: columns of real margin at either side in time; frequency
    edges, and the sides without margin, repeat the edge value."""
    r = int(4 * sigma + 0.5)
    x = np.arange(-r, r + 1)
    g = np.exp(-0.5 * (x / sigma) ** 2)
    g /= g.sum()
    d = x / sigma**2 * g  # correlation with it gives the derivative
    left, right = (r - m for m in margins)
    padded = np.pad(block, ((r, r), (max(0, left), max(0, right))), mode="edge")
    along = lambda m, k, axis: np.apply_along_axis(lambda v: np.convolve(v, k[::-1], mode="valid"), axis, m)
    dy, dx = along(along(padded, d, 0), g, 1), along(along(padded, g, 0), d, 1)
    return np.sqrt(dx**2 + dy**2)


_LINES = tuple(np.array(k, bool) for k in (np.eye(3), [[0, 1, 0]] * 3, np.flipud(np.eye(3)), [[0, 0, 0], [1, 1, 1], [0, 0, 0]]))
_SQUARE = np.ones((3, 3), bool)


def _shifts(u: np.ndarray, element: np.ndarray) -> list[np.ndarray]:
    p = np.pad(u, 1)  # outside counts as 0
    return [p[i : i + u.shape[0], j : j + u.shape[1]] for i, j in zip(*np.nonzero(element), strict=True)]


def dilate(u: np.ndarray, element: np.ndarray = _SQUARE) -> np.ndarray:
    return np.maximum.reduce(_shifts(u, element))


def erode(u: np.ndarray, element: np.ndarray = _SQUARE) -> np.ndarray:
    return np.minimum.reduce(_shifts(u, element))


def _sup_inf(u: np.ndarray) -> np.ndarray:
    return np.maximum.reduce([erode(u, k) for k in _LINES])


def _inf_sup(u: np.ndarray) -> np.ndarray:
    return np.minimum.reduce([dilate(u, k) for k in _LINES])


def active_contour(g: np.ndarray, u: np.ndarray, iterations: int, smoothing: int, threshold: float, balloon: float) -> np.ndarray:
    """Morphological geodesic active contour: balloon force where the edge map allows it, attraction to its valleys,
    then curvature smoothing by alternating line operators."""
    return contour_snapshots(g, u, [iterations], smoothing, threshold, balloon)[0]


def contour_snapshots(g: np.ndarray, u: np.ndarray, iterations: list[int], smoothing: int, threshold: float, balloon: float) -> list[np.ndarray]:
    """``active_contour`` after each number of iterations, from one evolution up to the largest."""
    u = (u > 0).astype(np.int8)
    dg = np.gradient(g)
    free = g > threshold / abs(balloon) if balloon else None
    flip, at = 0, {0: u}
    for step in range(1, max(iterations, default=0) + 1):
        if balloon:
            moved = dilate(u) if balloon > 0 else erode(u)
            u = np.where(free, moved, u)
        pull = sum(a * b for a, b in zip(dg, np.gradient(u.astype(float)), strict=True))
        u = np.where(pull > 0, 1, np.where(pull < 0, 0, u)).astype(np.int8)
        for _ in range(smoothing):
            u = _sup_inf(_inf_sup(u)) if flip % 2 == 0 else _inf_sup(_sup_inf(u))
            flip += 1
        if step in iterations:
            at[step] = u
    return [at[n] for n in iterations]


def components(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component; ``pairs`` [k x 2]."""
    root = np.arange(n)
    if len(pairs) == 0:
        return root
    a, b = pairs[:, 0], pairs[:, 1]
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:  # pointer jumping
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new


def sweep_components(ts: np.ndarray, te: np.ndarray, fs: np.ndarray, fe: np.ndarray, delta_time: int, delta_freq: int) -> np.ndarray:
    """A member of each box's component; boxes (ends included) touch that come within the deltas of each other.

    Boxes are taken by their start. For each gap between frequency coordinates, the box over it that ends last is enough
    to know: of boxes that share a gap and haven't ended, the later one met the earlier one when it began.
    """
    n = len(ts)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    gaps = np.unique(np.concatenate([fs, fe + 1]))
    ends, holder = np.full(len(gaps), np.iinfo(np.int64).min), np.full(len(gaps), -1)
    lo, hi = np.searchsorted(gaps, fs), np.searchsorted(gaps, fe + 1)
    near_lo, near_hi = np.maximum(np.searchsorted(gaps, fs - delta_freq, side="right") - 1, 0), np.searchsorted(gaps, fe + delta_freq + 1)
    for i in np.argsort(ts, kind="stable").tolist():
        a, b = near_lo[i], near_hi[i]
        for j in set(holder[a:b][ends[a:b] >= ts[i] - delta_time].tolist()):
            if (x := find(i)) != (y := find(j)):
                parent[max(x, y)] = min(x, y)
        a, b = lo[i], hi[i]
        later = ends[a:b] < te[i]
        ends[a:b][later], holder[a:b][later] = te[i], i
    return np.array([find(i) for i in range(n)], np.int64)


def mask_runs(mask: np.ndarray, frames: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first bin, last bin, component) of each run of set bins in ``mask`` [frames x bins]; runs of neighbouring
    ``frames`` (sorted) are linked that share a bin, or come within ``reach`` bins. Components are numbered from 0, in
    order of their first run."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    width = mask.shape[1] + 2 * reach + 2
    place = (frames[row] - frames[0]) * width if len(row) else np.zeros(0, np.int64)
    starts, ends = place + first, place + last
    a = np.searchsorted(ends, starts + width - reach, side="left")  # first run of the next frame that isn't before it
    b = np.searchsorted(starts, ends + width + reach, side="right")
    # runs of the next frame alone: reach may look past its borders
    a = np.maximum(a, np.searchsorted(starts, place + width - reach, side="left"))
    b = np.minimum(b, np.searchsorted(starts, place + 2 * width - reach, side="left"))
    n = np.maximum(b - a, 0)
    left = np.repeat(np.arange(len(row)), n)
    right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
    root = components(len(row), np.column_stack([left, right]))
    return row, first, last, np.unique(root, return_inverse=True)[1]

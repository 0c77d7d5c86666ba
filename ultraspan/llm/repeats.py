"""Repeated passages: suffix arrays and longest-previous-factor arrays, on the stretches that can repeat."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

from .arrowtext import SLICE_BYTES, text_slices

LENGTH = 400
GRAM = 64
#: Words of a passage ("over 50"), and words in a gram of it (a power of two).
WORDS = 51
WORD_GRAM = 8
#: Bytes that the first ranks of a suffix array look at.
FIRST = 5
_POWER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of each string of ``size`` (a power of two) bytes."""
    h = raw.astype(np.uint64) + np.uint64(1)
    step, power = 1, int(_POWER)
    while step < size:
        h = h[:-step] * np.uint64(power) + h[step:]
        step, power = 2 * step, power * power & (1 << 64) - 1
    return _mix(h)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the position of its first smallest one."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    pad = -len(h) % width
    rows = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    # positions of all window minima, found by walking equal runs of the minimum
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    out = np.empty(n, np.int64)
    ends = np.concatenate([change[1:], [n]])
    for a, b in zip(change.tolist(), ends.tolist(), strict=True):
        s = a
        at = np.flatnonzero(h[a : b + width - 1] == least[a]) + a
        for p in at.tolist():
            if s >= b:
                break
            stop = min(b, p + 1)
            if stop > s:
                out[s:stop] = p
                s = stop
    return out


def super_strings(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one smallest gram: its hash, the first window, the number of windows."""
    h = gram_hashes(raw, gram)
    at = window_minima(h, length - gram + 1)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h[at[first]], first, np.diff(np.concatenate([first, [len(at)]]))


#: Bits of a position in a suffix array, where two ranks and the position fit one sortable word.
_BITS = np.uint64(21)
_MASK = np.uint64((1 << 21) - 1)


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of keys (equal keys have one rank), and the order by key and position."""
    n = len(key)
    if n > int(_MASK):
        order = np.argsort(key, kind="stable")
        key = key[order]
    else:  # keys of 43 bits; sorting whole words is far faster than sorting indices
        word = np.sort((key << _BITS) | np.arange(n, dtype=np.uint64))
        order, key = (word & _MASK).astype(np.int64), word >> _BITS
    new = np.ones(n, np.uint64)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.uint64)
    rank[order] = np.cumsum(new)
    return rank, order


def _nearest_smaller(a: np.ndarray) -> np.ndarray:
    """For each entry the index of the nearest one before it that is smaller, or -1. Pointers jump over what is known
    to be larger, all at once."""
    p = np.arange(-1, len(a) - 1)
    live = np.arange(len(a))
    while len(live):
        q = p[live]
        live = live[(q >= 0) & (a[q] > a[live])]
        p[live] = p[p[live]]
    return p


def _common_prefix(i: np.ndarray, j: np.ndarray, raw: np.ndarray, levels: list[tuple[int, np.ndarray]], length: int) -> np.ndarray:
    """Length of the common prefix of suffixes i and j, cut at ``length``, from the ranks kept at doubling depths."""
    n = len(raw)
    l = np.zeros(len(i), np.int64)  # noqa: E741
    for depth, rank in reversed(levels):
        inside = np.maximum(i, j) + l + depth <= n
        same = np.zeros(len(i), bool)
        same[inside] = rank[(i + l)[inside]] == rank[(j + l)[inside]]
        l += same * depth
    open_ = np.flatnonzero(l < length)
    for _ in range(min(length, FIRST)):
        open_ = open_[np.maximum(i[open_], j[open_]) + l[open_] < n]
        open_ = open_[raw[i[open_] + l[open_]] == raw[j[open_] + l[open_]]]
        l[open_] += 1
    return np.minimum(l, length)


def longest_previous_factors(raw: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start (ascending): the longest prefix, cut at ``length``, that also starts at an earlier window,
    and that window (its index in ``windows``; -1 if nothing is shared).

    The suffix array of ``raw`` is built by prefix doubling up to ``length`` bytes, equal suffixes in order of position.
    In suffix order the previous and the next smaller position of a suffix are the earlier ones it has most in common
    with; the longer of the two common prefixes is the longest previous factor.
    """
    n, w = len(raw), len(windows)
    if not w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([raw, np.zeros(FIRST, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    depth = min(FIRST, length)
    for i in range(depth):
        key = (key << np.uint64(8)) | padded[i : i + n]
    rank, order = _ranks(key)
    levels = [(depth, rank)]
    while depth < length:
        step = min(depth, length - depth)
        later = np.zeros(n, np.uint64)
        later[: n - step] = rank[step:]
        rank, order = _ranks((rank << (_BITS if n <= int(_MASK) else np.uint64(32))) | later)
        depth += step
        if step * 2 == depth:
            levels.append((depth, rank))
    # only whole windows are suffixes of the array
    index = np.full(n, -1, np.int64)
    index[windows] = np.arange(w)
    at = index[order]
    at = at[at >= 0]
    before = _nearest_smaller(at)
    after = w - 1 - _nearest_smaller(at[::-1])[::-1]
    lpf, source = np.zeros(w, np.int64), np.full(w, -1, np.int64)
    for near, known in ((before, before >= 0), (after, after < w)):
        mine, other = at[known], at[near[known]]
        common = _common_prefix(windows[mine], windows[other], raw, levels, length)
        better = common > lpf[mine]
        lpf[mine[better]], source[mine[better]] = common[better], other[better]
    return lpf, source


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cells(body: bytes, length: int, gram: int, width: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """Cuts a super-string into runs of windows by the place of the smallest gram in them, ``width`` places at a time:
    (key, digest, first window, windows) of each. Equal windows have that gram at the same place, so they lie in cells
    of one key: the hash of the bytes that all windows of a whole cell have in common."""
    h = gram_hashes(np.frombuffer(body, np.uint8)[:length], gram)
    p, n = int(h.argmin()), len(body) - length + 1
    for c in range((p - n + 1) // width, p // width + 1):
        lo, hi = max(0, p - (c + 1) * width + 1), min(n - 1, p - c * width)
        core = p - c * width
        key = xxhash.xxh3_128_digest(body[core : core + length - width + 1], seed=c)
        yield key, xxhash.xxh3_128_digest(body[lo : hi + length]), lo, hi - lo + 1


def slice_strings(keys: np.ndarray, texts: pa.Array, length: int, gram: int) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """For slices of a text column: the distinct super-strings (gram, digest, copies, row, first window, windows), and
    the other copies inside the slice (row, first window, windows), joined where they touch."""
    for first, end, offsets, raw in text_slices(texts):
        seen: dict[bytes, list] = {}
        again: list[tuple[int, int, int]] = []
        for r in range(end - first):
            own = raw[offsets[r] : offsets[r + 1]]
            if len(own) < length:
                continue
            row, view = int(keys[first + r]), memoryview(own)
            for m, lo, n in zip(*(x.tolist() for x in super_strings(own, length, gram)), strict=True):
                key = xxhash.xxh3_128_digest(view[lo : lo + n + length - 1])
                if key in seen:
                    seen[key][1] += 1
                    if again and again[-1][0] == row and again[-1][1] + again[-1][2] == lo:
                        again[-1] = (row, again[-1][1], again[-1][2] + n)
                    else:
                        again.append((row, lo, n))
                else:
                    seen[key] = [m, 1, row, lo, n]
        yield [(v[0], s, *v[1:]) for s, v in seen.items()], again


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every word (``common.WORD``) of the texts of a slice, see ``text_slices``."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_SPACE[raw]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edges], last[edges - 1] = inside[edges + 1], inside[edges]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, _POWER)), np.cumprod(np.full(n, _INVERSE))


#: Powers for an ordinary slice, made once in a process.
_slice_powers = cache(lambda: _powers(SLICE_BYTES))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, from sums over all bytes before its ends."""
    powers, inverse = _slice_powers() if len(raw) <= SLICE_BYTES else _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    values = raw.astype(np.uint64)
    values += np.uint64(1)
    values *= powers[: len(raw)]
    np.cumsum(values, out=total[1:])
    return _mix((total[ends] - total[starts]) * inverse[starts])


def word_strings(raw: np.ndarray, offsets: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, ...]:
    """Super-strings of the texts of a slice, for windows of ``words`` words and grams of ``gram`` words: text, hash of
    the gram, first and end byte in the slice. Of grams in a window the first with the smallest half hash counts, so equal
    windows have equal grams."""
    starts, ends = word_bounds(raw, offsets)
    n, width = len(starts) - words + 1, words - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.searchsorted(offsets, starts, side="right") - 1
    h = gram_hashes(word_hashes(raw, starts, ends), gram)
    rows = np.concatenate([(h & _HIGH) | np.arange(len(h), dtype=np.uint64), np.full(-len(h) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _LOW).astype(np.int64)
    whole = np.flatnonzero(text[:n] == text[words - 1 :])  # windows inside one text
    at = at[whole]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return text[whole[first]], h[at[first]], starts[whole[first]], ends[whole[last] + words - 1]


def slice_word_strings(keys: np.ndarray, texts: pa.Array, words: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For slices of a text column: gram, digest (64 bits each), row, first byte in its text and bytes of super-strings."""
    for first, _, offsets, raw in text_slices(texts):
        text, h, a, b = word_strings(raw, offsets, words, gram)
        view = memoryview(raw)
        d = np.array([xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.uint64)
        yield h.view(np.int64), d.view(np.int64), keys[first + text], (a - offsets[text]).astype(np.int32), (b - a).astype(np.int32)


def window_digests(bodies: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """A digest of each window of ``words`` words of some texts, in order, and the number of windows of each text."""
    raw, offsets = b"".join(bodies), np.cumsum([0, *map(len, bodies)])
    starts, ends = word_bounds(np.frombuffer(raw, np.uint8), offsets)
    text = np.searchsorted(offsets, starts, side="right") - 1
    n, view = max(0, len(starts) - words + 1), memoryview(raw)
    whole = np.flatnonzero(text[:n] == text[words - 1 :])  # windows inside one text
    d = np.array([xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(starts[whole].tolist(), ends[whole + words - 1].tolist(), strict=True)], np.uint64)
    return d.view(np.int64), np.bincount(text[whole], minlength=len(bodies))

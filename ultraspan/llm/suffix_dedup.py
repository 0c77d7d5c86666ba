"""Repeated passages by suffix arrays and longest-previous-factor arrays.

A window is a string of ``length`` bytes inside one document. Windows that have one smallest ``GRAM``-byte string in
common lie side by side and form a super-string; equal windows have equal smallest grams, so they can only be in
super-strings with the same gram. That deals the work out: (1) one pass over the texts emits a 128-bit digest for each
super-string; (2) of equal super-strings, which are repeated as a whole, one goes on; (3) of those that share a gram but
differ, the bytes are fetched, and the longest-previous-factor array of a batch of such groups (previous and next
smaller positions in suffix order) gives every window the longest prefix that an earlier one has too: with ``length``
bytes it is a later copy, and its source is repeated; (4) the windows found become byte ranges of documents.

A gram with more than ``GROUP`` different super-strings (the edges of a passage that very many documents share) would
make one large group. Its super-strings are cut into runs of windows that have the gram at nearly the same place, and
grouped again by all that the windows of such a run have in common: steps (2) and (3) work on these smaller groups, and
once more with shorter runs where a group is still large. A run of one window is equal to all others of its group, so
the last groups hold one string each.

``words``: also tells which documents hold that many words in a row, with the white space between them, that another
document holds too, however few bytes they are. Super-strings of windows of words are dealt out by their smallest gram of
words; those that several documents hold settle their documents, and of the others that share a gram each window is
compared by a digest of gram and window (64 bits each), where a document isn't settled.

``keep``: "none" removes every copy; "first" keeps the first one (by row, then position), as a later copy is removed
only for the earlier match its longest previous factor shows.

Edge cases: null and empty texts, and texts shorter than a window, have no ranges; repeated documents are copies of each
other; matches may overlap, also inside one document; very long texts are read whole; an empty table gives an empty
result; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import SLICE_BYTES
from .common import read_table, stash, with_row_keys
from .repeats import GRAM, LENGTH, WORD_GRAM, cells, longest_previous_factors, merge, runs, slice_strings, slice_word_strings, window_digests

#: Different strings in a group that one suffix array takes, and the lengths of runs that larger groups are cut into.
GROUP, WIDTHS = 128, (64, 8, 1)
#: Bytes in a suffix array, and row keys (8 bytes each) that may be broadcast.
BATCH_BYTES, MOST_BROADCAST = 1 << 20, 400_000
RANGES = "array<struct<a: int, b: int>>"
_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
KEY, KIND = ("k1", "k2"), ("k1", "k2", "d1", "d2")
STRINGS = "k1 long, k2 long, d1 long, d2 long, copies int, row_key long, lo int, n int, part int"
_NAMES = ["k1", "k2", "d1", "d2", "copies", "row_key", "lo", "n", "part"]


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    x = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))


def _ints(values) -> pa.Array:
    return pa.array(np.asarray(values, np.int32))


def _with(keyed: DataFrame, values: DataFrame, column: str, all_rows: bool) -> DataFrame:
    """``keyed`` with the column of ``values`` (r, column) that goes with its row_key; ``all_rows``: null where none does.

    Where few rows have a value (a checked count of 8-byte keys), the keys alone are broadcast to tell the two kinds of
    rows apart, and only texts with a value are shuffled to it; else all texts are. Texts and values meet in a merge join
    at every size, so that small runs show the plan of large ones.
    """
    mine, values = F.col("row_key") == F.col("r"), values.hint("merge")
    if values.count() > MOST_BROADCAST:
        return keyed.join(values, mine, "left" if all_rows else "inner").drop("r")
    keys = F.broadcast(values.select("r"))
    found = keyed.join(keys, mine, "left_semi").join(values, mine).drop("r")
    if not all_rows:
        return found
    return found.unionByName(keyed.join(keys, mine, "left_anti").withColumn(column, F.lit(None).cast(values.schema[column].dataType)))


def _structs(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in x] for x in found], _RANGES)


def _of_documents(keyed: DataFrame, refs: DataFrame, *columns: str) -> DataFrame:
    """row_key, text, ``own``: the strings of ``refs`` (row_key, columns) in each document."""
    lists = stash(refs.groupBy("row_key").agg(F.collect_list(F.struct(*columns)).alias("own")).withColumnRenamed("row_key", "r"))  # those of one document
    return _with(keyed, lists, "own", False).select("row_key", "text", "own")


def _compare(pieces: DataFrame, length: int) -> DataFrame:
    """``pieces``: k1, k2, row_key, lo, body (bytes of a string). Returns row_key, lo, ``found`` (ranges of its windows
    that another string of the group has too) and ``firsts`` (those of them whose first copy it has)."""

    def flush(group: list[tuple]) -> pa.RecordBatch:
        group.sort(key=lambda p: (p[2], p[3]))
        sizes = np.array([len(p[4]) for p in group])
        raw = np.frombuffer(b"".join(p[4] for p in group), np.uint8)
        starts = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        shift = np.cumsum(counts) - counts
        windows = np.arange(counts.sum()) + np.repeat(starts - shift, counts)
        lpf, source = longest_previous_factors(raw, windows, length)
        later = lpf >= length
        shared = later.copy()
        shared[source[later]] = True
        found, firsts = [], []
        for a, n in zip(shift.tolist(), counts.tolist(), strict=True):
            found.append(runs(shared[a : a + n]))
            firsts.append(runs(shared[a : a + n] & ~later[a : a + n]))
        return pa.RecordBatch.from_arrays([pa.array([p[2] for p in group]), _ints([p[3] for p in group]), _structs(found), _structs(firsts)], names=["row_key", "lo", "found", "firsts"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BATCH_BYTES and held[-1][:2] != p[:2]:  # groups stay whole
                    yield flush(held)
                    held, size = [], 0
                held.append(p)
                size += len(p[4])
        if held:
            yield flush(held)

    return pieces.select(*KEY, "row_key", "lo", "body").repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, f"row_key long, lo int, found {RANGES}, firsts {RANGES}")


def _repeated(keyed: DataFrame, strings: DataFrame, length: int, gram: int, group: int, widths: tuple[int, ...]) -> DataFrame:
    """``strings`` (as ``STRINGS``; equal windows lie in strings with equal k1, k2). Returns row_key, lo, part, and
    ``found``, ``firsts`` as ``_compare`` does, for the strings in which something is found."""
    shared = stash(strings.groupBy(*KEY).agg(F.sum("copies").alias("t")).filter("t > 1").drop("t"))
    strings = stash(strings.join(shared, [*KEY]))
    kinds = stash(strings.groupBy(*KIND).agg(F.sum("copies").alias("copies"), F.min(F.struct("row_key", "lo", "n")).alias("rep")))
    several = stash(kinds.groupBy(*KEY).agg(F.count(F.lit(1)).alias("k")).filter("k > 1"))
    unclear = stash(kinds.join(several, [*KEY]).select(*KEY, "rep.*", ((F.col("k") > group) & F.lit(bool(widths))).alias("large")))

    def fetch(batches):
        for batch in batches:
            for row, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text, own = text.as_py().encode(), own.as_py()
                yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in own], pa.int64()) for k in KEY), pa.array([row] * len(own), pa.int64()), _ints([x["lo"] for x in own]), pa.array([text[x["lo"] : x["lo"] + x["n"] + length - 1] for x in own], pa.binary())], names=[*KEY, "row_key", "lo", "body"])

    small = _of_documents(keyed, unclear.filter("not large"), *KEY, "lo", "n").mapInArrow(fetch, "k1 long, k2 long, row_key long, lo int, body binary")
    partial = _compare(small, length)
    large = unclear.filter("large")
    if widths and not large.isEmpty():

        def cut(batches):
            for batch in batches:
                for row, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    text = text.as_py().encode()
                    found = [(*c, x["lo"]) for x in own.as_py() for c in cells(text[x["lo"] : x["lo"] + x["n"] + length - 1], length, gram, widths[0])]
                    k, d, lo, n, part = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([*_halves(k), *_halves(d), _ints([1] * len(lo)), pa.array([row] * len(lo), pa.int64()), _ints(np.add(lo, part)), _ints(n), _ints(part)], names=_NAMES)

        shorter = stash(_of_documents(keyed, large, "lo", "n").mapInArrow(cut, STRINGS))
        again = _repeated(keyed, shorter, length, gram, group, widths[1:])
        moved = lambda c: F.transform(c, lambda x: F.struct((x["a"] + F.col("lo") - F.col("part")).alias("a"), (x["b"] + F.col("lo") - F.col("part")).alias("b")))
        gathered = again.groupBy("row_key", "part").agg(*[F.array_sort(F.flatten(F.collect_list(moved(c)))).alias(c) for c in ("found", "firsts")])  # runs of one string
        partial = partial.unionByName(gathered.withColumnRenamed("part", "lo"))
    # windows of a kind that are repeated, and those of them whose first copy its representative has
    p = stash(partial.filter(F.size("found") > 0)).select(F.col("row_key").alias("r"), F.col("lo").alias("at"), "found", "firsts")
    joined = kinds.join(p, (F.col("rep.row_key") == F.col("r")) & (F.col("rep.lo") == F.col("at")), "left")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("rep.n").alias("b")))
    none = F.array().cast(RANGES)
    own = F.coalesce("found", none)
    first = F.when(F.size(own) == 0, whole).otherwise(F.col("firsts"))
    marked = stash(joined.select(*KIND, "rep", F.when(F.col("copies") > 1, whole).otherwise(own).alias("found"), own.alias("shared"), first.alias("firsts")).filter(F.size("found") > 0))
    hits = strings.join(marked, [*KIND])
    is_rep = (F.col("row_key") == F.col("rep.row_key")) & (F.col("lo") == F.col("rep.lo"))

    def firsts(batches):  # the windows of representatives without an earlier copy
        for batch in batches:
            out = []
            for found, shared, first in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                flag = np.zeros(max(x["b"] for x in found), bool)
                for x in found:
                    flag[x["a"] : x["b"]] = True
                for x in shared:
                    flag[x["a"] : x["b"]] = False
                for x in first:
                    flag[x["a"] : x["b"]] = True
                out.append(runs(flag))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), _structs(out)], names=["row_key", "lo", "part", "found", "firsts"])

    out = "row_key", "lo", "part", "found"
    reps = hits.filter(is_rep).select(*out, "shared", "firsts").mapInArrow(firsts, f"row_key long, lo int, part int, found {RANGES}, firsts {RANGES}")
    return reps.unionByName(hits.filter(~is_rep).select(*out, none.alias("firsts")))


def repeated_ranges(keyed: DataFrame, length: int = LENGTH, keep: str = "none", gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``keyed``: row_key, text (a written table, see ``with_row_keys``). Returns row_key, ``ranges`` (merged, in bytes of
    UTF-8) for documents with a repeated window."""
    if keep not in ("none", "first"):
        raise ValueError("keep: none or first")
    gram = min(gram, 1 << (length.bit_length() - 1))
    keyed = keyed.select("row_key", "text")

    def digests(batches):
        for batch in batches:
            for own, again in slice_strings(batch.column(0).to_numpy(), batch.column(1), length, gram):
                if own:
                    m, s, c, r, lo, n = zip(*own, strict=True)
                    zero = np.zeros(len(m), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(m, np.uint64).view(np.int64)), pa.array(zero), *_halves(s), _ints(c), pa.array(r, pa.int64()), _ints(lo), _ints(n), _ints(zero)], names=_NAMES)
                if again:
                    r, lo, n = zip(*again, strict=True)
                    none = pa.nulls(len(r), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, none, none, _ints([0] * len(r)), pa.array(r, pa.int64()), _ints(lo), _ints(n), _ints([0] * len(r))], names=_NAMES)

    everything = stash(keyed.mapInArrow(digests, STRINGS))
    widths = tuple(w for w in WIDTHS if w <= length - gram)
    hits = _repeated(keyed, everything.filter(F.col("k1").isNotNull()), length, gram, group, widths)
    empty = F.array().cast(RANGES)
    copies = everything.filter(F.col("k1").isNull()).select("row_key", "lo", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("found"), empty.alias("firsts"))
    found = hits.select("row_key", "lo", "found", "firsts").unionByName(copies)

    def joined_up(batches):
        for batch in batches:
            out = []
            for own in batch.column(1).to_pylist():
                ranges = []
                for x in own:
                    spans = [(y["a"], y["b"]) for y in x["found"]]
                    if keep == "first" and x["firsts"]:
                        flag = np.zeros(spans[-1][1], bool)
                        for a, b in spans:
                            flag[a:b] = True
                        for y in x["firsts"]:
                            flag[y["a"] : y["b"]] = False
                        spans = runs(flag)
                    ranges += [(x["lo"] + a, x["lo"] + b + length - 1) for a, b in spans]
                out.append(merge(ranges))
            yield pa.RecordBatch.from_arrays([batch.column(0), _structs(out)], names=["row_key", "ranges"])

    own = found.filter(F.size("found") > 0).groupBy("row_key").agg(F.collect_list(F.struct("lo", "found", "firsts")).alias("x"))  # those of one document
    return own.mapInArrow(joined_up, f"row_key long, ranges {RANGES}")


def shared_passages(keyed: DataFrame, words: int, gram: int = WORD_GRAM) -> DataFrame:
    """``keyed``: row_key, text (a written table). Returns the row_key of documents that hold ``words`` words in a row
    that another document holds too."""
    gram = min(gram, 1 << (words.bit_length() - 1))
    keyed = keyed.select("row_key", "text")
    documents = F.min("row_key").alias("a"), F.max("row_key").alias("b")

    def digests(batches):
        for batch in batches:
            for x in slice_word_strings(batch.column(0).to_numpy(), batch.column(1), words, gram):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["g", "d", "row_key", "lo", "n"])

    def digested(held):
        w, sizes = window_digests([x[3] for x in held], words)
        g, row, known = (np.repeat([x[i] for x in held], sizes) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(w), pa.array(row), pa.array(known)], names=["g", "w", "row_key", "known"])

    def cut(batches):
        held, size = [], 0
        for batch in batches:
            for row, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = text.as_py().encode()
                for x in own.as_py():
                    held.append((x["g"], row, x["known"], text[x["lo"] : x["lo"] + x["n"]]))
                    size += x["n"]
                    if size >= SLICE_BYTES:
                        yield digested(held)
                        held, size = [], 0
        if held:
            yield digested(held)

    strings = stash(keyed.mapInArrow(digests, "g long, d long, row_key long, lo int, n int"))
    shared = stash(strings.groupBy("g").agg(*documents).filter("a < b").select("g"))
    strings = stash(strings.join(shared, "g"))
    # any of equal strings of a document will do; numbers alone keep Spark from sorting
    kinds = stash(strings.groupBy("g", "d").agg(*documents, F.min_by("lo", "row_key").alias("lo"), F.max("n").alias("n")))
    settled = stash(strings.join(kinds.filter("a < b").select("g", "d"), ["g", "d"], "left_semi").select("row_key").distinct())
    unclear = strings.join(settled, "row_key", "left_anti").select("g").distinct()
    reps = kinds.join(unclear, "g", "left_semi").select("g", F.col("a").alias("row_key"), "lo", "n", (F.col("a") < F.col("b")).alias("known"))
    windows = stash(_of_documents(keyed, stash(reps), "g", "lo", "n", "known").mapInArrow(cut, "g long, w long, row_key long, known boolean"))
    common = windows.groupBy("g", "w").agg(*documents, F.max("known").alias("known")).filter("known or a < b").select("g", "w")
    found = windows.filter("not known").join(common, ["g", "w"], "left_semi").select("row_key")
    return settled.unionByName(found).distinct()


def remove_ranges(keyed: DataFrame, ranges: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """``keyed``: row_key, id, text. One row for each: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``,
    ``shares_passage`` (with ``passages``: 1 for the documents in it, else 0), ``kept`` (binary: what is left)."""
    marks = ranges if passages is None else ranges.join(passages.withColumn("shares_passage", F.lit(1)), "row_key", "full")
    marks = stash(marks.select(F.col("row_key").alias("r"), F.struct(*[c for c in marks.columns if c != "row_key"]).alias("marks")))
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["shares_passage"] if passages is not None else []), "kept"]

    def run(batches):
        for batch in batches:
            out = []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                raw, own = (text.as_py() or "").encode(), own.as_py() or {}
                ranges, shares = own.get("ranges") or [], own.get("shares_passage") or 0
                done, parts = 0, []
                for x in ranges:
                    parts.append(raw[done : x["a"]])
                    done = x["b"]
                kept = b"".join(parts) + raw[done:] if ranges else raw
                out.append((len(raw), len(raw) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), shares, kept))
            a, b, c, d, e, f = zip(*out, strict=True) if out else ((),) * 6
            columns = {"n_bytes": pa.array(a, pa.int64()), "n_removed": pa.array(b, pa.int64()), "n_spans": pa.array(c, pa.int64()), "kept_sha256": pa.array(d, pa.string()), "shares_passage": pa.array(e, pa.int64()), "kept": pa.array(f, pa.binary())}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(columns[x] for x in names[1:])], names=names)

    joined = _with(keyed, marks, "marks", True).select("id", "text", "marks")
    kind = keyed.schema["id"].dataType.simpleString()
    types = {"id": kind, "kept_sha256": "string", "kept": "binary"}
    return joined.mapInArrow(run, ", ".join(f"{x} {types.get(x, 'long')}" for x in names))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none", text_col: str = "text", id_col: str = "doc_id", gram: int = GRAM, group: int = GROUP, words: int = 0) -> DataFrame:
    """One row for each document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, with ``words`` also
    ``shares_passage``, and ``kept``."""
    keyed = with_row_keys(docs, id=id_col, text=text_col)
    passages = shared_passages(keyed, words) if words else None
    return remove_ranges(keyed, repeated_ranges(keyed, length, keep, gram, group), passages).withColumnRenamed("id", id_col)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")

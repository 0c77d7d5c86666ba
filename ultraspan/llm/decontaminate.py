"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of canonical tokens: words in lower case, and typed placeholders for numbers, for names
(capitalised words, wherever they stand) and for units (after a number). Windows of ``WINDOW`` tokens of the benchmark
items are hash-joined with those of the documents. The windows of a copy are kept if their slots are consistent: equal
values in the item stand for equal values in the document and the other way round. So a passage is found whether it is
copied or re-parameterised. Windows of the plain words in lower case are joined as well, as a form of their own: they
find copies whose case was changed. A document is contaminated by an item if it has at least ``COVER`` of the item's
windows in either form.

A Bloom filter of the benchmark's window hashes (of fixed size) lets a pass over the documents emit only windows that
may match; the join decides. A window that very many documents have is a skewed key of that join only, which Spark
splits; its matches are grouped by document and item.

Items of fewer than ``WINDOW`` tokens form one window of their own length, ``LEAST`` tokens at least; windows with
fewer than ``LEAST_WORDS`` words besides placeholders say nothing and don't count, unless an item has no other.

Edge cases: null and empty texts have no windows; repeated documents are judged each; repeated items count once each;
item ids may have any type that can be grouped, also null; empty tables give empty results; other columns are ignored;
texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stash

WINDOW, LEAST, LEAST_WORDS, COVER = 8, 4, 4, 0.5
#: Bits of the filter: 1 MB however large the benchmark is.
FILTER_BITS = 23
#: Names of units that may follow a number.
UNITS = frozenset("mm cm m km in ft yd mi mile miles mg g kg t oz lb lbs ml l s sec seconds min mins minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent mph kph w kw v a hz khz mhz b kb mb gb tb".split())
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
_NUMBER, _NAME, _UNIT = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in ("<number>", "<name>", "<unit>"))
_MULT = np.array([xxhash.xxh3_64_intdigest(f"place {i}") | 1 for i in range(WINDOW)], np.uint64)
#: Forms of a text, each with windows of its own.
TEMPLATE, PLAIN = 0, 1


class _Tokens(dict):
    """Numbers distinct tokens as they come, with their properties."""

    MOST = 200_000

    def __init__(self):
        self.plain, self.form, self.kind = np.zeros(4096, np.uint64), np.zeros(4096, np.uint64), np.zeros(4096, np.uint8)

    def __missing__(self, t: str) -> int:
        n = len(self)
        if n == len(self.kind):
            self.plain, self.form, self.kind = (np.concatenate([x, np.zeros_like(x)]) for x in (self.plain, self.form, self.kind))
        low = t.lower()
        number = t[0].isdigit()
        name = t[0].isupper() and not (len(t) > 1 and t.isupper())
        self.plain[n] = xxhash.xxh3_64_intdigest(low)
        self.form[n] = _NUMBER if number else _NAME if name else self.plain[n]
        self.kind[n] = 1 * number + 2 * name + 4 * (low in UNITS)
        self[t] = n
        return n


def _canonical(text: str, seen: _Tokens) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their hashes in the two forms, and whether each is a placeholder in the template."""
    tokens = _TOKEN.findall(text)
    ids = np.fromiter(map(seen.__getitem__, tokens), np.int64, len(tokens))
    kind, form = seen.kind[ids], seen.form[ids]
    unit = np.flatnonzero((kind[1:] & 4 > 0) & (kind[:-1] & 1 > 0)) + 1
    form[unit] = _UNIT
    slot = kind & 3 > 0
    slot[unit] = True
    return tokens, form, seen.plain[ids], slot


def _windows(h: np.ndarray, size: int, form: int) -> np.ndarray:
    m = len(h) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, 2 * size + form, np.uint64)
    for i in range(size):
        x = h[i : i + m] * _MULT[i]
        out = (out ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x
    return out ^ (out >> np.uint64(32))


_SHIFTS = tuple(np.uint64(x) for x in (0, 20, 41))
_MASK = np.uint64((1 << FILTER_BITS) - 1)


def _slots(tokens: list[str], slot: np.ndarray, start: int, size: int, form: int) -> list[str]:
    return [tokens[j].lower() for j in range(start, start + size) if slot[j]] if form == TEMPLATE else []


def _columns(rows: list[tuple], types: list[pa.DataType]) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    return [pa.array(c, t) for c, t in zip(columns, types, strict=True)]


_LIST = pa.list_(pa.string())


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, form, hash, position, slots (the placeholders' values), size (tokens), n_windows of the item in that form."""
    names = ["item", "form", "hash", "position", "slots", "size", "n_windows"]
    types = [pa.int32(), pa.int64(), pa.int32(), _LIST, pa.int32(), pa.int32()]

    def cut(batches):
        seen = _Tokens()
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens, h, plain, slot = _canonical(text or "", seen)
                size = min(WINDOW, len(tokens))
                if size < LEAST:
                    continue
                free = size - np.convolve(slot, np.ones(size, int), "valid")
                good = np.flatnonzero(free >= LEAST_WORDS) if (free >= LEAST_WORDS).any() else np.arange(len(free))
                for form, own, keep in ((TEMPLATE, h, good), (PLAIN, plain, np.arange(len(free)))):
                    w = _windows(own, size, form)
                    rows += [(form, int(w[k].view(np.int64)), int(k), _slots(tokens, slot, k, size, form), size, len(keep)) for k in keep]
                    at += [i] * len(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *_columns(rows, types)], names=names)

    own = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).distinct()
    return own.mapInArrow(cut, f"item {own.schema['item'].dataType.simpleString()}, form int, hash long, position int, slots array<string>, size int, n_windows int")


def find_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", cover: float = COVER, key: str | None = None) -> DataFrame:
    """One row for each contaminated document and item: ``row_key`` (of the row in ``docs``), id, ``item_id``,
    ``matched`` and ``n_windows`` (windows of the item, in the form with the larger share), ``coverage``,
    ``reparameterised`` (slot values differ).

    ``key``: a column of ``docs`` that tells rows apart; without one, rows are numbered in the only pass over them.
    """
    spark = docs.sparkSession
    bench = stash(benchmark_windows(items, item_col))
    sizes = sorted(r[0] for r in bench.select("size").distinct().collect())  # WINDOW values at most

    def mark(batches):
        for batch in batches:
            w = batch.column(0).to_numpy().view(np.uint64)
            for shift in _SHIFTS:
                bits = np.unique((w >> shift) & _MASK)
                yield pa.RecordBatch.from_arrays([pa.array((bits >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bits & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    words = bench.select("hash").distinct().mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # 2^(FILTER_BITS-6) rows at most
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    if len(words):
        table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(table.view(np.uint8))
    names, types = ["row_key", "id", "hash", "slots", "at"], [pa.int64(), _LIST, pa.int32()]

    def probe(batches):
        listed = np.unpackbits(shared.value, bitorder="little").astype(bool)
        seen = _Tokens()

        def out(batch, at, rows):
            at = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *_columns(rows, types)], names=names)

        for batch in batches:
            at, rows = [], []
            for r, text in enumerate(batch.column(2)):
                text = text.as_py()
                if not text or not sizes:
                    continue
                if len(seen) > _Tokens.MOST:
                    seen = _Tokens()
                tokens, h, plain, slot = _canonical(text, seen)
                for form, own in ((TEMPLATE, h), (PLAIN, plain)):
                    for size in sizes:
                        w = _windows(own, size, form)
                        hit = np.arange(len(w))
                        for shift in _SHIFTS:
                            hit = hit[listed[(w[hit] >> shift) & _MASK]]
                        rows += [(int(w[i].view(np.int64)), _slots(tokens, slot, i, size, form), int(i)) for i in hit]
                        at += [r] * len(hit)
                if len(rows) > 20000:
                    yield out(batch, at, rows)
                    at, rows = [], []
            yield out(batch, at, rows)

    own = F.col(key) if key else F.monotonically_increasing_id()
    keyed = docs.select(own.alias("row_key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    possible = keyed.mapInArrow(probe, f"row_key long, id {keyed.schema['id'].dataType.simpleString()}, hash long, slots array<string>, at int")
    b = bench.select("item", "form", "hash", "position", "n_windows", F.col("slots").alias("own"))

    def one_to_one(pairs: Column) -> Column:
        n = F.size(F.array_distinct(pairs))
        return (n == F.size(F.array_distinct(F.transform(pairs, lambda x: x["slots"])))) & (n == F.size(F.array_distinct(F.transform(pairs, lambda x: x["own"]))))

    matched = possible.join(b, "hash").filter(F.size("slots") == F.size("own")).withColumn("pairs", F.arrays_zip("slots", "own")).filter(one_to_one(F.col("pairs")))
    # a copy's windows lie on one diagonal (position in the text less position in the item); its values must be
    # consistent over all of them, else only its windows with equal values count
    copies = matched.groupBy("row_key", "item", "form", (F.col("at") - F.col("position")).alias("diagonal")).agg(
        F.first("id").alias("id"),
        F.first("n_windows").alias("n_windows"),
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),  # those of one copy of an item
        F.collect_set("position").alias("positions"),
        F.collect_set(F.when(F.col("slots") == F.col("own"), F.col("position"))).alias("equal"),
    )
    best = F.struct(F.round(F.col("matched") / F.col("n_windows"), 6).alias("coverage"), F.col("form"), F.col("matched"), F.col("n_windows"), F.col("changed").alias("reparameterised"))
    found = (
        copies.withColumn("fits", one_to_one(F.col("pairs")))
        .withColumn("changed", F.col("fits") & (F.size("equal") < F.size("positions")))
        .groupBy("row_key", "item", "form")
        .agg(F.first("id").alias("id"), F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("fits"), F.col("positions")).otherwise(F.col("equal")))))).alias("matched"), F.first("n_windows").alias("n_windows"), F.max("changed").alias("changed"))
        .filter(F.col("matched") >= F.col("n_windows") * cover)
        .groupBy("row_key", "item")
        .agg(F.first("id").alias("id"), F.max(best).alias("b"))
    )
    return found.select("row_key", F.col("id").alias(id_col), F.col("item").alias("item_id"), "b.matched", "b.n_windows", "b.coverage", "b.reparameterised")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: pairs of document and benchmark item."""
    return find_contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("row_key")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir, stash

__all__ = ["WORD", "ascii_lower", "bounded_sample", "fold", "fresh", "read_table", "shared_dir", "stash", "with_keys", "with_row_keys", "without_keys"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of 64 row keys that may be broadcast (16 bytes each): the keys of 32 million neighbouring rows. More are shuffled.
MOST_WORDS = 500_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column of ``taken`` is called so."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def with_row_keys(docs: DataFrame, key: str = "row_key", **columns: str) -> DataFrame:
    """``key`` (distinct for every row, also where ids repeat or are null) and columns of ``docs`` under new names; all
    columns if none is named. Written once: a job that scans it again sees the same keys, however many executors there
    are then and however they cut the files of ``docs``."""
    own = [F.col(c).alias(n) for n, c in columns.items()] or [docs[c] for c in docs.columns]
    return stash(docs.select(F.monotonically_increasing_id().alias(key), *own), "zstd")


def _marked(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, Column, tuple[str, str]]:
    """``rows`` with a word of bits, whether the row's key is in it, and the two columns added."""
    word, bits = fresh("key_word", rows.columns), fresh("key_bits", rows.columns)
    bit = F.expr("shiftleft(1L, cast(row_key & 63 as int))")
    words = stash(keys.groupBy(F.shiftright("row_key", 6).alias(word)).agg(F.bit_or(bit).alias(bits)))
    words = F.broadcast(words) if words.count() <= MOST_WORDS else words
    has = F.coalesce(F.getbit(F.col(bits), F.col(key).bitwiseAND(F.lit(63)).cast("int")), F.lit(0)) == 1
    return rows.join(words, F.shiftright(F.col(key), 6) == F.col(word), "left"), has, (word, bits)


def with_keys(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` (as ``with_row_keys`` gives it) is among ``keys`` (row_key). Neighbouring keys are 64 to a word
    of bits, so large rows stay where they are also when very many keys are asked for."""
    marked, has, added = _marked(rows, key, keys)
    return marked.filter(has).drop(*added)


def without_keys(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is not among ``keys``, as ``with_keys``."""
    marked, has, added = _marked(rows, key, keys)
    return marked.filter(~has).drop(*added)


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change other letters)."""
    return F.translate(col, UPPER, UPPER.lower())


def fold(id_col: Column) -> Column:
    """crc32 of the id's text, modulo 4; fold 2 is held out from all training. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def bounded_sample(df: DataFrame, label: str, key: Column, bound: int) -> DataFrame:
    """About ``bound`` rows of each label value at most, chosen by a hash of ``key``.

    The share kept of a label is ``bound / rows of that label``, so the choice doesn't need a sort and doesn't
    depend on partitioning. Used only to fit classifiers.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row for each label value
    rate = F.lit(1.0)
    for value, n in counts.items():
        if n > bound:
            rate = F.when(F.col(label) == F.lit(value), bound / n).otherwise(rate)
    u = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), key), 11) / F.lit(float(1 << 53))
    return df.filter(u < rate)

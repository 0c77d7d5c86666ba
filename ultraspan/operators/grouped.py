"""Numpy work on groups of rows, many small groups at a time.

A group is not a call of Python: rows are dealt by their keys and sorted, and a function gets whole groups, as many as an
Arrow batch holds, with the place where each begins. The last group of a batch waits for the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows where a new group begins; nulls are equal."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        x = table.column(k).combine_chunks()
        a, b = x.slice(1), x.slice(0, len(x) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        null = x.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= differ | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str | T.StructType) -> DataFrame:
    """``fn(rows, starts)`` on whole groups of equal ``keys``, sorted by ``order``; what it returns has ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            # a batch that only goes on with the group that waits is put by as it is, so a long group is joined once
            if waiting and len(_starts(pa.concat_tables([waiting[-1].slice(len(waiting[-1]) - 1), table]), keys)) == 1:
                waiting.append(table)
                continue
            table = pa.concat_tables([*waiting, table])
            starts = _starts(table, keys)
            if len(starts) > 1:
                yield from fn(table.slice(0, starts[-1]), starts[:-1]).to_batches()
            waiting = [table.slice(starts[-1])]
        if waiting:
            table = pa.concat_tables(waiting)
            yield from fn(table, _starts(table, keys)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)

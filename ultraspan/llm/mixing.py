"""Mixing sources to target weights (DataFrame functions only).

Every document gets a hash-random key, from its id and text (rows without an id are spread too). Within a source the documents, in key order, form a sequence of words;
the source's budget is a number of words to take from that sequence, starting again when it ends. Prefix sums are
computed in two levels, so that no task holds a source: the key range of a source is cut into slices of a few
hundred documents, running sums inside a slice are added to the running sum over slices.

Edge cases: a null text has size 0; a null source is a source of its own, after all others; documents that repeat
are separate documents; an empty table gives an empty result; other columns are ignored; sources of size 0 have
target 0; when all sizes are 0 nothing is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, read_table, stash

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = "mix"
ROWS_PER_SLICE = 512


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes``: source, source_rows, source_size. Adds ``target``: words to take from each source.

    Sources in code-point order (null last) get the weights in turn. The total, ``share`` times all sizes, is dealt
    by weight; no target exceeds ``cap`` times the source's size, what is above goes to the others by weight.
    In order of cap / weight the sources that hit their cap come first, so running sums find the water level.
    One row for each source: the only windows without a partition key run over these rows.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    everything = W.partitionBy()
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    level = (F.col("total") - F.coalesce(F.sum("most").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("full", F.col("weight") * level >= F.col("most"))
        .withColumn("left", F.col("total") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everything))
        .withColumn("open", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything))
        .withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * (F.col("left") / F.when(F.col("open") > 0, F.col("open")))))
        .select("source", "source_rows", "source_size", "target")
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """One row for each document: its id and source, ``size`` in words, ``source_size``, ``target`` of its source,
    ``epochs`` (whole passes over the source), ``position`` (words of the source before it in the random order) and
    ``taken`` (words the mix takes from it, repeats counted).

    The words taken from a source add up to its target rounded to a whole number: the document in which the budget
    ends gives its first words only.
    """
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))), 1, 13), 16, 10).cast("long")
    sized = stash(
        docs.select(
            F.col(id_col).alias(id_col),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            key.alias("key"),
        )
    )
    sizes = sized.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows"), F.sum("size").alias("source_size"))
    # both tables below are written, so Spark knows how large they are when it picks the join
    targets = stash(source_targets(sizes, weights, share, cap)).withColumnRenamed("source", "t_source")
    slices = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / rows_per_slice))
    placed = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("slice", F.least(slices - 1, F.floor(F.col("key") / F.lit(float(1 << 52)) * slices)))
        .drop("t_source", "source_rows")
    )
    sums = placed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = F.sum("slice_size").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    starts = stash(sums.select(F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), F.coalesce(earlier, F.lit(0)).alias("start")))
    inside = F.sum("size").over(W.partitionBy("source", "slice").orderBy("key", id_col, "size").rowsBetween(W.unboundedPreceding, -1))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("position")
    return (
        placed.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice")))
        .withColumn("position", F.col("start") + F.col("inside"))
        .withColumn("budget", F.coalesce(budget, F.lit(0)))
        .withColumn("epochs", epochs)
        .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest)))
        .select(id_col, "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "epochs", "position", "taken")
    )


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS k
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM sizes),
levels AS (
  SELECT *, weight * ((total - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) >= most AS capped
  FROM weighed),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN most
              ELSE weight * ((total - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()) END AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position,
         round(t.target)::BIGINT AS budget,
         CASE WHEN t.source_size > 0 THEN round(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - position)))::BIGINT AS taken
FROM placed
"""

"""Our tables, made from the star-schema tables: boxes and signals from ``events``, frames from ``embeddings``,
annotations from ``lineitem`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Grid of the frames made from vectors, and of the boxes made from events (a frame is a minute there).
DT, DF, BINS = 0.001024, 1000.0, 64
MINUTES = 2880


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ids give frequencies; even ones are predictions (side 0), odd ones truth (side 1)."""
    start = F.hour("ts") * 60 + F.minute("ts")
    low = F.col("event_id") * 7 % BINS
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("recording"),
        F.col("event_id").alias("box_id"),
        low.cast("long").alias("freq_start"),
        (low + F.col("event_id") % 11).cast("long").alias("freq_end"),
        start.cast("long").alias("t_start"),
        (start + F.floor("value")).cast("long").alias("t_end"),
        F.col("event_type").alias("label"),
        F.col("value").alias("score"),
        (F.col("event_id") % 2).cast("long").alias("side"),
    )


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).filter("side = 0").drop("side")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).filter("side = 1").drop("side")


def box_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for every recording with boxes: 60 s and 1000 Hz a pixel."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("recording")).distinct()
    return rows.select("recording", F.lit(0.0).alias("t0"), F.lit(60.0).alias("dt"), F.lit(MINUTES).cast("long").alias("n_time"), F.lit(0.0).alias("f0"), F.lit(DF).alias("df"), F.lit(80).cast("long").alias("n_freq"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("recording"), (F.row_number().over(order) - 1).cast("long").alias("frame"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("mags"))


def frame_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("string").alias("recording")).agg(F.count(F.lit(1)).alias("n_time"))
    return n.select("recording", F.lit(0.0).alias("t0"), F.lit(DT).alias("dt"), "n_time", F.lit(0.0).alias("f0"), F.lit(DF).alias("df"), F.lit(BINS).cast("long").alias("n_freq"))


def signal_chunks(spark: SparkSession, sf_dir: str, chunk: int = 1024) -> DataFrame:
    """Each user's values in order of time."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    at = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("recording"), F.col("value").alias("x"), (F.row_number().over(order) - 1).cast("long").alias("s"), F.count(F.lit(1)).over(W.partitionBy("user_id")).alias("n_samples"))
    return (
        at.withColumn("chunk_id", F.floor(F.col("s") / chunk))
        .groupBy("recording", "n_samples", "chunk_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "x"))), lambda p: p["x"]).alias("samples"))
        .withColumn("sample_start", F.col("chunk_id") * chunk)
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("recording")).agg(F.count(F.lit(1)).alias("n_samples"))
    return n.select("recording", F.col("recording").alias("name"), (F.col("recording").cast("long") % 5).cast("string").alias("folder"), F.lit(16).alias("sample_rate"), "n_samples", (F.col("n_samples") / 16).alias("duration"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each event: seconds and Hz, some reaching over the ends of the grid."""
    e = table(spark, sf_dir, "events")
    begin = (F.hour("ts") * 60 + F.minute("ts")) * 60.0 + F.second("ts") * 130.0 - 3000.0
    low = (F.col("event_id") * 7 % BINS) * 1300.0 - 2000.0
    return e.select(
        (F.col("user_id") % 5).cast("string").alias("folder"), F.col("user_id").cast("string").alias("begin_file"), F.col("event_id").alias("box_id"), begin.alias("begin_time"), (begin + F.col("value") * 60.0).alias("end_time"), low.alias("low_freq"), (low + (F.col("event_id") % 11) * 900.0).alias("high_freq"), F.col("event_type").alias("usv_type")
    )


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configuration for each part, by arithmetic."""
    n = F.col("p_partkey") % 25
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("config_id"), (n % 5 + 2).cast("double").alias("num_iter"), F.lit(0.0).alias("smoothing"), (0.5 + n * 0.015).alias("flood_threshold"), (0.2 + n * 0.06).alias("balloon_latent"), (1.0 + n % 3).cast("double").alias("sigma"))

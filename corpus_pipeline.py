"""A training-corpus pipeline: each stage reads what the stage before it kept, written as Parquet.

Stages: drop toxic documents; keep one document of each group of near duplicates (five-word shingles, similarity 0.8);
drop documents contaminated by benchmark items; redact personal data; mix the sources to their target weights.

Every stage takes (spark, docs, sf_dir) and handles nulls in any column, empty and very long texts, repeated rows and
empty tables as its operator says. Of a near-duplicate group the document with the smallest id stays (nulls last, then
the first row), a repeated id doesn't drop other rows: rows are told apart by a key that is written with them, not by id.
Columns besides those of ``documents`` pass through, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ultraspan.llm import decontaminate, mixing, ngram_join, pii, toxicity
from ultraspan.llm.common import fresh, read_table, shared_dir, stash, with_row_keys, without_keys

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, unchanged. The model learns from labels outside fold 2."""
    return toxicity.drop_toxic(docs, toxicity.fit_on_labels(spark, docs, sf_dir))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key column, written, and that column's name."""
    key = fresh("row_key", docs.columns)
    return with_row_keys(docs, key), key


def _without(keyed: DataFrame, key: str, rejected: DataFrame) -> DataFrame:
    """``rejected``: row_key. The texts aren't shuffled."""
    return without_keys(keyed, key, rejected).drop(key)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links; all documents without a link."""
    keyed, key = _keyed(docs)
    rows = keyed.select(F.col(key).alias("row_key"), F.col("doc_id").alias("id"), "text")
    found = stash(ngram_join.jaccard_components(rows, SHINGLE_WORDS, SIMILARITY_PERCENT)).withColumnRenamed("row_key", "k")
    ids = rows.select("row_key", "id").join(found, F.col("row_key") == F.col("k"))
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("row_key").alias("row"))
    first = stash(ids.groupBy("root").agg(F.min(order).alias("first"))).select(F.col("first.row").alias("kept"))
    return _without(keyed, key, found.join(first, F.col("k") == F.col("kept"), "left_anti").select(F.col("k").alias("row_key")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, unchanged."""
    keyed, key = _keyed(docs)
    return _without(keyed, key, decontaminate.find_contaminated(keyed, read_table(spark, sf_dir, "benchmark"), key=key))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the kind in brackets and ``n_chars`` set to the new length."""
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return pii.redact_documents(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), length)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture as a manifest: the documents it takes words from, how many, and the source's size and target."""
    return mixing.mix_sources(docs).filter("taken > 0").select("doc_id", "source", "size", "source_size", "target", "epochs", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix),
]

#: The toxicity model, template windows and bootstrapped patterns have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

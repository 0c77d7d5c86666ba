"""Language identification with language-bitmask n-gram filters.

One array of bit masks serves as a Bloom filter for every language at once: bit l of a slot belongs to the filter of
language l (more than 64 languages have several words a slot). The AND of the slots that an n-gram hashes to has the bits
of all languages containing it. For a text, the
number of its n-grams each language contains, corrected for the filter's false positives, decides.

Texts are read as UTF-8 bytes with ASCII letters lower-cased, other ASCII characters as blanks and a blank at either
end; n-grams are ``N`` bytes long. A language contains an n-gram when it is frequent enough there compared with the
language where it is most frequent.

Edge cases: a text that is null or has no letter is ``und`` with score 0; so is every text when there is no labelled
row to learn from. Equal counts go to the language with more training rows, then by code point. An empty table gives an
empty result. Repeated documents, very long texts and other columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import added_schema, text_slices, with_columns
from .common import bounded_sample, fold, read_table

N = 4
#: Slots of the filter array (its size is fixed) and hash functions.
SLOT_BITS, HASHES = 20, 2
#: Most labelled rows of each language used to learn its n-grams.
SAMPLE_PER_LANGUAGE = 3000
LEAST_COUNT, LEAST_SHARE = 3, 0.15
#: Languages in a word of a slot.
WORD_BITS = 64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _grams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, has an ASCII letter, n-grams, row of each n-gram)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    padded = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar(" " * (N - 2), pa.large_string()), pa.scalar("", pa.large_string()))
    for first, end, offsets, raw in text_slices(padded):
        letter = np.add.reduceat(_LETTER[raw], offsets[:-1], dtype=np.int64) > 0
        b = _FOLD[raw]
        # capital letters of the Latin-1 block: the byte after C3
        upper = np.flatnonzero(b[:-1] == 0xC3) + 1
        upper = upper[(b[upper] >= 0x80) & (b[upper] <= 0x9E) & (b[upper] != 0x97)]
        b[upper] += 0x20
        m = len(b) - N + 1
        if m <= 0:
            yield first, end, letter, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            continue
        g = np.zeros(m, np.uint64)
        for i in range(N):
            g = (g << np.uint64(8)) | b[i : i + m]
        row = np.repeat(np.arange(end - first), np.diff(offsets))[:m]
        good = (np.arange(m) + N <= offsets[1:][row]) & ~((b[:m] == 32) & (b[1 : m + 1] == 32))
        yield first, end, letter, g[good], row[good]


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    mixed = grams ^ (grams >> np.uint64(17))
    return [((mixed * np.uint64(odd)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for odd in _ODD[:HASHES]]


class LanguageModel:
    """``masks`` [words x slots]; ``rates``: false-positive rate of each language's filter."""

    def __init__(self, languages: list[str], masks: np.ndarray, prior: np.ndarray):
        self.languages, self.masks, self.prior = languages, masks, prior
        fill = np.array([float(((masks[i // WORD_BITS] >> np.uint64(i % WORD_BITS)) & np.uint64(1)).mean()) for i in range(len(languages))])
        self.rates = fill**HASHES


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", bound: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learns from the rows given (the caller leaves out held-out ones) that have a text and a language."""
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(key_col).alias("key")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    words = max(1, -(-len(languages) // WORD_BITS))
    index = {x: i for i, x in enumerate(languages)}

    def count(batches):
        for batch in batches:
            langs = np.array([index[x] for x in batch.column(0).to_pylist()], np.uint64)
            for first, end, _, grams, row in _grams(batch.column(1)):
                for i in np.unique(langs[first:end]):
                    g, c = np.unique(grams[langs[first:end][row] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i, np.int32)), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])

    grams = bounded_sample(rows, "lang", F.col("key"), bound).select("lang", "text").mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).cache()
    totals = {r[0]: float(r[1]) for r in grams.groupBy("lang").agg(F.sum("n")).collect()}
    share = F.lit(0.0)
    for i, total in totals.items():
        share = F.when(F.col("lang") == i, F.col("n") / total).otherwise(share)
    held = (
        grams.withColumn("share", share)
        .groupBy("gram")
        .agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "n", "share")).alias("ls"))  # a row for each language at most
        .select("gram", F.filter("ls", lambda x: (x["n"] >= LEAST_COUNT) & (x["share"] >= LEAST_SHARE * F.col("most"))).alias("ls"))
        .select("gram", F.explode("ls").alias("x"))
        .groupBy("gram", F.floor(F.col("x.lang") / WORD_BITS).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x.lang") % WORD_BITS)).alias("mask"))
    )

    def insert(batches):
        for batch in batches:
            g, word, mask = batch.column(0).to_numpy().view(np.uint64), batch.column(1), batch.column(2)
            for s in _slots(g):
                yield pa.RecordBatch.from_arrays([pa.array(s), word, mask], names=["slot", "word", "mask"])

    masks = np.zeros((words, 1 << SLOT_BITS), np.uint64)
    slots = held.mapInArrow(insert, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()  # 2^SLOT_BITS rows a word at most
    if len(slots):
        masks[slots["word"].to_numpy(), slots["slot"].to_numpy()] = slots["mask"].to_numpy().view(np.uint64)
    grams.unpersist()
    prior = np.array([counts[x] for x in languages], float)
    return LanguageModel(languages, masks, prior / max(prior.sum(), 1))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``lang_score`` to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^SLOT_BITS words

    def run(batches):
        m = shared.value
        k = len(m.languages)
        width = np.uint8 if k <= 8 else np.uint16 if k <= 16 else np.uint32 if k <= 32 else np.uint64
        masks = m.masks.astype(width)
        order = sorted(range(k), key=lambda i: (-m.prior[i], m.languages[i]))
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            preds, scores = [], []
            for first, end, letter, grams, row in _grams(texts):
                n = end - first
                held = [np.full(len(grams), np.iinfo(width).max, width) for _ in masks]
                for s in _slots(grams):
                    for h, mask in zip(held, masks, strict=True):
                        h &= mask[s]
                total = np.bincount(row, minlength=n).astype(float)
                share = np.empty((n, k))
                for i in range(k):
                    hits = np.bincount(row, weights=(held[i // WORD_BITS] >> width(i % WORD_BITS)) & width(1), minlength=n)
                    share[:, i] = np.maximum(hits - m.rates[i] * total, 0) / (1 - min(m.rates[i], 0.999))
                share += 0.01 * m.prior
                best = np.array(order)[share[:, order].argmax(axis=1)] if k else np.zeros(n, int)
                score = share[np.arange(n), best] / share.sum(axis=1) if k else np.zeros(n)
                for r in range(n):
                    if k and (letter[r] or any(c.isalpha() for c in texts[first + r].as_py() or "")):
                        preds.append(m.languages[best[r]])
                        scores.append(float(min(1.0, score[r])))
                    else:
                        preds.append("und")
                        scores.append(0.0)
            yield with_columns(batch, {"lang_pred": pa.array(preds, pa.string()), "lang_score": pa.array(scores, pa.float64())})

    return docs.mapInArrow(run, added_schema(docs.schema, "lang_pred string, lang_score double"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.filter(fold(F.col("doc_id")) != 2))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))

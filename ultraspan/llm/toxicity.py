"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals make document scores.

Tokens get their training labels by distant supervision: a word of a document labelled toxic is a toxic token if the
word, or the beginning of it, is far more frequent (by documents) in toxic documents than elsewhere. The field has two tags; a token's features
are hashed: the word, its first and last letters, the words before and after. It is fitted by gradient ascent with
exact forward-backward sums on a bounded sample of sentences. Inference runs forward-backward over every sentence of
every text; the marginals of a document (largest, sum, share) go through a logistic regression to its score, and words
whose marginal is 0.5 or more are the offending spans.

A chain ends at ``. ! ?``, at a line break, or after ``CHAIN`` words; all words of a text are tagged, whatever its
length.

Edge cases: null and empty texts have no words, no spans and the score of a document without evidence; without any
labelled toxic row, or without a word in any text of the sample, nothing can be learned and all scores are 0; repeated documents are scored each and alike; an empty table gives an empty result;
a word that is equally a seed by itself and by its beginning counts once; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import added_schema, with_columns
from .common import bounded_sample, fold, read_table, stash

#: Most labelled documents of either class, and most sentences without a toxic word, used to fit.
SAMPLE_DOCS, SAMPLE_SENTENCES = 3000, 30000
#: A seed word: in this many toxic documents, with a log-odds ratio and a log-likelihood ratio of so much at least. (A
#: word of one group of copies passes the second test easily, not the first.)
LEAST_DOCS, LEAST_ODDS, LEAST_RATIO = 4, 3.5, 20.0
CHAIN = 64
DIM = 1 << 15
#: Tokens whose chains are scored at once.
TOKENS = 200_000
THRESHOLD = 0.3
STEPS = 60
_TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
_ENDS = frozenset(".!?\n")


def folded(text: str) -> str:
    """Lower case, letter for letter, so that offsets hold in the text itself: letters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _features(word: str) -> tuple[int, int, int, int, int]:
    """Slots of the word, its beginning, its end, and of the word as a left and as a right neighbour."""
    h = lambda kind, s: zlib.crc32(f"{kind}{s}".encode()) % DIM
    return h("w", word), h("p", word[:5]), h("s", word[-4:]), h("l", word), h("r", word)


def _start(word: str) -> str:
    """A word's beginning, as a seed of its own: inflected forms are rare one by one."""
    return f"{word[:5]}*"


class Words(dict):
    """Numbers distinct words as they come; ``table`` has the feature slots of each. Number 0 ends a chain."""

    MOST = 200_000

    def __init__(self, width: int, row):
        super().__init__({c: 0 for c in _ENDS})
        self.row, self.n, self.table = row, 1, np.zeros((4096, width))

    def __missing__(self, word: str) -> int:
        if self.n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.n] = self.row(word)
        self[word] = self.n
        self.n += 1
        return self.n - 1

    def numbers(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, _TOKEN.findall(folded(text))), np.int64)


def chains(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each chain in a sequence of word numbers (0: an end mark, in no chain)."""
    word = ids > 0
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    lengths = ends - starts
    if len(lengths) and lengths.max() > CHAIN:
        pieces = -(-lengths // CHAIN)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + k * CHAIN
        lengths = np.minimum(np.repeat(ends, pieces) - starts, CHAIN)
    return starts, lengths


def forward_backward(emission: np.ndarray, starts: np.ndarray, lengths: np.ndarray, into: float, stay: float, out: float) -> tuple[np.ndarray, np.ndarray]:
    """For each position of the chains: log-odds of the toxic tag from the left (with its emission) and from the right.

    Potentials are relative to staying untagged: ``into`` a toxic run, ``stay`` in it, ``out`` of it. With two tags the
    recursions are on one number, and all chains advance together.
    """
    left, right = np.zeros(len(emission)), np.zeros(len(emission))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains longer than t
    r = None
    for t in range(longest):
        at = starts[: alive[t]] + t
        r = emission[at] + (into if t == 0 else np.logaddexp(into, stay + r[: alive[t]]) - np.logaddexp(0.0, out + r[: alive[t]]))
        left[at] = r
    s = np.zeros(0)
    for t in range(longest - 2, -1, -1):
        n = alive[t + 1]
        s = np.concatenate([s, np.zeros(n - len(s))])
        at = starts[:n] + t
        nxt = emission[at + 1] + s
        s = np.logaddexp(out, stay + nxt) - np.logaddexp(0.0, into + nxt)
        right[at] = s
    return left, right


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


class ToxicityModel:
    def __init__(self, weights: np.ndarray, links: tuple[float, float, float], document: np.ndarray | None):
        self.weights, self.links, self.document = weights, links, document

    def row(self, word: str) -> tuple[float, float, float]:
        w, p, s, l, r = _features(word)  # noqa: E741
        k = self.weights
        return k[0, w] + k[1, p] + k[2, s], k[3, l], k[4, r]

    def marginals(self, words: Words, ids: np.ndarray) -> np.ndarray:
        """Probability of the toxic tag at each position (0 at end marks)."""
        starts, lengths = chains(ids)
        t = words.table[ids]
        e = t[:, 0] + np.concatenate([[0.0], t[:-1, 1]]) + np.concatenate([t[1:, 2], [0.0]])
        left, right = forward_backward(e, starts, lengths, *self.links)
        return np.where(ids > 0, _sigmoid(left + right), 0.0)


def evidence(most: np.ndarray, total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What a document's score depends on: largest marginal, sum and share of marginals, length."""
    return np.column_stack([most, np.log1p(total), total / (words + 5.0), np.log1p(words) / 10])


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0, np.int32)])


def _offsets(column: pa.ChunkedArray) -> np.ndarray:
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in column.chunks] or [np.zeros(0, np.int32)])
    return np.concatenate([[0], np.cumsum(sizes)])


def _fit_field(slots: np.ndarray, y: np.ndarray, lengths: np.ndarray, l2: float = 1e-4) -> tuple[np.ndarray, tuple[float, float, float]]:
    """``slots`` [tokens x features], ``y`` tags, ``lengths`` of the sentences."""
    starts = np.cumsum(lengths) - lengths
    first = np.zeros(len(y), bool)
    first[starts] = True
    last = np.zeros(len(y), bool)
    last[starts + lengths - 1] = True
    theta = np.zeros(5 * DIM + 3)
    theta[5 * DIM :] = (-3.0, 0.0, 0.0)
    mom, var = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.flatnonzero(~last)  # positions with a successor
    for step in range(1, STEPS + 1):
        into, stay, out = theta[5 * DIM :]
        w = theta[: 5 * DIM].reshape(5, DIM)
        e = w[0, slots[:, 0]] + w[1, slots[:, 1]] + w[2, slots[:, 2]]
        e[1:] += np.where(first[1:], 0, w[3, slots[:-1, 3]])
        e[:-1] += np.where(last[:-1], 0, w[4, slots[1:, 4]])
        left, right = forward_backward(e, starts, lengths, into, stay, out)
        d = y - _sigmoid(left + right)
        g = np.zeros_like(theta)
        g[: 5 * DIM] = np.concatenate([np.bincount(slots[:, 0], d, DIM), np.bincount(slots[:, 1], d, DIM), np.bincount(slots[:, 2], d, DIM), np.bincount(slots[:-1, 3], np.where(first[1:], 0, d[1:]), DIM), np.bincount(slots[1:, 4], np.where(last[:-1], 0, d[:-1]), DIM)])
        nxt = e[inner + 1] + right[inner + 1]
        tt, to, ot = left[inner] + stay + nxt, left[inner] + out, into + nxt
        z = np.logaddexp(np.logaddexp(tt, to), np.logaddexp(ot, 0.0))
        a, b = y[inner], y[inner + 1]
        g[5 * DIM] = (d[first]).sum() + ((1 - a) * b - np.exp(ot - z)).sum()
        g[5 * DIM + 1] = (a * b - np.exp(tt - z)).sum()
        g[5 * DIM + 2] = (a * (1 - b) - np.exp(to - z)).sum()
        g = g / len(starts) - l2 * theta
        mom, var = 0.9 * mom + 0.1 * g, 0.99 * var + 0.01 * g * g
        theta += 0.2 * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    return theta[: 5 * DIM].reshape(5, DIM), tuple(float(x) for x in theta[5 * DIM :])


def _fit_documents(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = _sigmoid(x @ w)
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
    return w


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "toxic", key_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_sentences: int = SAMPLE_SENTENCES, share: dict[int, int] | None = None) -> ToxicityModel:
    """Fits on rows with a label of 0 or 1 (the caller leaves out held-out ones). ``share``: numbers of rows of both
    classes, where ``docs`` is a sample of them already."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("y"), F.col(key_col).alias("key")).filter(F.col("y").isin(0, 1))
    every = share or {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    rows = bounded_sample(rows, "y", F.struct("key", "text"), sample_docs).select("text", "y").cache()
    n = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if not n.get(1):
        rows.unpersist()
        return ToxicityModel(np.zeros((5, DIM)), (-3.0, 0.0, 0.0), None)

    def words_of(batches):
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = list({x for w in _TOKEN.findall(folded(text)) if w not in _ENDS for x in (w, _start(w))})
                yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array([y] * len(ws), pa.int32())], names=["word", "y"])

    found = rows.mapInArrow(words_of, "word string, y int").groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).filter(F.col("a") >= LEAST_DOCS)
    a, b, t, o = F.col("a") + 0.5, F.col("b") + 0.5, F.lit(n[1] + 1.0), F.lit(n.get(0, 0) + 1.0)
    odds = F.log(a / t) - F.log(b / o)
    ratio = 2 * (a * F.log(a * (t + o) / ((a + b) * t)) + b * F.log(b * (t + o) / ((a + b) * o)))
    seeds = frozenset(r[0] for r in found.filter((odds >= LEAST_ODDS) & (ratio >= LEAST_RATIO)).select("word").collect())  # words of the bounded sample

    def tagged(batches):
        slots = Words(5, _features)
        for batch in batches:
            out = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = _TOKEN.findall(folded(text))
                ids = np.fromiter(map(slots.__getitem__, tokens), np.int64, len(tokens))
                starts, lengths = chains(ids)
                for s, k in zip(starts, lengths, strict=True):
                    tags = np.array([int(y and (w in seeds or _start(w) in seeds)) for w in tokens[s : s + k]], np.int32)
                    out.append((slots.table[ids[s : s + k]].astype(np.int32).ravel(), tags, bool(tags.any())))
                if slots.n > Words.MOST:
                    slots = Words(5, _features)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.bool_())], names=["slots", "tags", "hit"])

    sentences = rows.mapInArrow(tagged, "slots array<int>, tags array<int>, hit boolean")
    # about sample_sentences of either kind are drawn by hash before they move, and come to the driver as arrays
    sentences = sentences.withColumn("key", F.xxhash64("slots", "tags")).withColumn("u", F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53)))
    count = {r[0]: r[1] for r in sentences.groupBy("hit").count().collect()}
    few = lambda hit: sentences.filter((F.col("hit") == hit) & (F.col("u") <= sample_sentences / max(1, count.get(hit, 0))))
    chosen = pa.concat_tables([few(hit).orderBy("key").select("slots", "tags").toArrow() for hit in (True, False)]).combine_chunks()
    if not len(chosen):  # no labelled text has a word
        rows.unpersist()
        return ToxicityModel(np.zeros((5, DIM)), (-3.0, 0.0, 0.0), None)
    weights, links = _fit_field(_flat(chosen["slots"]).reshape(-1, 5), _flat(chosen["tags"]).astype(float), np.diff(_offsets(chosen["tags"])))
    model = ToxicityModel(weights, links, None)
    scored = tag(rows, model).select("tox_evidence", "y").toPandas()  # the bounded sample
    model.document = _fit_documents(np.array(scored["tox_evidence"].tolist()), scored["y"].to_numpy(float))
    if n.get(0):  # the sample may hold the classes in other shares than the labels do
        model.document[-1] += np.log(every[1] / every[0]) - np.log(n[1] / n[0])
    rows.unpersist()
    return model


def tag(docs: DataFrame, model: ToxicityModel, text_col: str = "text", prefix: str = "tox") -> DataFrame:
    """Adds ``tox_score``, ``tox_spans`` (start, end, probability; in code points of the text) and ``tox_evidence`` to
    every row; columns of these names are replaced (choose another ``prefix`` to keep them)."""
    score, marked, known = (f"{prefix}_{x}" for x in ("score", "spans", "evidence"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by DIM

    def run(batches):
        m = shared.value
        words = Words(3, m.row)
        for batch in batches:
            scores, spans, found = [], [], []
            texts: list[str] = []
            ids: list[np.ndarray] = []

            def flush():
                # an end mark after each text keeps chains inside it
                sizes = np.array([len(x) + 1 for x in ids])
                starts = np.cumsum(sizes) - sizes
                everything = np.zeros(int(sizes.sum()), np.int64)
                for s, x in zip(starts.tolist(), ids, strict=True):
                    everything[s : s + len(x)] = x
                p = m.marginals(words, everything)
                total, most = np.add.reduceat(p, starts), np.maximum.reduceat(p, starts)
                count = np.add.reduceat((everything > 0).astype(float), starts)
                x = evidence(most, total, count)
                found.extend(x.tolist())
                scores.extend(_sigmoid(np.column_stack([x, np.ones(len(x))]) @ m.document).tolist() if m.document is not None else [0.0] * len(x))
                for i, text in enumerate(texts):
                    own = []
                    if most[i] >= 0.5:
                        at = [t.span() for t in _TOKEN.finditer(folded(text))]
                        own = [{"start": at[j][0], "end": at[j][1], "probability": float(p[starts[i] + j])} for j in np.flatnonzero(p[starts[i] : starts[i] + len(at)] >= 0.5)]
                    spans.append(own)
                texts.clear()
                ids.clear()

            held = 0
            for text in batch.column(batch.schema.names.index(text_col)):
                text = text.as_py() or ""
                texts.append(text)
                ids.append(words.numbers(text))
                held += len(ids[-1])
                if held > TOKENS:
                    flush()
                    held = 0
                    if words.n > Words.MOST:
                        words = Words(3, m.row)
            if texts:
                flush()
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
            yield with_columns(batch, {score: pa.array(scores, pa.float64()), marked: pa.array(spans, kind), known: pa.array(found, pa.list_(pa.float64()))})

    return docs.mapInArrow(run, added_schema(docs.schema, f"{score} double, {marked} array<struct<start: int, end: int, probability: double>>, {known} array<double>"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, all columns unchanged."""
    prefix = "tox"
    while any(c.lower().startswith(f"{prefix}_") for c in docs.columns):
        prefix = f"_{prefix}"
    return tag(docs, model, text_col, prefix).filter(F.col(f"{prefix}_score") < threshold).select(docs.columns)


def fit_on_labels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    """Fits on the labelled documents outside fold 2. A document with several labels counts as toxic if one says so."""
    labels = read_table(spark, sf_dir, "labels").filter(fold(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect() if r[0] in (0, 1)}
    # the bounded sample is drawn from the labels, so that only its documents' texts move
    chosen = stash(bounded_sample(labels.filter(F.col("toxic").isin(0, 1)), "toxic", F.col("doc_id"), SAMPLE_DOCS))
    return fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), share=share)  # about 2 * SAMPLE_DOCS rows


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = tag(docs, fit_on_labels(spark, docs, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("tox_spans").alias("spans"))

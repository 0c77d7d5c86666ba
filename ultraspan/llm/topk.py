"""Exact top-k inner-product search with a pivot-distance index.

Component x becomes floor(256 * x). Vectors get one more coordinate that gives all of them the same length, so the
largest inner product is the smallest Euclidean distance, and the triangle inequality holds. Every vector is keyed by
its nearest pivot and its distance from it; keys are cut into annuli of equal width, and an annulus into blocks of
``BLOCK`` vectors sorted by distance.

A query first searches the annulus it lies in itself and, outwards, as many neighbours as hold ``k`` vectors; that
bounds the distance of its k-th neighbour. Then it expands to every annulus whose lower bound |distance to the pivot -
distance of the annulus| is below that bound and stops there; inside a block the sorted distances give the rows that can still
count. A task holds up to ``GROUP`` blocks of vectors and ``TASK_QUERIES`` queries, scores a block of either at a time, and
passes on the best ``k`` of each query only, if they reach the k-th so far. So a query is copied once for each group of
blocks, not for each block, and a vector once for each ``TASK_QUERIES`` queries; memory is bounded. Bounds are widened by more than their rounding error; scores are whole numbers.

How much the index saves depends on the vectors: ``scored_share`` measures it. Vectors without structure in many
dimensions lie at nearly one distance from each other and from every pivot, and then few bounds exclude anything.

Vectors with a component of 2^31 or more, or a squared length of 2^62 or more (as whole numbers), are wide: they are kept
out of the index, and their pairs are scored in Python's whole numbers, a block of vectors and one of queries at a time.
A score that doesn't fit into a long is null; its rank is right.

Edge cases: null vectors, vectors with null or non-finite components, and null ids take no part; rows that repeat an id are candidates each, and a
query is no candidate of rows with its own id; query rows with one id share one ranking; equal vectors tie and go by id;
shorter vectors count as padded with zeros; with fewer than k candidates all are returned; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, stash

SCALE = 256
#: Pivots (chosen from a bounded sample of vectors), annuli for each, vectors and queries in a block.
PIVOTS, ANNULI, SAMPLE, BLOCK, QUERY_BLOCK = 64, 8, 2000, 1024, 512
#: Blocks of vectors that a task holds at most, and tasks to make before it holds more than one; queries in a task.
GROUP, GROUPS, TASK_QUERIES = 64, 64, 1 << 16
EVERY = 50
#: Below every score.
LEAST = -(1 << 63)


def _taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, ``x`` (array of doubles) and ``wide``: whether its whole numbers or its squared length might not fit."""
    x = F.col("x")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda v: v.cast("double")).alias("x"))
    kept = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v * SCALE) * (v * SCALE) + F.abs(v * (2 * SCALE)) + 1.0)  # of the floors at most
    return kept.withColumn("wide", F.exists(x, lambda v: F.abs(v * SCALE) >= float(1 << 31) - 1) | (square >= float(1 << 62)))


def _scaled(rows: DataFrame) -> DataFrame:
    """vec_id, ``v`` (array of longs) of the rows that aren't wide."""
    return rows.filter("NOT wide").select("vec_id", F.transform("x", lambda v: F.floor(v * SCALE)).alias("v"))


def _exact_whole(rows: list, dim: int) -> np.ndarray:
    """floor(256 x) as Python's whole numbers: a float is a fraction of two of them."""
    out = np.zeros((len(rows), dim), object)
    for i, x in enumerate(rows):
        out[i, : len(x)] = [a * SCALE // b for a, b in (float(v).as_integer_ratio() for v in x)]
    return out


def _wide_pairs(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, ``exact`` (decimal text): the best ``k`` of each block of vectors for each query, in Python's whole
    numbers. A block of each at a time."""

    def packed(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // size))
        row = F.struct("vec_id", "x")
        return df.withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))).groupBy(name).agg(F.collect_list(row).alias(f"{name}_rows")), n  # about ``size`` rows

    v, n = packed(vectors, BLOCK, "block")
    q, _ = packed(queries.groupBy("vec_id", "x").count(), QUERY_BLOCK, "q")

    def score(it):
        for pdf in it:
            for asked, held in zip(pdf["q_rows"], pdf["block_rows"], strict=True):
                dim = max(len(r["x"]) for r in [*asked, *held])
                scores = _exact_whole([r["x"] for r in asked], dim) @ _exact_whole([r["x"] for r in held], dim).T
                out = []
                for i, r in enumerate(asked):
                    found = sorted((-s, h["vec_id"]) for s, h in zip(scores[i], held, strict=True) if h["vec_id"] != r["vec_id"])[:k]
                    out += [(r["vec_id"], c, str(-s)) for s, c in found]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "exact"])

    return q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(v, "block").mapInPandas(score, "query_id long, vec_id long, exact string")


def _with_wide(found: DataFrame, asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The ranking of the index, and of all pairs with a wide query or a wide vector, as one."""
    pairs = _wide_pairs(asked.filter("wide"), rows, k).unionByName(_wide_pairs(asked.filter("NOT wide"), rows.filter("wide"), k))
    every = found.select("query_id", "vec_id", F.col("score").cast("string").alias("exact")).unionByName(pairs)

    def rank(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        best = sorted((-int(s), int(i)) for s, i in zip(pdf["exact"], pdf["vec_id"], strict=True))[:k]
        fits = lambda s: s if abs(s) < 1 << 63 else None
        return pd.DataFrame({"query_id": [key[0]] * len(best), "rank": range(1, len(best) + 1), "vec_id": [i for _, i in best], "score": pd.Series([fits(-s) for s, _ in best], dtype="Int64")})

    return every.groupBy("query_id").applyInPandas(rank, "query_id long, rank int, vec_id long, score long")  # k rows for each block of wide vectors


def _matrix(rows, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _pivots(sample: np.ndarray, most: float) -> np.ndarray:
    """Far-apart vectors: each next one is the farthest from those chosen."""
    lifted = _lift(sample, most)
    chosen, far = [0], ((lifted - lifted[0]) ** 2).sum(axis=1)
    while len(chosen) < min(PIVOTS, len(lifted)):
        i = int(far.argmax())
        if far[i] <= 0:
            break
        chosen.append(i)
        far = np.minimum(far, ((lifted - lifted[i]) ** 2).sum(axis=1))
    return lifted[chosen]


def _lift(m: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([m, np.sqrt(np.maximum(most - (m * m).sum(axis=1), 0))])


def _flat(q: np.ndarray) -> np.ndarray:
    """Queries keep their length: their extra coordinate is 0, so |q - v|^2 = |q|^2 + most - 2 q.v."""
    return np.column_stack([q, np.zeros(len(q))])


def _slack(q: np.ndarray, most: float) -> np.ndarray:
    """More than the rounding error of a distance."""
    return 1e-6 * (1 + np.sqrt(most) + np.sqrt((q * q).sum(axis=1)))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0))


def _scores(q: np.ndarray, m: np.ndarray, most: float) -> np.ndarray:
    """Inner products of whole numbers: in floating point where that is exact, else in integers."""
    if most * max(1.0, float((q * q).sum(axis=1).max(initial=0.0))) < float(1 << 106):
        return q @ m.T
    return q.astype(np.int64) @ m.T.astype(np.int64)


class _Best:
    """The ``k`` largest scores of each of some queries, ties to the smaller id; candidates come in pieces."""

    def __init__(self, n: int, k: int, kth: np.ndarray):
        """``kth``: scores below it are of no use; LEAST if there is no such score yet."""
        self.k, self.kth, self.held, self.n = k, kth.copy(), [], 0
        self.limit = 8 * k * max(n, QUERY_BLOCK)

    def offer(self, rows: np.ndarray, scores: np.ndarray, use: np.ndarray, ids: np.ndarray) -> None:
        """Scores [rows x ids] where ``use``."""
        least = self.kth[rows]
        unknown = np.flatnonzero(least == LEAST)
        if len(unknown) and len(ids) > self.k:
            own = np.where(use[unknown], scores[unknown], LEAST)
            least[unknown] = np.partition(own, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
        i, j = np.nonzero(use & (scores >= least[:, None]))
        self.held.append((rows[i], scores[i, j].astype(np.int64), ids[j]))
        self.n += len(i)
        if self.n > self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id) of the best so far."""
        row, score, vec = (np.concatenate(c) for c in zip(*[(np.zeros(0, np.int64),) * 3, *self.held], strict=True))
        order = np.lexsort((vec, -score, row))
        row, score, vec = row[order], score[order], vec[order]
        count = np.bincount(row, minlength=len(self.kth))
        rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        last = rank == self.k - 1
        self.kth[row[last]] = np.maximum(self.kth[row[last]], score[last])
        row, score, vec = (c[rank < self.k] for c in (row, score, vec))
        self.held, self.n = [(row, score, vec)], len(row)
        return row, score, vec


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scored=None) -> DataFrame:
    """``queries`` has the columns of ``vectors``. Returns query_id, rank (from 1), vec_id, score; a query's own id is
    no candidate. ``scored``: an accumulator for the number of scores that were computed."""
    given = stash(_taking_part(vectors, id_col, vector_col))
    wanted = stash(_taking_part(queries, id_col, vector_col))
    if not given.filter("wide").unionByName(wanted.filter("wide")).isEmpty():
        return _with_wide(_index_top_k(_scaled(given), _scaled(wanted), k, scored), wanted, given, k)
    return _index_top_k(_scaled(given), _scaled(wanted), k, scored)


def _index_top_k(rows: DataFrame, asked: DataFrame, k: int, scored) -> DataFrame:
    """``top_k`` of rows (vec_id, v) that aren't wide."""
    spark = rows.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    empty = "query_id long, rank int, vec_id long, score long"
    stats = rows.agg(F.max(F.size("v")), F.max(square), F.count(F.lit(1))).collect()[0]
    if not stats[2]:
        return spark.createDataFrame([], empty)
    dim, most, n = max(int(stats[0]), 1), float(stats[1]), int(stats[2])
    # a bounded sample by hash; only its far-apart members become pivots
    share = min(1.0, 4.0 * SAMPLE / n)
    sample = rows.filter(F.shiftrightunsigned(F.xxhash64("vec_id", "v"), 11) / F.lit(float(1 << 53)) < share).orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").collect()
    sample = sample or rows.limit(1).select("v").collect()
    pivots = _pivots(_matrix([r[0] for r in sample], dim), most)
    widest = float(2 * np.sqrt(most)) + 1.0
    wide = widest / ANNULI

    def keyed(it):
        for pdf in it:
            if len(pdf):
                m = _lift(_matrix(pdf["v"].tolist(), dim), most)
                d = _distances(m, pivots)
                p = d.argmin(axis=1)
                r = d[np.arange(len(p)), p]
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "pivot": p.astype(np.int32), "ring": np.minimum(r / wide, ANNULI - 1).astype(np.int32), "r": r})

    index = stash(rows.mapInPandas(keyed, "vec_id long, v array<long>, pivot int, ring int, r double"))
    cells = index.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("size"), F.min("r").alias("least"), F.max("r").alias("most")).toPandas()  # PIVOTS * ANNULI rows at most
    cells["blocks"] = -(-cells["size"] // BLOCK)
    small = spark.createDataFrame(cells[["pivot", "ring", "blocks"]].astype({"pivot": "int32", "ring": "int32", "blocks": "int64"}), "pivot int, ring int, blocks long")
    # a row for each block: its vectors, sorted by distance

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "vec_id"])
        return pd.DataFrame([(key[0], key[1], key[2], pdf["vec_id"].to_numpy().tobytes(), pdf["r"].to_numpy().tobytes(), _matrix(pdf["v"].tolist(), dim).astype(np.int32).tobytes())], columns=["pivot", "ring", "block", "ids", "rs", "m"])

    blocks = stash(index.join(F.broadcast(small), ["pivot", "ring"]).withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("blocks"))).groupBy("pivot", "ring", "block").applyInPandas(pack, "pivot int, ring int, block long, ids binary, rs binary, m binary"))
    cell = list(zip(*(cells[c].tolist() for c in ("pivot", "ring", "size", "least", "most", "blocks")), strict=True))
    # blocks in order of their cells, cut into groups; a group's cells stand side by side
    before = np.concatenate([[0], np.cumsum(cells["blocks"].to_numpy())]).astype(int)
    held = int(min(GROUP, max(1, before[-1] // GROUPS)))
    of_group = [(int(np.searchsorted(before, g * held, side="right")) - 1, int(np.searchsorted(before, min((g + 1) * held, before[-1])))) for g in range(-(-int(before[-1]) // held))]
    number = {c[:2]: i for i, c in enumerate(cell)}

    def visits(pdf: pd.DataFrame, bounds: np.ndarray | None) -> np.ndarray:
        """[queries x cells]: the cells each query goes to: the nearest ones that hold k + 1 vectors (no bounds yet), or those
        not seen yet whose lower bound is within the query's bound."""
        m = _matrix(pdf["v"].tolist(), dim)
        d = _distances(_flat(m), pivots)
        low = np.array([np.maximum(np.maximum(d[:, c[0]] - c[4], c[3] - d[:, c[0]]), 0) for c in cell]).T
        order = np.lexsort((np.broadcast_to(np.arange(len(cell)), low.shape), low), axis=1)
        in_order = np.cumsum(np.array([c[2] for c in cell])[order], axis=1)
        first = np.concatenate([np.ones((len(m), 1), bool), in_order[:, :-1] < k + 1], axis=1)  # in order of visit
        seen = np.zeros(low.shape, bool)
        np.put_along_axis(seen, order, first, axis=1)
        return seen if bounds is None else ~seen & (low <= bounds[:, None] + _slack(m, most)[:, None])

    def send(it, second: bool):
        """A row for each group of blocks and each block of queries that go to one of its cells."""
        names = ["group", "q_ids", "q_m", "q_bound", "q_kth", "go"]
        for pdf in it:
            for s in range(0, len(pdf), QUERY_BLOCK):
                part = pdf.iloc[s : s + QUERY_BLOCK]
                go = visits(part, part["bound"].to_numpy() if second else None)
                m, out = _matrix(part["v"].tolist(), dim).astype(np.int32), []
                ids, bound, kth = part["vec_id"].to_numpy(), part["bound"].to_numpy() if second else np.full(len(part), np.inf), part["kth"].to_numpy()
                for g, (lo, hi) in enumerate(of_group):
                    q = np.flatnonzero(go[:, lo:hi].any(axis=1))
                    if len(q):
                        out.append((g, *(x[q].tobytes() for x in (ids, m, bound, kth, go[:, lo:hi]))))
                    if len(out) == GROUP:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                yield pd.DataFrame(out, columns=names)

    sent = "group int, q_ids binary, q_m binary, q_bound binary, q_kth binary, go binary"

    def search(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        lo_cell, hi_cell = of_group[key[0]]
        q_ids, q_bound, q_kth = (np.frombuffer(b"".join(asked[c]), t) for c, t in (("q_ids", np.int64), ("q_bound", float), ("q_kth", np.int64)))
        q_m = np.frombuffer(b"".join(asked["q_m"]), np.int32).reshape(-1, dim)
        go = np.frombuffer(b"".join(asked["go"]), bool).reshape(-1, hi_cell - lo_cell)
        best = _Best(len(q_ids), k, q_kth)
        for x in own.itertuples(index=False):
            ids, rs, m = np.frombuffer(x.ids, np.int64), np.frombuffer(x.rs), np.frombuffer(x.m, np.int32).reshape(-1, dim).astype(float)
            wanted = np.flatnonzero(go[:, number[x.pivot, x.ring] - lo_cell])
            for s in range(0, len(wanted), QUERY_BLOCK):
                rows = wanted[s : s + QUERY_BLOCK]
                q = q_m[rows].astype(float)
                d = _distances(_flat(q), pivots[[x.pivot]])[:, 0]
                reach = q_bound[rows] + _slack(q, most)
                lo, hi = np.searchsorted(rs, d - reach, side="left"), np.searchsorted(rs, d + reach, side="right")
                if scored is not None:
                    scored.add(int((hi - lo).sum()))
                at = np.arange(len(ids))
                use = (at >= lo[:, None]) & (at < hi[:, None]) & (ids != q_ids[rows][:, None])
                best.offer(rows, _scores(q, m, most), use, ids)
        row, score, vec = best.cut()
        return pd.DataFrame({"query_id": q_ids[row], "vec_id": vec, "score": score})

    shares = max(1, -(-asked.count() // TASK_QUERIES))
    place = F.create_map(*[y for (p, r), i in number.items() for y in (F.lit(p * ANNULI + r), F.lit(int(before[i])))])
    grouped = blocks.withColumn("group", F.floor((place[F.col("pivot") * ANNULI + F.col("ring")] + F.col("block")) / held).cast("int"))
    grouped = grouped.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def searched(rows: DataFrame, second: bool) -> DataFrame:
        out = rows.mapInPandas(lambda it: send(it, second), sent).withColumn("share", F.pmod(F.xxhash64("q_ids"), F.lit(shares)).cast("int"))
        return grouped.groupBy("group", "share").cogroup(out.groupBy("group", "share")).applyInPandas(search, found)

    found = "query_id long, vec_id long, score long"
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    asked = asked.select("vec_id", "v", F.lit(0.0).alias("bound"), F.lit(LEAST).cast("long").alias("kth"))
    near = stash(searched(asked, False).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
    # squared distance of the k-th so far: |q|^2 + most - 2 score; a query with fewer than k has no bound
    kth = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s"))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    bound = F.when(F.col("c") >= k, F.sqrt(F.greatest(F.lit(0.0), size + F.lit(most) - 2.0 * F.col("s")))).otherwise(F.lit(float("inf")))
    again = asked.join(kth, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.coalesce(bound, F.lit(float("inf"))).alias("bound"), F.coalesce(F.when(F.col("c") >= k, F.col("s")), F.lit(LEAST).cast("long")).alias("kth"))
    far = searched(again, True)
    everything = near.select("query_id", "vec_id", "score").unionByName(far)
    return everything.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scored_share(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of all pairs of a query and a vector that the search scores; 1 is brute force."""
    scored = vectors.sparkSession.sparkContext.accumulator(0)
    top_k(vectors, queries, k, id_col, vector_col, scored).count()
    n, q = (_taking_part(x, id_col, vector_col).count() for x in (vectors, queries))
    return scored.value / max(1, n * q)


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

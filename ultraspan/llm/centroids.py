"""Centroid clustering of whole-number vectors with 64 components, by bit planes.

Component x becomes v = floor(1024 * x). Bit i of all 64 components is packed into one 64-bit word, the plane i; with B
planes in two's complement, plane i weighs 2^i and the last one -2^(B-1). The inner product of a vector and a centroid is
then the sum over pairs of planes of weight * weight * popcount(plane AND plane), and a squared distance is
|v|^2 - 2 v.c + |c|^2, all exact. The planes are written once (B words a vector, B as its largest component needs); each
round is one scan of them: every task gives, for each centroid, the number of its vectors and the sums of their
components, and only those are shuffled. Centroids (k rows) go to the tasks with the plan.

Numbers that fit into 64 bits are added up in 64 bits, others as Python's whole numbers, so every finite vector takes part
whatever its size.

Edge cases: vectors that are null, have not exactly 64 components, or hold a null or non-finite one take no part; a null
id counts as the empty text where ids are hashed; rows that repeat an id are vectors each, and between equal hashes the
smaller components (in order) are first; with fewer vectors than centroids each vector starts one; distances that don't
fit into a long are null, and so are sums of distances; no vectors give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stash

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Vectors whose popcounts are held at once.
ROWS = 4096
#: With up to so many planes on both sides, distances of 64 components fit into 64 bits (2 * 27 + 6 + 2 = 62).
NARROW = 28
#: Component sums travel as digits of this many bits.
DIGIT = 40
LONG_MAX = (1 << 63) - 1


def _whole(x: float) -> int:
    """floor(1024 * x), exactly: a float is a fraction of two whole numbers."""
    a, b = x.as_integer_ratio()
    return a * SCALE // b


def _width(values: np.ndarray) -> int:
    """Planes that two's complement needs for all of ``values`` (whole numbers)."""
    return max(max(int(values.max()), -int(values.min()) - 1).bit_length() + 1, 2)


def to_planes(values: np.ndarray) -> np.ndarray:
    """[n, 64] whole numbers to [n, B] words; component k is bit k of each word."""
    n = len(values)
    out = np.zeros((n, _width(values)), np.uint64)
    for i in range(out.shape[1]):
        bits = ((values >> i) & 1).astype(np.uint8)
        out[:, i] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def plane_weights(width: int) -> list[int]:
    return [1 << i for i in range(width - 1)] + [-(1 << (width - 1))]


def squared_distances(planes: np.ndarray, centroids: list[np.ndarray]) -> np.ndarray:
    """[n, B] planes and a [C] plane vector for each centroid to [n, k] exact squared distances."""
    widest = max([planes.shape[1], *(len(c) for c in centroids)])
    kind = np.int64 if widest <= NARROW else object

    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a: [n, B]; b: [n, C] or [1, C]."""
        total = np.zeros(len(a), kind)
        for i, w in enumerate(plane_weights(a.shape[1])):
            for j, x in enumerate(plane_weights(b.shape[1])):
                total += np.bitwise_count(a[:, i] & b[:, j]).astype(kind) * (w * x)
        return total

    own = dot(planes, planes)
    out = np.empty((len(planes), len(centroids)), kind)
    for k, c in enumerate(centroids):
        c = c[None]
        out[:, k] = own - 2 * dot(planes, c) + dot(c, c)[0]
    return out


def component_sums(planes: np.ndarray) -> list[int]:
    """The sum of each component over all rows, from the number of set bits of each plane."""
    totals = [0] * DIM
    for i, w in enumerate(plane_weights(planes.shape[1])):
        bits = np.unpackbits(np.ascontiguousarray(planes[:, i]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k, n in enumerate(bits.sum(axis=0, dtype=np.int64).tolist()):
            totals[k] += w * n
    return totals


def _digits(x: int) -> list[int]:
    """Signed digits of ``DIGIT`` bits, lowest first; their sums over any number of tasks fit into a long."""
    sign, x, out = (-1, -x, []) if x < 0 else (1, x, [])
    while x:
        out.append(sign * (x & ((1 << DIGIT) - 1)))
        x >>= DIGIT
    return out


def _batches(iterator, columns: list[str]):
    """(the other columns, planes) of rows with one number of planes, ``ROWS`` at most."""
    for pdf in iterator:
        for width, part in pdf.groupby(pdf["planes"].str.len() // 8):
            for s in range(0, len(part), ROWS):
                some = part.iloc[s : s + ROWS]
                yield some[columns], np.frombuffer(b"".join(some["planes"]), "<u8").reshape(-1, int(width))


def vector_planes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``planes`` (binary, 8 bytes a plane, little-endian) of the vectors that take part."""
    v = F.col(vector_col)
    kept = vectors.filter(v.isNotNull() & (F.size(v) == DIM) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))))

    def pack(iterator):
        for pdf in iterator:
            if not len(pdf):
                continue
            x = np.array(pdf["v"].tolist(), dtype=np.float64)
            small = np.abs(x).max(axis=1) < float(1 << 40)
            packed = np.empty(len(x), object)
            for rows, exact in ((np.flatnonzero(small), False), (np.flatnonzero(~small), True)):
                if len(rows):
                    whole = np.array([[_whole(c) for c in r] for r in x[rows].tolist()], object) if exact else np.floor(x[rows] * SCALE).astype(np.int64)
                    planes = to_planes(whole)
                    packed[rows] = [p.astype("<u8").tobytes() for p in planes]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "planes": packed})

    kind = vectors.schema[id_col].dataType
    rows = kept.select(F.col(id_col).alias("vec_id"), v.cast("array<double>").alias("v"))
    return rows.mapInPandas(pack, f"vec_id {kind.simpleString()}, planes binary")


def from_planes(planes: np.ndarray) -> list[int]:
    """The 64 components of one plane vector."""
    return component_sums(planes[None])


def _as_planes(values: list[int]) -> np.ndarray:
    return to_planes(np.array([values], object))[0]


def start_centroids(planes: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``seed:id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    keyed = planes.select(key.alias("key"), "planes")
    last = [r[0] for r in keyed.orderBy("key").limit(k).select("key").collect()]  # k rows
    if not last:
        return []
    # of repeated ids the smaller vectors come first; equal vectors are one row here, with their number
    tied = keyed.filter(F.col("key") <= last[-1]).groupBy("key", "planes").count()
    found = {r["key"]: [(from_planes(np.frombuffer(r["planes"], "<u8")), r["n"])] if r["different"] == 1 else _smallest(tied.filter(F.col("key") == r["key"]), k)
             for r in tied.groupBy("key").agg(F.count(F.lit(1)).alias("different"), F.first("planes").alias("planes"), F.sum("count").alias("n")).collect()}
    return [values for key in dict.fromkeys(last) for values, n in found[key] for _ in range(min(n, k))][:k]


def _smallest(rows: DataFrame, k: int) -> list[tuple[list[int], int]]:
    """The k smallest vectors of one key: each task keeps its k smallest, the driver the k smallest of these."""

    def least(iterator):
        best: list[tuple[list[int], bytes, int]] = []
        for pdf in iterator:
            best += [(from_planes(np.frombuffer(p, "<u8")), p, int(n)) for p, n in zip(pdf["planes"], pdf["count"], strict=True)]
            best = sorted(best, key=lambda b: b[0])[:k]
        yield pd.DataFrame({"planes": [b[1] for b in best], "count": [b[2] for b in best]})

    some = rows.select("planes", "count").mapInPandas(least, "planes binary, count long").coalesce(1).mapInPandas(least, "planes binary, count long").collect()
    return sorted((from_planes(np.frombuffer(r["planes"], "<u8")), r["count"]) for r in some)


def _nearest(planes: np.ndarray, centroids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    d = squared_distances(planes, centroids)
    c = d.argmin(axis=1)  # the first of equal ones
    return c, d[np.arange(len(d)), c]


def next_centroids(planes: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: the floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    packed = [_as_planes(c) for c in centroids]

    def partial(iterator):
        counts, sums = [0] * len(packed), [[0] * DIM for _ in packed]
        for _, p in _batches(iterator, []):
            c, _ = _nearest(p, packed)
            for k in np.unique(c).tolist():
                mine = p[c == k]
                counts[k] += len(mine)
                sums[k] = [a + b for a, b in zip(sums[k], component_sums(mine), strict=True)]
        rows = [(k, -1, 0, n) for k, n in enumerate(counts) if n]
        rows += [(k, i, d, x) for k, s in enumerate(sums) for i, total in enumerate(s) for d, x in enumerate(_digits(total)) if x]
        yield pd.DataFrame(rows, columns=["cluster", "component", "digit", "x"])

    # k * 65 rows for each digit, whatever the number of vectors
    totals = planes.mapInPandas(partial, "cluster int, component int, digit int, x long").groupBy("cluster", "component", "digit").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    counts, sums = [0] * len(centroids), [[0] * DIM for _ in centroids]
    for r in totals:
        if r["component"] < 0:
            counts[r["cluster"]] = int(r["x"])
        else:
            sums[r["cluster"]][r["component"]] += int(r["x"]) << (DIGIT * r["digit"])
    return [[s // n for s in sums[k]] if (n := counts[k]) else centroids[k] for k in range(len(centroids))]


def centroid_clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(``vec_id``, ``cluster``, ``distance``) of every vector that takes part, and the final centroids."""
    planes = stash(vector_planes(vectors, id_col, vector_col), "zstd")
    kind = planes.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long"
    centroids = start_centroids(planes, k, seed)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema), []
    for _ in range(rounds):
        moved = next_centroids(planes, centroids)
        if moved == centroids:  # all later rounds would give the same
            break
        centroids = moved
    packed = [_as_planes(c) for c in centroids]

    def assign(iterator):
        for own, p in _batches(iterator, ["vec_id"]):
            c, d = _nearest(p, packed)
            distance = pd.Series([int(x) if x <= LONG_MAX else None for x in d], dtype="Int64")
            yield pd.DataFrame({"vec_id": own["vec_id"].to_numpy(), "cluster": c.astype(np.int32), "distance": distance})

    return planes.mapInPandas(assign, schema), centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = centroid_clusters(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    assigned = stash(assigned, "zstd")
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    of = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(total.alias("total")).collect()}  # k rows
    everything = None if None in of.values() else sum(of.values())
    fits = lambda x: None if x is None or x > LONG_MAX else int(x)
    rows = [(i, fits(of.get(i)), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(rows, "c int, cluster_inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), F.col("cluster") == F.col("c")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(fits(everything)).cast("long").alias("inertia"), "centroid_sha256"
    )


def _sql() -> str:
    """The rounds one after the other, over one row for each component."""
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""d{r} AS MATERIALIZED (
  SELECT n, c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM x v JOIN m{r} m USING (k) GROUP BY n, c),
a{r} AS MATERIALIZED (SELECT n, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{r} GROUP BY n)""")
        if r < ROUNDS:
            rounds.append(f"""s{r} AS (SELECT c, k, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS q FROM x JOIN a{r} USING (n) GROUP BY c, k),
m{r + 1} AS MATERIALIZED (
  SELECT m.c, m.k, coalesce((s - ((s % q) + q) % q) // q, m.x) AS x FROM m{r} m LEFT JOIN s{r} s ON s.c = m.c AND s.k = m.k)""")
    chain = ",\n".join(rounds)
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT n, unnest(range({DIM})) AS k, unnest(v) AS x FROM v),
f AS (
  SELECT n, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c FROM v
  QUALIFY c < {CENTROIDS}),
m0 AS MATERIALIZED (SELECT c, k, x FROM f JOIN x USING (n)),
{chain},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY k)) AS h FROM m{ROUNDS} GROUP BY c)
SELECT vec_id, a.c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (n) JOIN h ON h.c = a.c
"""


OP12_SQL = _sql()

"""N-gram Jaccard join with set-relation skipping: components of documents whose shingle sets are similar enough.

Index lists are kept by position. A set's shingles, in hash order, are cut into as many position blocks as two linked
sets can differ in shingles, and a few more; then two linked sets agree on a whole block at least, and a list has the
sets that have the same block. A block that one list entry differs in is skipped as a whole, without looking at its
shingles; a shingle, line or passage that very many documents share makes no long list. (Lists of single shingles, the
usual index, hold a third of all documents for a shared passage.)

Blocks depend on the size of the sets: sizes fall into bands, a set goes by the blocks of its own band and of those
that hold smaller partners. Empty blocks make no list. A set with more empty blocks than there are spare ones also
joins by prefix filtering, that is by lists of its smallest single shingles, so no link is lost.

Pairs are counted in short lists, and a pair that shares fewer blocks than linked sets must is dropped; long lists, which
only large groups of near copies have, give star edges. What is left gives candidate components, and only they are
compared, shingle by shingle, in blocks of ``BLOCK`` sets. There the index lists of the shingles are ordered by the
position a shingle has in its set: linked sets hold a common shingle at nearly the same position, so the entries before
and after that are skipped as blocks. A set's answers are derived from those of a highly similar set, its leader: the
leader's counts, less the lists of the shingles that only the leader has, plus the lists of those that only the set has.
Components larger than a block are compared block by block against their first set; then the sets not in its component,
blocks of them, against all blocks. Nothing is sampled or capped.

Of equal texts one is compared, the others are linked with it. Texts stay where they are: rows are picked by bits of their
keys, and keys are shuffled once.

Hashes of lists and sets only make candidates; what decides is the number of shingles (64-bit hashes) in common.

Edge cases: documents without a word (null and empty texts) have an empty set and link with nothing; equal sets link;
repeated documents are separate rows, also where ids repeat; null ids are kept; very long texts are read whole; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .arrowtext import text_slices
from .common import WORD, read_table, stash, with_keys, with_row_keys, without_keys

BAND = 0.7
BLOCK = 128
#: Sets in a list whose pairs are counted one by one.
SHORT = 32
#: Bits for the band beside a row key; marks in place of a number of lists.
BAND_BITS, SINGLE, EQUAL = 6, -1, -2
#: Candidate documents (16 bytes each) that may be broadcast to pick their texts; more are joined by a shuffle.
MOST_BROADCAST = 500_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRIME = np.uint64(0x100000001B3)
_PREFIX = np.uint64(0x5851F42D4C957F2D)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    shift = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - shift, counts)


def shingle_sets(texts: pa.Array, n_words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, set sizes, shingle hashes by row and value) of slices of the column."""
    for first, end, offsets, raw in text_slices(texts):
        n = end - first
        if not len(raw):
            yield first, end, np.zeros(n, np.int64), np.zeros(0, np.uint64)
            continue
        word = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        begins = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
        ends = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1
        lengths = ends - begins
        if not len(begins):
            yield first, end, np.zeros(n, np.int64), np.zeros(0, np.uint64)
            continue
        power = np.multiply.accumulate(np.full(int(lengths.max()), _PRIME))
        at = np.flatnonzero(word)
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(at)) - np.repeat(starts, lengths)
        h = _mix(np.add.reduceat((_LOWER[raw[at]].astype(np.uint64) + np.uint64(1)) * power[place], starts) + lengths.astype(np.uint64))
        row = np.searchsorted(offsets, begins, side="right") - 1
        per_row = np.bincount(row, minlength=n)
        row_start = np.cumsum(per_row) - per_row
        hashes, rows = [], []
        for size in range(1, n_words + 1):
            own = np.flatnonzero(per_row == size) if size < n_words else np.flatnonzero(per_row >= size)
            i = _spread(row_start[own], per_row[own] - size + 1)
            x = np.full(len(i), size, np.uint64)
            for j in range(size):
                x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i + j])
            hashes.append(x)
            rows.append(row[i])
        x, r = np.concatenate(hashes), np.concatenate(rows)
        order = np.lexsort((x, r))
        x, r = x[order], r[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
        yield first, end, np.bincount(r[new], minlength=n), x[new]


class Scheme:
    """Bands of sizes with their numbers of position blocks, for links of ``percent`` / 100 at least."""

    def __init__(self, percent: int):
        self.percent = percent
        limits = [1]
        while limits[-1] < 1 << 31:
            limits.append(max(limits[-1] + 1, int(limits[-1] / BAND)))
        self.limits = np.array(limits)
        # linked sets, the smaller of at most U shingles, differ in at most U (100 - p) / p of them
        differ = self.limits * (100 - percent) // percent
        # enough spare blocks for the empty ones that chance gives at this density
        spare = np.where(differ > 0, np.ceil(differ * (0.02 if percent >= 88 else 0.3)) + (1 if percent >= 88 else 2), 0).astype(np.int64)
        self.blocks, self.spare = differ + 1 + spare, spare

    def bands(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and the highest band that a set takes part in."""
        least = -(-sizes * self.percent // 100)
        return np.searchsorted(self.limits, least), np.searchsorted(self.limits, sizes)

    def keys(self, sizes: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List keys, and of each the row, the band and ``need``: how many lists at least the row shares with any set it
        is linked to in that band; ``SINGLE`` for lists of single shingles, of which one is shared."""
        row_start = np.cumsum(sizes) - sizes
        low, high = self.bands(np.maximum(sizes, 1))
        out = []
        for step in range(int((high - low).max()) + 1 if len(sizes) else 0):
            own = np.flatnonzero((sizes > 0) & (high - step >= low))
            if not len(own):
                break
            i = _spread(row_start[own], sizes[own])
            r = np.repeat(own, sizes[own])
            b = high - step
            seg = ((x[i] >> np.uint64(32)) * self.blocks[b[r]].astype(np.uint64)) >> np.uint64(32)
            new = np.ones(len(i), bool)
            new[1:] = (seg[1:] != seg[:-1]) | (r[1:] != r[:-1])
            at = np.flatnonzero(new)
            total = np.add.reduceat(_mix(x[i] ^ _PRIME), at)
            used = np.bincount(r[at], minlength=len(sizes))
            need = 1 + self.spare[b] - (self.blocks[b] - used)
            out.append((_mix(total + _mix((b[r[at]].astype(np.uint64) << np.uint64(40)) + seg[at])), r[at], b[r[at]], np.maximum(need, 0)[r[at]]))
            own = own[need[own] < 1]
            count = sizes[own] - -(-sizes[own] * self.percent // 100) + 1
            r = np.repeat(own, count)
            out.append((_mix(_mix(x[_spread(row_start[own], count)] ^ _PREFIX) + b[r].astype(np.uint64)), r, b[r], np.full(len(r), SINGLE)))
        empty = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        return tuple(np.concatenate(c) for c in zip(empty, *out, strict=True))


def candidate_edges(keyed: DataFrame, n_words: int, percent: int) -> DataFrame:
    """``keyed``: row_key, text. Edges u, v that connect every pair of linked sets, directly or by a path.

    Two linked sets share ``need`` lists at least (of either's need, the larger). Pairs are counted in lists of up to
    ``SHORT`` sets, and kept if they share enough of them, less the long lists that both are in. A set whose long lists
    could be all it shares with another is joined, in its long lists, to the first such set there. Equal sets of a
    slice of texts are joined at once, and one of them goes on.
    """

    def run(batches):
        scheme = Scheme(percent)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, end, sizes, x in shingle_sets(batch.column(1), n_words):
                own = ids[first:end]
                some = np.flatnonzero(sizes > 0)
                starts = (np.cumsum(sizes) - sizes)[some]
                whole = _mix(np.add.reduceat(_mix(x), starts) + sizes[some].astype(np.uint64)) if len(some) else np.zeros(0, np.uint64)
                _, one, back = np.unique(whole, return_index=True, return_inverse=True)
                copy = np.flatnonzero(one[back] != np.arange(len(some)))
                head = some[np.sort(one)]
                keys, rows, bands, need = scheme.keys(sizes[head], x[_spread(starts[np.sort(one)], sizes[head])])
                k = np.concatenate([keys.view(np.int64), own[some[one[back][copy]]]])
                u = np.concatenate([own[head[rows]] << BAND_BITS | bands, own[some[copy]] << BAND_BITS])
                w = np.concatenate([need, np.full(len(copy), EQUAL)]).astype(np.int32)
                for s in range(0, len(k), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(k[s : s + 200_000]), pa.array(u[s : s + 200_000]), pa.array(w[s : s + 200_000])], names=["key", "ub", "need"])

    # one shuffle; keys that only one set has are never written
    everything = keyed.mapInArrow(run, "key long, ub long, need int")
    held_by = F.count_if(F.col("need") != EQUAL).over(W.partitionBy("key"))
    lists = stash(everything.withColumn("n", held_by).filter((F.col("n") > 1) | (F.col("need") == EQUAL)))
    equal_to = F.col("need") == EQUAL
    row = lambda c: F.shiftright(c, BAND_BITS)
    equal = lists.filter(equal_to).select(row("ub").alias("u"), F.col("key").alias("v"))
    lists = lists.filter(~equal_to)
    long_lists = lists.filter(F.col("n") > SHORT)
    held = stash(long_lists.filter(F.col("need") != SINGLE).groupBy("ub").agg(F.count(F.lit(1)).alias("h")).withColumnRenamed("ub", "k"))
    held = F.broadcast(held) if held.count() <= MOST_BROADCAST else held
    # a list of SHORT sets at most, and all its pairs
    member = F.sort_array(F.collect_list(F.struct("ub", "need")))
    pair = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, SHORT), lambda b: F.struct(a["ub"].alias("a"), b["ub"].alias("b"), a["need"].alias("na"), b["need"].alias("nb")))))
    pairs = lists.filter(F.col("n") <= SHORT).groupBy("key").agg(member.alias("m")).filter(F.size("m") > 1).select(F.explode(pair).alias("p")).select("p.*")
    counted = pairs.groupBy("a", "b").agg(F.count_if((F.col("na") != SINGLE) & (F.col("nb") != SINGLE)).alias("c"), F.max(F.greatest("na", "nb")).alias("need"), F.max(F.col("na") == SINGLE).alias("single"))
    a, b = held.select(F.col("k").alias("ka"), F.col("h").alias("ha")), held.select(F.col("k").alias("kb"), F.col("h").alias("hb"))
    both = counted.join(a, F.col("a") == F.col("ka"), "left").join(b, F.col("b") == F.col("kb"), "left")
    enough = F.col("single") | (F.col("c") >= F.greatest(F.lit(1), F.col("need")) - F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))))
    near = both.filter(enough).select(row("a").alias("u"), row("b").alias("v"))
    open_ = long_lists.join(held, F.col("ub") == F.col("k"), "left").filter((F.col("need") == SINGLE) | (F.col("need") <= F.col("h"))).select("key", "ub")
    first = stash(open_.groupBy("key").agg(F.min("ub").alias("v"))).withColumnRenamed("key", "k2")
    stars = open_.join(first, F.col("key") == F.col("k2")).select(row("ub").alias("u"), row("v").alias("v"))
    return equal.unionByName(near).unionByName(stars).filter("u != v").distinct()


def _linked(size: int, sizes: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (size + sizes - shared)


class Lists:
    """Index lists of the shingles of some sets: entries are sets, ordered by the shingle's position in them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
        position = _spread(np.zeros(len(sets), np.int64), self.sizes)
        order = np.lexsort((position, tokens))
        self.values, number = np.unique(tokens, return_inverse=True)
        self.place = (number[order] << 32) | position[order]
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]

    def count(self, s: np.ndarray, positions: np.ndarray | None = None, reach: int = 1 << 31) -> np.ndarray:
        """For each set, how many of the shingles ``s`` it has; with ``positions``, entries whose position is more than
        ``reach`` away are skipped."""
        k = np.searchsorted(self.values, s)
        known = k < len(self.values)
        known[known] = self.values[k[known]] == s[known]
        k = k[known] << 32
        at = positions[known] if positions is not None else np.zeros(len(k), np.int64)
        lo = np.searchsorted(self.place, k | np.maximum(at - reach, 0), side="left")
        hi = np.searchsorted(self.place, k | np.minimum(at + reach, (1 << 32) - 1), side="right")
        return np.bincount(self.owner[_spread(lo, hi - lo)], minlength=len(self.sizes))


def answers(own: list[np.ndarray], others: list[np.ndarray], percent: int, wanted=lambda i: True) -> Iterator[tuple[int, np.ndarray]]:
    """For sets of ``own``, one after the other while ``wanted``: how many shingles it shares with each set of ``others``.
    Exact for all it is linked with; for others it may be too low.

    The first of the sets that are linked with each other is looked up in the lists; the others are derived from it. Its
    counts must hold for what those are linked with, so entries are skipped only beyond (100 - percent) % of its size for
    the one step and as much again, of the larger set, for the other.
    """
    mine, lists = Lists(own), Lists(others)
    leader, counts = np.full(len(own), -1), {}
    for i, s in enumerate(own):
        if not wanted(i):
            continue
        if leader[i] < 0:
            one = -(-len(s) * (100 - percent) // percent) + 1
            two = one + -(-len(s) * 100 * (100 - percent) // percent**2) + 1
            positions = np.arange(len(s))
            similar = _linked(len(s), mine.sizes, mine.count(s, positions, one), percent)
            leader[similar & (leader < 0)] = i
            leader[i] = i
            counts[i] = lists.count(s, positions, two)
            yield i, counts[i]
        else:
            first = own[leader[i]]
            yield i, counts[leader[i]] - lists.count(np.setdiff1d(first, s, assume_unique=True)) + lists.count(np.setdiff1d(s, first, assume_unique=True))


def _within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of the sets. Sets linked with the first are in its component already; what they
    are linked with besides, the others' answers show."""
    sizes = np.array([len(s) for s in sets])
    done = np.zeros(len(sets), bool)
    links = []
    for i, shared in answers(sets, sets, percent, lambda i: not done[i]):
        at = np.flatnonzero(_linked(sizes[i], sizes, shared, percent))
        links += [(i, int(j)) for j in at if j != i]
        if i == 0:
            done[at] = True
    return links


def jaccard_components(keyed: DataFrame, n_words: int = 3, percent: int = 90, block: int = BLOCK) -> DataFrame:
    """``keyed``: row_key, text (a written table, see ``with_row_keys``). Returns row_key, root for documents that link
    with another one; root is the smallest row_key of the component."""
    keyed = keyed.select("row_key", "text")
    copies = _copies(keyed)
    links = _links(without_keys(keyed, "row_key", copies.select("row_key")), n_words, percent, block)
    # a copy is linked with the first of its kind
    return connected_components(links.unionByName(copies.select(F.col("row_key").alias("u"), F.col("first").alias("v")))).select(F.col("node").alias("row_key"), "root")


def _copies(keyed: DataFrame) -> DataFrame:
    """row_key, first: documents with words whose whole text a document with a smaller key has (told by 128-bit digests)."""
    told = keyed.filter(F.col("text").rlike(WORD)).select("row_key", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    several = told.groupBy("digest").agg(F.min("row_key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return stash(told.join(several, "digest").filter("row_key != first").select("row_key", "first"))


def _links(keyed: DataFrame, n_words: int, percent: int, block: int) -> DataFrame:
    """Links u, v that span the components of the documents."""
    groups = connected_components(candidate_edges(keyed, n_words, percent))
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("m")).withColumnRenamed("root", "r")
    members = stash(
        groups.join(stash(sizes), F.col("root") == F.col("r"))
        .withColumn("n_blocks", F.ceil(F.col("m") / block))
        .select(F.col("node").alias("k"), F.col("root").alias("cc"), "n_blocks", F.pmod(F.xxhash64("node"), F.col("n_blocks")).alias("b"))
    )
    wanted = F.broadcast(members) if members.count() <= MOST_BROADCAST else members
    candidates = with_keys(keyed, "row_key", members.select(F.col("k").alias("row_key")))  # of a shuffle, these texts alone

    def sets_of(batches):
        for batch in batches:
            for first, end, own, x in shingle_sets(batch.column(1), n_words):
                stop = np.cumsum(own)
                sets = [x[b - s : b].tobytes() for s, b in zip(own, stop, strict=True)]
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column(0), *[part.column(i) for i in (2, 3, 4)], pa.array(sets, pa.binary())], names=["row_key", "cc", "n_blocks", "b", "tokens"])

    sets = stash(candidates.join(wanted, F.col("row_key") == F.col("k")).select("row_key", "text", "cc", "n_blocks", "b").mapInArrow(sets_of, "row_key long, cc long, n_blocks long, b long, tokens binary"))
    # every block of a component gets its leader's set as well
    leaders = sets.filter("row_key = cc").select("row_key", "cc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("b"), "tokens", F.lit(True).alias("lead"))
    compared = sets.filter("row_key != cc").select("row_key", "cc", "b", "tokens", F.lit(False).alias("lead")).unionByName(leaders)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lead", "row_key"], ascending=[False, True])
        ids = pdf["row_key"].to_numpy()
        links = _within([np.frombuffer(t, np.uint64) for t in pdf["tokens"]], percent)
        return pd.DataFrame({"u": [ids[i] for i, _ in links], "v": [ids[j] for _, j in links]}, dtype="int64")

    links = stash(compared.groupBy("cc", "b").applyInPandas(inside, "u long, v long"))
    wide = sets.filter("n_blocks > 1")
    if not wide.isEmpty():
        found = connected_components(links)
        label = stash(found.select(F.col("node").alias("k"), "root"))
        marked = wide.join(label, F.col("row_key") == F.col("k"), "left").withColumn("label", F.coalesce("root", F.col("row_key"))).drop("k", "root")
        lead = stash(marked.filter("row_key = cc").select(F.col("cc").alias("c"), F.col("label").alias("lead_label")))
        marked = stash(marked.join(lead, F.col("cc") == F.col("c")).drop("c"))
        rest = stash(marked.filter("label != lead_label").withColumn("rb", F.col("b")))
        pairs = stash(rest.select("cc", "rb").distinct()).withColumnRenamed("cc", "c")
        left = rest.select("cc", "rb", "row_key", "label", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("b"))
        right = marked.join(pairs, F.col("cc") == F.col("c")).select("cc", "rb", "b", "row_key", "label", "tokens")

        def across(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(a) and len(b):
                others = [np.frombuffer(t, np.uint64) for t in b["tokens"]]
                sizes, ids, labels = np.array([len(s) for s in others]), b["row_key"].to_numpy(), b["label"].to_numpy()
                own = [np.frombuffer(t, np.uint64) for t in a["tokens"]]
                for i, shared in answers(own, others, percent):
                    at = np.flatnonzero(_linked(len(own[i]), sizes, shared, percent) & (labels != a["label"].iloc[i]))
                    _, one = np.unique(labels[at], return_index=True)  # one link to each component
                    out += [(a["row_key"].iloc[i], ids[j]) for j in at[one]]
            return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

        more = left.groupBy("cc", "b", "rb").cogroup(right.groupBy("cc", "b", "rb")).applyInPandas(across, "u long, v long")
        links = links.unionByName(stash(more))
    return links


def shingle_counts(keyed: DataFrame, n_words: int = 3) -> DataFrame:
    """``keyed``: row_key, id, text. Returns row_key, id, n_shingles."""

    def run(batches):
        for batch in batches:
            sizes = np.concatenate([s for _, _, s, _ in shingle_sets(batch.column(2), n_words)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["row_key", "id", "n_shingles"])

    return keyed.select("row_key", "id", "text").mapInArrow(run, f"row_key long, id {keyed.schema['id'].dataType.simpleString()}, n_shingles long")


def ngram_join(docs: DataFrame, n_words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each document: id, ``n_shingles``, ``component_id`` (smallest id reachable by links)."""
    keyed = with_row_keys(docs, id=id_col, text=text_col)
    counts = stash(shingle_counts(keyed, n_words))
    found = stash(jaccard_components(keyed, n_words, percent, block)).select(F.col("row_key").alias("k"), "root")
    labelled = counts.join(found, F.col("row_key") == F.col("k"), "left").drop("k")
    least = stash(labelled.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("least"))).withColumnRenamed("root", "r")
    return labelled.join(least, F.col("root") == F.col("r"), "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("least", "id").alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents"))

"""Personal data: pattern matches, and a bootstrapped contextual extraction that adds to them.

The base finds e-mail addresses, IP addresses, card numbers and telephone numbers by their form. They are seeds of the
extraction, and so are values assigned to a few names (``password=...``), of a kind ``secret`` that the base lacks. The
words around a seed make lexical patterns: the two before it, the one before and the one after, and for values with
letters the second one before, whatever follows it, with the value's shape. Patterns and the identifier-like strings in
them (words, groups of digits, assigned values) form a bipartite graph, which Spark scores in turns: a pattern by what is
believed of its instances, an instance by the best pattern that vouches for a kind its form allows. What is found in one
turn supports patterns in the next. A seed of the base is certain. A secret is not: it begins at ``PRIOR`` and is added only
if a pattern with enough other seeds confirms it, and other words in its place (``token: see below``) count against that.
Occurrences of believed instances that the base doesn't cover are added with their kind.

Base matches are leftmost and do not overlap within a kind; matches that fail their check are dropped without retry.
All scanners take time in proportion to the text, also on long runs of one character class. Strings may have any length:
those of more than ``LONG`` characters stand in the graph by a digest.

Edge cases: a null text counts as empty; repeated documents are scanned each (an instance counts once in a pattern
however often they repeat it); an empty table gives an empty result; other columns are ignored; without seeds nothing
is added; of kinds with equal scores the last by name is taken; added spans never overlap base ones.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import added_schema, with_columns
from .common import fresh, read_table, stash, with_row_keys

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
#: Names whose assigned values are seeds of the kind ``secret``.
SEED_NAMES = frozenset("password passwd pwd secret token api_key apikey access_key".split())
#: Turns of the scoring; weight of an instance nothing is known of and of doubt in a pattern's score; believed instances
#: a pattern needs, and its least score.
TURNS, UNSEEN, DOUBT, SUPPORT, LEAST_SCORE = 3, 0.25, 1.0, 4, 0.7
#: What is believed of a secret before a pattern confirms it, and what must be believed of it in the end.
PRIOR, CONFIRMED = 0.6, 0.75
#: Characters of a string that the graph holds as it is.
LONG = 64
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that fails at the first digit of a run fails at the others too, so only that one is tried
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NAMED = re.compile(rf"(?i)(?:{'|'.join(sorted(SEED_NAMES))})[^\w=:]*[=:]")
_TOKEN = re.compile(r"""[^\s="'<>|;,:]+|[=:]""")
_ZERO = str.maketrans("123456789", "000000000")
_EDGE = ".,;:!?\"'()[]{}<>|*&%$#=“”„»«"


def emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        floor = at + 1
        if found:
            out.append((start, found.end()))
            floor = found.end()
        at = text.find("@", floor)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    """At most 255, however many zeros come first."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in ``KINDS``, then start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_small(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() <= 40 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def _short(word: str) -> str:
    return word if len(word) <= LONG else "#" + sha256(word.encode("utf-8", "surrogatepass")).hexdigest()


def _norm(word: str) -> str:
    return word if word in "=:" else _short(word.lower().strip(_EDGE).translate(_ZERO))


def _shape(core: str) -> str:
    """Classes of characters that a string has, and its length to a factor of two."""
    classes = {"0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in set(core)}
    return "".join(sorted(classes)) + str(len(core).bit_length())


def _context(tokens: list[tuple[int, int]], text: str, first: int, last: int, core: str = "") -> list[str]:
    """Patterns of a span over tokens ``first`` to ``last``: the two before; the one before and the one after; if ``core``
    is given, the second one before with the shape of ``core``."""
    left = [_norm(text[a:b]) for a, b in tokens[max(0, first - 2) : first]]
    right = _norm(text[slice(*tokens[last + 1])]) if last + 1 < len(tokens) else "</s>"
    left = ["<s>"] * (2 - len(left)) + left
    gap = [f"{left[0]} * _ {_short(_shape(core))}"] if core and first >= 2 else []
    return [f"{left[0]} {left[1]} _", f"{left[1]} _ {right}", *gap]


def _fits(core: str) -> list[str]:
    """The kinds that a string's form allows; none: it isn't like an identifier."""
    digits = sum("0" <= c <= "9" for c in core)
    letters = any(c.isalpha() for c in core)
    out = []
    if "@" in core and len(core) >= 6:
        out.append("email")
    elif not letters:
        out += ["ip"] * (core.count(".") == 3 and digits >= 4) + ["phone"] * (7 <= digits <= 15) + ["card"] * (13 <= digits <= 19 and luhn(_digits(core)))
    return out + [SECRET] * ("@" not in core and len(core) >= 8 and digits > 0)


def _numeric(word: str) -> bool:
    return all(c in "0123456789().+-/" for c in word) and any("0" <= c <= "9" for c in word)


def scan_text(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans, and occurrences for the graph: seeds (with their kind), other identifier-like strings (kind null) with
    the kinds that their form allows, and words in the place of a secret that can't be one (no kinds)."""
    base = base_spans(text)
    if not base and not _DIGIT.search(text) and "@" not in text and not (("=" in text or ":" in text) and _NAMED.search(text)):
        return [], []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = [a for a, _ in tokens]
    seen, covered = [], set()
    for kind, a, b in base:
        first, last = max(0, bisect_right(starts, a) - 1), max(0, bisect_right(starts, b - 1) - 1)
        covered.update(range(first, last + 1))
        seen.append({"kind": kind, "start": a, "end": b, "instance": _short(text[a:b].lower()), "fits": [kind], "patterns": _context(tokens, text, first, last)})
    i = 0
    while i < len(tokens):
        first = i
        i += 1
        if first in covered:
            continue
        a, b = tokens[first]
        if _numeric(text[a:b]):  # neighbouring groups of digits are one string
            while i < len(tokens) and i not in covered and tokens[i][0] == b + 1 and _numeric(text[slice(*tokens[i])]):
                b = tokens[i][1]
                i += 1
        word = text[a:b]
        core = word.strip(_EDGE)
        named = first >= 2 and text[slice(*tokens[first - 1])] in ("=", ":") and _norm(text[slice(*tokens[first - 2])]) in SEED_NAMES
        fits = _fits(core) if core else []
        if not fits and not (named and core):
            continue
        at = word.index(core)
        if core.count(")") > core.count("(") and word[at - 1 : at] == "(":
            at, core = at - 1, "(" + core
        a += at
        letters = SECRET in fits and any(c.isalpha() for c in core)
        kind = SECRET if named and letters else None
        seen.append({"kind": kind, "start": a, "end": a + len(core), "instance": _short(core.lower()), "fits": fits, "patterns": _context(tokens, text, first, i - 1, core if letters else "")})
    return [{"kind": k, "start": a, "end": b} for k, a, b in base], seen


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_SEEN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("fits", pa.list_(pa.string())), ("patterns", pa.list_(pa.string()))])
SPANS = "array<struct<kind: string, start: int, end: int>>"
ADDED = "array<struct<kind: string, start: int, end: int, seed: boolean>>"
_OUT = "array<struct<kind: string, start: int, end: int, instance: string, fits: array<string>, patterns: array<string>>>"


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", key: str | None = None) -> DataFrame:
    """row_key, id, ``base`` (spans) and ``seen`` (occurrences): one pass over the texts. ``key``: a column of ``docs``
    that tells rows apart; without one, rows are numbered in this pass."""

    def run(batches):
        for batch in batches:
            found = [scan_text(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.list_(_SPAN)), pa.array([x[1] for x in found], pa.list_(_SEEN))], names=["row_key", "id", "base", "seen"])

    own = F.col(key) if key else F.monotonically_increasing_id()
    keyed = docs.select(own.alias("row_key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"row_key long, id {kind}, base {SPANS}, seen {_OUT}")


def bootstrap(occurrences: DataFrame, turns: int = TURNS) -> DataFrame:
    """``occurrences``: instance, kind (null if unknown), ``fits`` (kinds that its form allows), pattern. Returns instance,
    kind, score for the seeds of the base (score 1), for the secrets that patterns confirm and for the instances that
    high-confidence patterns vouch for.

    An edge joins an instance and a pattern. Turn by turn: score of (pattern, kind) = sum of its instances' scores for
    the kind / (its believed instances + those that fit no kind + UNSEEN * the others + DOUBT), if SUPPORT instances or
    more are believed to be of the kind; score of an instance = the best of its patterns' scores for a kind it fits, if
    that is LEAST_SCORE or more; score of a secret among the seeds = 1 - (1 - PRIOR) * (1 - the best of its patterns'
    scores for secrets), returned if it is CONFIRMED or more. Only edges and scores are shuffled.
    """
    edges = stash(occurrences.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.max("fits").alias("fits")))
    prior = F.when(F.max("kind") == SECRET, PRIOR).otherwise(1.0)
    seeds = stash(edges.filter(F.col("kind").isNotNull()).groupBy("instance").agg(F.max("kind").alias("kind"), prior.alias("score")))
    sizes = stash(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.size("fits") == 0).alias("misses")))
    # instances whose score may change: all but the seeds of the base
    certain = seeds.filter(F.col("kind") != SECRET)
    open_seeds = seeds.filter(F.col("kind") == SECRET)
    moving = stash(
        edges.filter(F.size("fits") > 0)
        .select("pattern", "instance", "fits")
        .join(certain.select("instance"), "instance", "left_anti")
        .join(open_seeds.select("instance", F.lit(True).alias("seed")), "instance", "left")
        .withColumn("seed", F.coalesce("seed", F.lit(False)))
    )
    beliefs = seeds
    for _ in range(turns):
        told = edges.select("pattern", "instance").join(beliefs, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("n"))
        by_kind = told.groupBy("pattern").agg(F.sum("n").alias("known"), F.collect_list(F.struct("kind", "mass", "n")).alias("k"))  # one for each kind
        weight = F.col("known") + F.col("misses") + UNSEEN * (F.col("size") - F.col("known") - F.col("misses")) + DOUBT
        patterns = by_kind.join(sizes, "pattern").select("pattern", weight.alias("weight"), F.explode("k").alias("k")).select("pattern", "k.kind", (F.col("k.mass") / F.col("weight")).alias("score"), "k.n").filter(F.col("n") >= SUPPORT)
        vouched = F.when(F.col("seed"), F.col("kind") == SECRET).otherwise(F.array_contains("fits", F.col("kind")) & (F.col("score") >= LEAST_SCORE))
        found = moving.join(stash(patterns.select("pattern", "kind", "score")), "pattern").filter(vouched).groupBy("instance", "seed").agg(F.max(F.struct("score", "kind")).alias("b"))
        told_seeds = open_seeds.select("instance", "kind").join(found.filter("seed").select("instance", F.col("b.score").alias("best")), "instance", "left")
        moved = told_seeds.select("instance", "kind", (1.0 - (1.0 - PRIOR) * (1.0 - F.coalesce("best", F.lit(0.0)))).alias("score"))
        beliefs = stash(certain.unionByName(moved).unionByName(found.filter(~F.col("seed")).select("instance", "b.kind", "b.score")))
    return beliefs.join(open_seeds.select("instance", F.lit(True).alias("seed")), "instance", "left").filter(F.col("seed").isNull() | (F.col("score") >= CONFIRMED)).drop("seed")


def find_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", key: str | None = None) -> DataFrame:
    """One row for each document: row_key, id, ``base``, ``spans`` (base and added ones, by kind, then start) and
    ``discovered`` (how many of the added ones were no seeds)."""
    scanned = stash(scan(docs, text_col, id_col, key))
    seen = scanned.filter(F.size("seen") > 0).select("row_key", F.explode("seen").alias("s")).select("row_key", "s.*")
    believed = bootstrap(seen.select("instance", "kind", "fits", F.explode("patterns").alias("pattern")))
    more = (
        seen.filter(F.col("kind").isNull() | (F.col("kind") == SECRET))
        .select("row_key", "start", "end", "instance", "fits", F.col("kind").isNotNull().alias("seed"))
        .join(believed.select("instance", "kind"), "instance")
        .filter(F.array_contains("fits", F.col("kind")))
        .groupBy("row_key")
        .agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end", "seed"))).alias("added"))  # spans of one document
    )
    more = stash(more).withColumnRenamed("row_key", "k")
    clear = F.filter(F.coalesce("added", F.array().cast(ADDED)), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    plain = F.transform(clear, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    order = F.array(*[F.lit(k) for k in (*KINDS, SECRET)])
    place = F.transform(F.concat("base", plain), lambda s: F.struct(F.array_position(order, s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(place), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.join(more, F.col("row_key") == F.col("k"), "left").select("row_key", F.col("id").alias(id_col), "base", spans.alias("spans"), F.size(F.filter(clear, lambda s: ~s["seed"])).cast("long").alias("discovered"))


def redact(keyed: DataFrame, spans: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``keyed`` without its column ``key``, every span of ``spans`` (row_key as in ``key``, spans) replaced by its kind in
    brackets; other rows unchanged."""
    columns = [c for c in keyed.columns if c != key]
    mine, marked = fresh("k", keyed.columns), fresh("marks", keyed.columns)
    marks = stash(spans.filter(F.size("spans") > 0).select(F.col("row_key").alias(mine), F.col("spans").alias(marked)))

    def run(batches):
        at = columns.index(text_col)
        for batch in batches:
            out = []
            for text, own in zip(batch.column(at), batch.column(len(columns)), strict=True):
                text, own, done, parts = text.as_py(), own.as_py(), 0, []
                for s in sorted(own or [], key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= done:
                        parts += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
                    done = max(done, s["end"])
                out.append("".join(parts) + text[done:] if parts else text)
            yield with_columns(batch.select(columns), {text_col: pa.array(out, batch.schema.field(at).type)})

    joined = keyed.join(marks, F.col(key) == F.col(mine), "left").select(*columns, marked)
    return joined.mapInArrow(run, added_schema(keyed.select(columns).schema, f"`{text_col}` string"))


def redact_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs``, personal data in the text replaced."""
    key = fresh("row_key", docs.columns)
    keyed = with_row_keys(docs, key)
    return redact(keyed, find_spans(keyed, text_col, id_col, key), key, text_col)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(read_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = F.size("spans").cast("long")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), n.alias("n_spans"), (n - F.size("base")).alias("n_added"), F.col("discovered").alias("n_discovered"))

"""Conversation structure repair by an auction algorithm for shortest paths.

A conversation should give the role initials ``(s?(ua)+)?``. Its edits are paths through a lattice with a layer for each
gap between rows and four states in it (nothing yet; after s; after u; after a): K keeps a row, R gives it the role the
state asks for, D deletes it, I inserts an empty turn with that role. The auction keeps a path from the start and a whole-number price
for each node, never above an arc's cost plus the price of its end. It extends the path over the first tight arc in the
order D, I, K, R; where no arc is tight it raises the node's price to the least of arc plus price and steps back. When the
path gets to the end, prices along it are the costs to the end, so the arcs that are tight and least in order spell the
cheapest edits, ties to the smallest text. Prices start at the sum of each remaining row's cheapest edit.

Long lattices are cut into blocks of ``BLOCK`` rows: a block's end has the exact prices of the next block's four
states, so an auction for each state of its start gives that block's prices and paths, and edits are the same however it
is cut.

Rows are sorted by range (conversation, turn, role, digest of the text), so a conversation of any size is spread over
tasks, and packed into segments of bounded size. A conversation in one segment is repaired where it lies. Of the others
only faults travel, one byte a row: repeated turns are found by an aggregation of digests, one task runs the auction over the
bytes of a conversation (its result, ``audit``, has as many), and the repaired texts pass one task in order, a segment at a
time, since their digest is of the whole.

Edge cases: null ids, roles and texts count as one space; a null turn comes first; rows of one turn go by role and
digest of the text, so repeated rows stand together; a role is known by its first letter, any other than s, u and a fits
nowhere; a conversation without rows left has zeros, an empty audit and the digest of the empty text, so a repaired
conversation without turns; gaps that don't fit into a long are null; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stash

SPACE = " \t\n\x0b\x0c\r"
#: Rows and bytes of text in a segment; rows in a block of the lattice.
SEGMENT_ROWS, SEGMENT_BYTES, BLOCK = 512, 1 << 20, 128
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Faults, as they are counted.
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
NEVER = 1 << 60
LONG_MAX = (1 << 63) - 1
ROLES = {"s": 0, "u": 1, "a": 2}
#: States: nothing yet, after s, after u, after a; the role each asks for and the state after it.
ASKED, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: States that may end a conversation.
CLOSED = [0, NEVER, NEVER, 0]


def _arcs(code: int) -> list[list[tuple[str, int, int, int]]]:
    """For each state, the arcs over a row (letter, cost, layers on, next state) in the order of the letters. ``code``:
    role class + 4 * fault."""
    role, fault = code % 4, code // 4
    stays = fault not in (BLANK, DUPLICATE)
    extra = TRUNCATED if fault == CUT_OFF else 0
    out = []
    for state in range(4):
        arcs = [("D", DELETE, 1, state), ("I", INSERT, 0, AFTER[state])]
        if stays:
            if role == 0 and state == 0:
                arcs.append(("K", KEEP + extra, 1, 1))
            if role == (2 if state == 2 else 1):
                arcs.append(("K", KEEP + extra, 1, AFTER[state]))
            arcs.append(("R", REROLE + extra, 1, AFTER[state]))
        out.append(arcs)
    return out


ARCS = [_arcs(code) for code in range(16)]
LEAST = [min(a[1] for arcs in by_state for a in arcs if a[2]) for by_state in ARCS]
END_ARCS = [[("I", INSERT, 0, AFTER[state])] for state in range(4)]


def auction(codes: bytes, end: list[int], last: bool, states: tuple[int, ...]) -> list[int]:
    """Prices of all nodes (4 * layer + state), exact on the cheapest paths from ``states`` of the first layer.
    ``end``: the price of leaving from each state of the last layer, where ``last`` allows insertions, too."""
    n = len(codes)
    floor = [min(end)] * (n + 1)
    for i in range(n - 1, -1, -1):
        floor[i] = floor[i + 1] + LEAST[codes[i]]
    prices = [x for x in floor for _ in range(4)]
    for state in states:
        path = [state]
        while True:
            node = path[-1]
            layer, q = node >> 2, node & 3
            least, onto = (NEVER, -1) if layer < n else (end[q], -2)
            arcs = ARCS[codes[layer]][q] if layer < n else END_ARCS[q] if last else ()
            for _, cost, on, to in arcs:
                there = ((layer + on) << 2) + to
                if (c := cost + prices[there]) < least:
                    least, onto = c, there
            if prices[node] < least:
                prices[node] = least
                if len(path) > 1:
                    path.pop()
            elif onto == -2:
                break
            else:
                path.append(onto)
    return prices


def trace(codes: bytes, prices: list[int], end: list[int], last: bool, state: int) -> tuple[str, int]:
    """The letters of the first tight arcs from ``state`` on, and the state that the last layer is left from."""
    n, layer, letters = len(codes), 0, []
    while True:
        price = prices[4 * layer + state]
        if layer == n and price == end[state]:
            return "".join(letters), state
        arcs = ARCS[codes[layer]][state] if layer < n else END_ARCS[state] if last else ()
        letter, _, on, state = next(a for a in arcs if price == a[1] + prices[4 * (layer + a[2]) + a[3]])
        letters.append(letter)
        layer += on


def cheapest_edits(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """(cost, audit) of a conversation."""
    cuts = list(range(0, len(codes), block)) or [0]
    end, last, traces = CLOSED, True, []
    for start in reversed(cuts):
        part = codes[start : start + block]
        states = (0,) if start == 0 else (0, 1, 2, 3)
        prices = auction(part, end, last, states)
        traces.append({s: trace(part, prices, end, last, s) for s in states})
        end, last = prices[:4], False
    state, letters = 0, []
    for by_state in reversed(traces):
        some, state = by_state[state]
        letters.append(some)
    return end[0], "".join(letters)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage, and ``kept``: false on a row that was dropped (its text is empty)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(filled("role"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("fault", fault)
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("kept"), "fault")
    return out.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault")


def _fault_and_role() -> tuple[Column, Column]:
    """1 for blank, 3 for truncated, else 0; and the class of the role."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    fault = F.when(trimmed == "", BLANK).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), CUT_OFF).otherwise(FINE)
    role = F.coalesce(*[F.when(F.substring("role", 1, 1) == F.lit(r), c) for r, c in ROLES.items()], F.lit(3))
    return fault, role


SEGMENT = "part int, seq int, whole boolean, turns array<long>, roles array<string>, texts array<string>, codes binary, digests array<binary>"


def segments(conversations: DataFrame) -> DataFrame:
    """Damaged rows in order, some to a row. ``whole``: the conversation has no other segment."""
    fault, role = _fault_and_role()
    rows = damaged(conversations).withColumn("code", (role + 4 * fault).cast("tinyint")).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    # equal rows of one turn can go to several tasks, too
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    sorted_rows = rows.repartitionByRange(*order, F.col("tie")).sortWithinPartitions(*order).drop("tie", "copy").withColumn("part", F.spark_partition_id())
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    return sorted_rows.mapInArrow(_pack, f"conv_id {id_type}, {SEGMENT}")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"part": pa.int32(), "seq": pa.int32(), "whole": pa.bool_(), "turns": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "codes": pa.binary(), "digests": pa.list_(pa.binary())}
    id_type = None
    out: list[tuple] = []
    size = part = seq = 0
    current, rows, used, pieces, first = None, [], 0, 0, True  # the conversation at hand

    def cut(whole: bool):
        nonlocal rows, used, pieces, seq, size
        turns, roles, texts, codes, digests = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        out.append((current, part, seq, whole, turns, roles, texts, bytes(codes), digests))
        size += used
        rows, used, pieces, seq = [], 0, pieces + 1, seq + 1

    def flush() -> pa.RecordBatch:
        nonlocal out, size
        columns = list(zip(*out, strict=True))
        out, size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [id_type, *kinds.values()], strict=True)], names=["conv_id", *kinds])

    began = False
    for batch in batches:
        id_type = batch.schema.field("conv_id").type
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "code", "digest", "kept", "part")]
        for conv, turn, role, text, code, digest, kept, part in zip(*columns, strict=True):
            if not began or conv != current:
                if began:
                    cut(pieces == 0 and not first)
                    first = False
                current, began, pieces = conv, True, 0
            if kept:
                rows.append((turn, role, text, code, digest))
                used += len(text)
                if len(rows) >= SEGMENT_ROWS or used >= SEGMENT_BYTES:
                    cut(False)
            if size >= 4 * SEGMENT_BYTES or len(out) >= 4096:
                yield flush()
    if began:
        cut(False)  # the first and the last conversation of a task may go on in its neighbours
    if out:
        yield flush()


def _lines(edits: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of the turns that are left."""
    out, i = [], 0
    for e in edits:
        if e == "I":
            out.append(f"{ASKED[state]}:")
            state = AFTER[state]
            continue
        if e != "D":
            role = roles[i] if e == "K" else ASKED[state]
            out.append(f"{role}:{texts[i]}")
            state = 1 if role[:1] == "s" else AFTER[state]
        i += 1
    return out


def _summary(codes: bytes) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated, illegal."""
    faults = [c // 4 for c in codes]
    legal = {(0, 1), (1, 2), (2, 1)}
    illegal = sum((a % 4, b % 4) not in legal for a, b in zip(codes, codes[1:], strict=False))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT_OFF), illegal


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for turns, roles, texts, codes, digests in zip(*[batch.column(n).to_pylist() for n in ("turns", "roles", "texts", "codes", "digests")], strict=True):
            known = [t for t in turns if t is not None]
            gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
            seen, marked = set(), bytearray(codes)
            for i, (role, digest) in enumerate(zip(roles, digests, strict=True)):
                if marked[i] // 4 != BLANK:
                    if (role, digest) in seen:
                        marked[i] = marked[i] % 4 + 4 * DUPLICATE
                    seen.add((role, digest))
            cost, audit = cheapest_edits(bytes(marked))
            digest = hashlib.sha256("\n".join(_lines(audit, 0, roles, texts)).encode()).hexdigest()
            out.append((gaps if gaps <= LONG_MAX else None, *_summary(marked), cost, audit, digest))
        columns = zip(*out, strict=True) if out else [[]] * 8
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = ["conv_id", *(c.split()[0] for c in RESULT.split(", "))]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=names)


def _edit_segments(table: pa.Table) -> pa.Table:
    """One conversation's faults, a byte for each row, to the edits of each segment; the first also has the totals."""
    table = table.sort_by("pos")
    parts = table.column("codes").to_pylist()
    codes = b"".join(parts)
    cost, audit = cheapest_edits(codes)
    rows, at, row, state, stop = [], 0, 0, 0, 0
    for k, part in enumerate(parts):
        start, begin, stop = at, state, stop + len(part)
        while at < len(audit) and (row < stop or k == len(parts) - 1):
            e = audit[at]
            if e != "D":
                state = 1 if e == "K" and codes[row] % 4 == 0 else AFTER[state]
            row += e != "I"
            at += 1
        rows.append((audit[start:at], begin))
    totals = [(*_summary(codes), cost, audit)] + [(None,) * 6] * (len(parts) - 1)
    columns = [*zip(*rows, strict=True), *zip(*totals, strict=True)]
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 5, pa.string()]
    names = ["edits", "state", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    arrays = [table.column("conv_id"), table.column("pos"), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]]
    return pa.table(arrays, names=["conv_id", "pos", *names])


def _digest_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments by conversation and position to one digest for each conversation."""
    current, hasher, empty, id_type, began = None, None, True, None, False
    done: list[tuple] = []
    for batch in batches:
        id_type = batch.schema.field("conv_id").type
        for conv, edits, state, roles, texts in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "edits", "state", "roles", "texts")], strict=True):
            if not began or conv != current:
                if began:
                    done.append((current, hasher.hexdigest()))
                current, hasher, empty, began = conv, hashlib.sha256(), True, True
            if lines := _lines(edits, state, roles, texts):
                hasher.update(("" if empty else "\n").encode() + "\n".join(lines).encode())
                empty = False
    if began:
        done.append((current, hasher.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], id_type), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])


def _repair_spread(parts: DataFrame, id_type: str) -> DataFrame:
    """Conversations of several segments (or possibly so)."""
    parts = parts.withColumn("pos", F.shiftleft(F.col("part").cast("long"), 32) + F.col("seq"))
    rows = parts.select("conv_id", "pos", F.posexplode(F.arrays_zip("roles", "digests")).alias("i", "r"), "codes").select("conv_id", "pos", "i", "r.roles", "r.digests", F.ascii(F.substring(F.col("codes"), F.col("i") + 1, F.lit(1)).cast("string")).alias("code"))
    turning = rows.filter(F.floor(F.col("code") / 4) != BLANK).groupBy("conv_id", "roles", "digests").agg(F.min(F.struct("pos", "i")).alias("first"))
    firsts = turning.groupBy(F.col("first.pos").alias("at")).agg(F.collect_list(F.col("first.i")).alias("firsts"))  # a segment's rows at most
    known = parts.select("conv_id", "pos", "codes").join(firsts, F.col("pos") == F.col("at"), "left").drop("at")

    def mark(batches):
        for batch in batches:
            marked = []
            for codes, first in zip(batch.column("codes").to_pylist(), batch.column("firsts").to_pylist(), strict=True):
                new = set(first or ())
                marked.append(bytes(c if c // 4 == BLANK or i in new else c % 4 + 4 * DUPLICATE for i, c in enumerate(codes)))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("pos"), pa.array(marked, pa.binary())], names=["conv_id", "pos", "codes"])

    codes = known.mapInArrow(mark, f"conv_id {id_type}, pos long, codes binary")
    edited = stash(codes.groupBy("conv_id").applyInArrow(_edit_segments, f"conv_id {id_type}, pos long, edits string, state int, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "zstd")
    texts = parts.select("conv_id", "pos", "roles", "texts").join(edited.select(F.col("pos").alias("at"), "edits", "state"), F.col("pos") == F.col("at")).drop("at")
    digests = texts.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_digest_in_order, f"conv_id {id_type}, repaired_sha256 string")
    turns = parts.select("conv_id", F.explode_outer("turns").alias("turn")).groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1 - F.count("turn")
    gaps = turns.agg(F.when(F.count("turn") == 0, F.lit(0)).otherwise(F.when(span <= LONG_MAX, span)).cast("long").alias("gaps"))
    totals = edited.filter(F.col("audit").isNotNull()).select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    named = lambda df, new: df.withColumnRenamed("conv_id", new)
    joined = totals.join(named(gaps, "g"), F.col("conv_id").eqNullSafe(F.col("g"))).join(named(digests, "d"), F.col("conv_id").eqNullSafe(F.col("d")))
    return joined.select("conv_id", *(c.split()[0] for c in RESULT.split(", ")))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row for each ``conv_id``: its faults, the cheapest edits and the digest of the repaired conversation."""
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    packed = stash(segments(conversations), "zstd")
    whole = packed.filter("whole").select("conv_id", "turns", "roles", "texts", "codes", "digests").mapInArrow(_repair_whole, f"conv_id {id_type}, {RESULT}")
    return whole.unionByName(_repair_spread(packed.filter("NOT whole"), id_type))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(read_table(spark, sf_dir, "conversations"))


def _sql() -> str:
    """The cheapest edits as a recursion over rows that keeps, for each state, the least (cost, audit, lines)."""
    line = "|| CASE WHEN {s}.l = '' THEN '' ELSE chr(10) END || {line}"

    def step(state: str, cost: str, letter: str, text: str | None = None) -> str:
        lines = f"{state}.l " + (line.format(s=state, line=text) if text else "")
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'l': {lines}}}"

    never = "{'c': 1000000000, 'a': '', 'l': ''}"
    stays, extra = "f NOT IN ('b', 'd')", f"CASE WHEN f = 't' THEN {TRUNCATED} ELSE 0 END"
    keep = lambda s, i: f"CASE WHEN {stays} AND i = '{i}' THEN {step(s, extra, 'K', 'line')} ELSE {never} END"
    rerole = lambda s, role: f"CASE WHEN {stays} THEN {step(s, f'{REROLE} + ' + extra, 'R', repr(role + ':') + ' || text')} ELSE {never} END"
    over = {
        "t0": [step("s0", str(DELETE), "D")],
        "t1": [step("s1", str(DELETE), "D"), keep("s0", "s")],
        "t2": [step("s2", str(DELETE), "D"), *[f(s, x) for s in ("s0", "s1", "s3") for f, x in ((keep, "u"), (rerole, "user"))]],
        "t3": [step("s3", str(DELETE), "D"), keep("s2", "a"), rerole("s2", "assistant")],
    }
    least = lambda options: f"list_min([{', '.join(options)}])"
    moved = ", ".join(f"{least(o)} AS {t}" for t, o in over.items())
    after_user = least(["t2", *[step(t, str(INSERT), "I", "'user:'") for t in ("t0", "t1", "t3")]])
    seen = r"[^\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (
  SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda a, x: list_reduce(
    [xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295::BIGINT), 4294967295) % 20 AS h
  FROM src),
d AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT * FROM h UNION ALL SELECT * FROM h WHERE h = 3) WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM d),
f AS (
  SELECT *, left(role, 1) AS i, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS next, role || ':' || text AS line,
         CASE WHEN NOT regexp_matches(text, '{seen}') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd'
              WHEN regexp_extract(text, '({seen})[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f
  FROM o),
lat AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, {{'c': 0, 'a': '', 'l': ''}} AS s0, {never} AS s1,
         {{'c': {INSERT}, 'a': 'I', 'l': 'user:'}} AS s2, {{'c': {2 * INSERT}, 'a': 'II', 'l': 'user:' || chr(10) || 'assistant:'}} AS s3 FROM src
  UNION ALL
  SELECT conv_id, n, t0, t1, u2, {least(["t3", step("u2", str(INSERT), "I", "'assistant:'")])}
  FROM (SELECT *, {after_user} AS u2 FROM (
    SELECT lat.conv_id, f.n, {moved} FROM lat JOIN f ON f.conv_id IS NOT DISTINCT FROM lat.conv_id AND f.n = lat.n + 1))),
best AS (SELECT conv_id, arg_max(list_min([s0, s3]), n) AS b FROM lat GROUP BY conv_id),
total AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
         count(*) FILTER (f = 't') AS truncated, count(*) FILTER (next IS NOT NULL AND i || next NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, b.c::BIGINT AS cost, b.a AS audit, sha256(b.l) AS repaired_sha256
FROM best LEFT JOIN total ON total.conv_id IS NOT DISTINCT FROM best.conv_id
"""


OP13_SQL = _sql()

"""Conversation repair: the auction against dynamic programming, whole conversations against a direct repair."""

import hashlib
import random
import re
import zlib

import pytest

from ultraspan.llm import conversations as C

ROLE_OF = {"u": "user", "a": "assistant"}
WANTS = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """rows: (role, text, fault). (cost, audit, lines) of the cheapest edits, ties to the smaller audit."""

    def insertions(states):
        for _ in range(3):
            for q, role in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                if q in states:
                    c, a, lines = states[q]
                    offer(states, role, (c + 3, a + "I", (*lines, f"{ROLE_OF[role]}:")))
        return states

    def offer(states, q, option):
        if q not in states or option[:2] < states[q][:2]:
            states[q] = option

    states = insertions({"": (0, "", ())})
    for role, text, fault in rows:
        after = {}
        for q, (c, a, lines) in states.items():
            offer(after, q, (c + 4, a + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] and role[:1] in WANTS[q]:
                    offer(after, role[:1], (c + more, a + "K", (*lines, f"{role}:{text}")))
                for new in ROLE_OF:
                    if new in WANTS[q]:
                        offer(after, new, (c + 3 + more, a + "R", (*lines, f"{ROLE_OF[new]}:{text}")))
        states = insertions(after)
    return min((states[q] for q in ("", "a") if q in states), key=lambda s: s[:2])


def brute(table):
    by, out = {}, {}
    for r in table:
        by.setdefault(r[0], []).append(r)
    space = lambda x: " " if x is None else str(x)
    for conv, turns in by.items():
        rows = []
        for _, turn, role, text in turns:
            k = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
            role, text = space(role), space(text)
            text = "" if k == 1 else re.sub(r"[.!?]", "", text) if k == 2 else text
            rows += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in rows:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
            seen.add((role, text))
        numbered = [t for t, _, _ in rows if t is not None]
        gaps = max(numbered) - min(numbered) + 1 - len(set(numbered)) if numbered else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = cheapest([(role, text, f) for (_, role, text), f in zip(rows, faults, strict=True)])
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_table(seed, n, convs=60):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(pick(None, 1, 2, rng.randrange(convs)), pick(None, rng.randrange(30)), pick(None, "user", "assistant", "user", "assistant", "system", "tool", ""), pick(None, "", "a.", "b", "ä?", " \n", " ", "x" * 50, "c!", f"t{rng.randrange(9)}.")) for _ in range(n)]


def test_auction_against_dynamic_programming():
    rng = random.Random(3)
    names, faults = ["system", "user", "assistant", "tool"], ["", "blank", "duplicate", "truncated"]
    for _ in range(1500):
        codes = bytes(rng.choice([1, 2, 1, 2, rng.randrange(16)]) for _ in range(rng.randrange(14)))
        expected = cheapest([(names[c % 4], "", faults[c // 4]) for c in codes])[:2]
        assert C.cheapest_edits(codes) == C.cheapest_edits(codes, 3) == expected
    long = bytes(rng.randrange(16) for _ in range(1500))
    assert C.cheapest_edits(long) == cheapest([(names[c % 4], "", faults[c // 4]) for c in long])[:2]


def test_prices_are_never_above_the_costs_to_the_end():
    rng = random.Random(4)
    codes = bytes(rng.randrange(16) for _ in range(40))
    prices = C.auction(codes, C.CLOSED, True, (0, 1, 2, 3))
    for layer, code in enumerate(codes):
        for state in range(4):
            assert all(prices[4 * layer + state] <= cost + prices[4 * (layer + on) + to] for _, cost, on, to in C.ARCS[code][state])


@pytest.mark.parametrize("rows_in_segment", [2, 512])
def test_repair_against_brute_force(spark, monkeypatch, rows_in_segment):
    monkeypatch.setattr(C, "SEGMENT_ROWS", rows_in_segment)
    table = random_table(1, 2500)
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair_conversations(df).collect()}
    assert got == brute(table)


def test_edges(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, part int, codes string"
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = [(dropped, 0, "user", "gone."), (77, 1, "user", "y" * 2_000_000), (77, 2, "assistant", "z" * 1_500_000 + "."), *[(77, 3, "user", "again.")] * 3]
    df = spark.createDataFrame([(*r, 1, "x") for r in table], schema)
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair_conversations(df).collect()}
    assert got == brute(table)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    df.filter("false").write.parquet(f"{tmp_path}/conversations.parquet")
    out = C.op13_conversation_repair(spark, str(tmp_path))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"] and out.count() == 0

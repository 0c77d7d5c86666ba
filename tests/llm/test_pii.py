"""Secrets: seeds that patterns must confirm, words that count against a pattern, shapes, strings of any length."""

import random

import pytest
from pyspark.sql import functions as F

from ultraspan.llm import pii
from ultraspan.llm.common import stash

VALUES = ["ab81c8f77", "9d2e4f6a1", "k3j5h7g9z", "q8w6e4r2t", "z1x2c3v4b", "m5n6b7v8c"]


def spans(spark, texts):
    table = stash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2))
    return {r["doc_id"]: ([(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]], r["discovered"]) for r in pii.find_spans(table).collect()}


def test_a_secret_needs_a_pattern(spark):
    found = spans(spark, ["the token: Section12A is read by the parser", "secret: chapter2019 of the diary"])
    assert found == {0: ([], 0), 1: ([], 0)}


def test_patterns_confirm_seeds_and_discover(spark):
    rows = [f"so {a} password = {v} here" for a, v in zip("one two three four five six".split(), VALUES, strict=True)]
    plain = ["the token: Section12A is read by the parser", "secret: chapter2019 of the diary"]
    found = spans(spark, [*rows, "password is hunter2222", *plain])
    assert all(found[i] == ([("secret", v)], 0) for i, v in enumerate(VALUES))
    assert found[6] == ([("secret", "hunter2222")], 1)  # a gap and the shape of the others
    assert found[7] == found[8] == ([], 0)


def test_other_words_count_against_a_pattern(spark):
    rows = [f"token: {v} x{i}" for i, v in enumerate(VALUES[:4])]
    assert all(found == ([("secret", v)], 0) for found, v in zip(spans(spark, [r.replace(" x", " y ") for r in rows]).values(), VALUES, strict=False))
    prose = [f"a token: {w} and more" for w in "see below this section about words of parsers".split()]
    # prose without digits takes part, too; the values differ in shape, so no gap pattern has enough seeds
    odd = ["ab81c8f77", "Section12A", "9d2e4f6a19d2e4f6a19d2e4f6a1", "k3-j5-h7-g9"]
    found = spans(spark, [f"a token: {v} and" for v in odd] + prose)
    assert all(x == ([], 0) for x in found.values())


def test_long_strings_and_failed_checks(spark):
    long = "a1" * 200
    rows = [f"key password = {v} end" for v in [*VALUES, long]]
    numbers = " ".join(["12 34"] * 50)
    found = spans(spark, [*rows, f"x {numbers} y", "card 4111111111111111 ok"] + [f"card 411111111111111{d} ok" for d in (2, 3)])
    assert found[6] == ([("secret", long)], 0) and found[7] == ([], 0)
    assert found[8][0] == [("card", "4111111111111111")] and found[9] == found[10] == ([], 0)
    texts = ["x" * 100_000 + "=" + "7a" * 50_000, "1 " * 50_000, "password" * 20_000, "token = " * 20_000]
    assert all(x[0] == [] for x in spans(spark, texts).values())


def brute(rows, turns):
    members, kinds, fits = {}, {}, {}
    for i, k, f, p in rows:
        members.setdefault(p, set()).add(i)
        fits[i] = f
        if k:
            kinds[i] = max(kinds.get(i, ""), k)
    start = {i: (pii.PRIOR if k == pii.SECRET else 1.0, k) for i, k in kinds.items()}
    beliefs = dict(start)
    for _ in range(turns):
        scores = {}
        for p, own in members.items():
            known = [beliefs[i] for i in own if i in beliefs]
            misses = sum(not fits[i] for i in own)
            weight = len(known) + misses + pii.UNSEEN * (len(own) - len(known) - misses) + pii.DOUBT
            for kind in {k for _, k in known}:
                mass = [s for s, k in known if k == kind]
                if len(mass) >= pii.SUPPORT:
                    scores[p, kind] = sum(mass) / weight
        new = dict(start)
        for i in fits:
            mine = [(s, k) for (p, k), s in scores.items() if i in members[p]]
            if kinds.get(i) == pii.SECRET:
                best = max([s for s, k in mine if k == pii.SECRET], default=0.0)
                new[i] = (1 - (1 - pii.PRIOR) * (1 - best), pii.SECRET)
            elif i not in kinds:
                good = [(s, k) for s, k in mine if k in fits[i] and s >= pii.LEAST_SCORE]
                if good:
                    new[i] = max(good)
        beliefs = new
    return {i: b for i, b in beliefs.items() if kinds.get(i) != pii.SECRET or b[0] >= pii.CONFIRMED}


@pytest.mark.parametrize("turns", [1, 3])
def test_scores_against_brute_force(spark, turns):
    rng = random.Random(turns)
    rows = []
    for i in range(240):
        kind = rng.choice(["phone", pii.SECRET, pii.SECRET, None, "miss"])
        fits = [] if kind == "miss" else ["phone", pii.SECRET]
        for _ in range(rng.randrange(1, 4)):
            group = {"phone": 0, pii.SECRET: 10, "miss": 16}.get(kind, rng.choice([0, 10]))
            rows.append((f"i{i}", None if kind == "miss" else kind, fits, f"p{group + rng.randrange(9)}"))
    table = spark.createDataFrame(rows, "instance string, kind string, fits array<string>, pattern string")
    got = {r["instance"]: (pytest.approx(r["score"]), r["kind"]) for r in pii.bootstrap(table, turns).collect()}
    expected = brute(rows, turns)
    seeds = {i for i, k, _, _ in rows if k == pii.SECRET}
    assert got == expected and seeds & set(expected) and seeds - set(expected)


def test_no_rows(spark):
    table = spark.createDataFrame([(1, "a")], "doc_id long, text string").filter(F.col("doc_id") < 0)
    assert pii.find_spans(table).count() == 0

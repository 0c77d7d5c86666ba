"""Small tables: brute force, edge cases, held-out accuracy."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ultraspan.llm import decontaminate, language, licenses, mixing, ngram_join, pii, suffix_dedup, topk, toxicity, url_filter
from ultraspan.llm.arrowtext import SLICE_BYTES
from ultraspan.llm.common import stash, with_row_keys
from ultraspan.operators.components import connected_components
from ultraspan.llm.repeats import longest_previous_factors, super_strings, window_digests, word_bounds, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the and ing ion ent tha her ere of to".split(), "de": "ein sch ung der ich keit und ber ge".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def docs(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", [None] * len(texts))[i], columns.get("source", ["s"] * len(texts))[i], len(t) if t is not None else None) for i, t in enumerate(texts)]
    return stash(spark.createDataFrame(rows, DOCS).coalesce(2))


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


# mixing


def test_mixing_budgets_and_edges(spark, empty):
    rng = random.Random(1)
    texts = [prose(rng, "en", rng.randrange(0, 9)) for _ in range(300)] + [None, "", "a\u00a0b c"]
    sources = [rng.choice(["a", "b", "c", None]) for _ in texts]
    out = mixing.mix_sources(docs(spark, texts, source=sources), rows_per_slice=16).collect()
    assert len(out) == len(texts)
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or ""))
    total = sum(r["size"] for r in out)
    assert sum(rows[0]["target"] for rows in by.values()) == pytest.approx(1.5 * total)
    for rows in by.values():
        assert sum(r["taken"] for r in rows) == round(rows[0]["target"])
        assert rows[0]["source_size"] == sum(r["size"] for r in rows)
        # positions are the sizes before, in some order
        at = sorted((r["position"], r["size"]) for r in rows)
        assert all(p + s <= q for (p, s), (q, _) in zip(at, at[1:], strict=False))
    again = mixing.mix_sources(docs(spark, texts, source=sources).repartition(5), rows_per_slice=40).collect()
    assert {(r["doc_id"], r["taken"]) for r in out} == {(r["doc_id"], r["taken"]) for r in again}
    assert mixing.mix_sources(empty).count() == 0
    zero = mixing.mix_sources(docs(spark, [None, ""])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in zero] == [(0, 0.0, 0)] * 2
    clash = docs(spark, ["a b", "a b"]).withColumn("size", F.lit("x")).withColumn("target", F.lit(1))
    assert sorted(r["size"] for r in mixing.mix_sources(clash).collect()) == [2, 2]


# URLs


def test_urls(spark):
    urls = [None, "", "nothing", "http://EXAMPLE.org/es/x?q=/a#b", "http://a.b.example.org/en/12", "https://x.com/fr/", "https://x.com/de/y", "https://notexample.org", "http://org/", "http://xcom/de/", "ftp://example.org?x://y/", "https://x.com/de/y", "a://b://c/d", "http://example.org/es"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(pages, rules).collect()}
    assert len(got) == len(urls)
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("a.b.example.org", "/en/12", "example.org/en/1", "block")
    assert got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block") and got[11] == got[6]
    assert got[7] == ("notexample.org", "", None, "allow")
    assert got[8][2] == "org/" and got[9][2] is None
    assert got[10] == ("example.org", "", None, "allow")
    assert got[12] == ("b:", "//c/d", None, "allow")
    assert got[13][2] == "org/"
    assert url_filter.url_verdicts(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.url_verdicts(pages, rules.limit(0), default="block").collect()} == {"block"}
    many = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit(".net")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    hit = spark.createDataFrame([(1, "http://h77.net/a"), (2, "http://h5001.net/a")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(hit, many).collect()} == {1: "block", 2: "allow"}


# licences


def test_licences(spark, empty):
    rng = random.Random(2)
    plain = [prose(rng, "en", 40) + "\n" + prose(rng, "en", 30) for _ in range(120)]
    marked = ["x y z\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.\r\nmore", "Licensed&&& under%%% CC*** BY-NC### 4.0.", "one\nThis work is licensed under the GNU General Public License, version 3.\ntwo", None, "", "free the general license of nobody in particular", "All rights reserved.", "All rights reserved."]
    table = docs(spark, plain + marked).withColumn("family", F.lit("clash"))
    model = licenses.fit(table)
    got = [(r["doc_id"] - 120, r["paragraph_no"], r["family"]) for r in licenses.scan(table, model).collect() if r["confirmed"]]
    assert sorted(got) == [(0, 1, "mit"), (1, 0, "apache-2.0"), (2, 0, "cc-by-nc"), (3, 1, "gpl"), (7, 0, "proprietary"), (8, 0, "proprietary")]
    assert licenses.scan(empty, model).count() == 0


def test_every_licence_of_a_paragraph(spark):
    rng = random.Random(2)
    plain = [prose(rng, "en", 40) + "\n" + prose(rng, "en", 30) for _ in range(120)]
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."
    marked = [f"{bsd} All rights reserved.", "Released under the MIT License. Licensed under the Apache License, Version 2.0.", bsd, "All rights reserved."]
    table = docs(spark, plain + marked)
    got = {}
    for r in licenses.scan(table, licenses.fit(table)).filter("confirmed").collect():
        got.setdefault(r["doc_id"] - 120, set()).add(r["family"])
        assert 0 <= r["probability"] <= 1 and r["predicted"] == r["family"]
    assert got == {0: {"bsd", "proprietary"}, 1: {"mit", "apache-2.0"}, 2: {"bsd"}, 3: {"proprietary"}}


def test_similarity_against_brute_force(spark):
    rng = random.Random(12)
    split = lambda t: [w.strip(".") for w in re.split(r"[^\w.]+|_", t.lower()) if w.strip(".")]
    pairs = lambda t: set(zip(split(t), split(t)[1:], strict=False))
    lines = []
    for _, text in licenses.TEMPLATES:
        for _ in range(4):
            words = [w for w in text.split() if rng.random() < 0.85]
            lines.append(" ".join([*prose(rng, "en", 2).split(), *words, *prose(rng, "en", 2).split()]))
    table = docs(spark, [prose(rng, "en", 40) for _ in range(60)] + lines)
    rows = licenses.scan(table, licenses.fit(table)).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(found) >= 0.8 * len(lines)
    for i, r in found.items():
        shares = {}
        for family, text in licenses.TEMPLATES:
            shares[family] = max(shares.get(family, 0), len(pairs(lines[i - 60]) & pairs(text)) / len(pairs(text)))
        assert r["similarity"] == pytest.approx(shares[r["predicted"]])
        assert r["confirmed"] == (r["similarity"] >= licenses.CONFIRM) and r["family"] == (r["predicted"] if r["confirmed"] else "unknown")


def test_words_of_a_paragraph_are_computed_once(spark):
    """Each use of the words made Spark split the paragraph again: six times for one list of grams."""
    table = docs(spark, ["Released under the MIT License. v2.0.", "one", "...", "", None]).withColumnRenamed("text", "paragraph")
    for column, expected in (
        (licenses._grams("paragraph"), [["released", "under", "the", "mit", "license", "v2.0", "released under", "under the", "the mit", "mit license", "license v2.0"], ["one"], [], [], None]),
        (licenses._word_pairs(F.col("paragraph")), [["released under", "under the", "the mit", "mit license", "license v2.0"], [], [], [], []]),
    ):
        out = table.select("doc_id", column.alias("x"))
        assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
        assert [r["x"] for r in out.orderBy("doc_id").collect()] == expected


def test_licence_of_a_third_of_all_documents(spark):
    rng = random.Random(2)
    texts = ["\n".join(prose(rng, "en", 9) for _ in range(9)) + ("\nReleased under the MIT License." if i % 3 == 0 else "") for i in range(420)]
    table = docs(spark, texts)
    got = {r["doc_id"] for r in licenses.scan(table, licenses.fit(table)).collect() if r["confirmed"] and r["family"] == "mit"}
    assert got == set(range(0, 420, 3))


def test_wrapped_licences(spark):
    rng = random.Random(2)
    notices = [
        ("gpl", "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version."),
        ("bsd", " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"),
        ("isc", "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that the above\n# copyright notice and this permission notice appear in all copies."),
        ("apache-2.0", "// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0"),
    ]
    texts = [prose(rng, "en", 40) + "\n" + prose(rng, "en", 30) for _ in range(120)] + ["\n".join([prose(rng, "en", 9), prose(rng, "en", 9), n, prose(rng, "en", 40)]) for _, n in notices * 20]
    table = docs(spark, texts)
    got = [(r["doc_id"] - 120, r["paragraph_no"], r["family"]) for r in licenses.scan(table, licenses.fit(table)).collect() if r["confirmed"]]
    assert sorted(got) == [(i, 2, family) for i, (family, _) in enumerate(notices * 20)]


# language


def test_language(spark, empty):
    rng = random.Random(3)
    langs = ["en", "de"] * 60
    texts = [prose(rng, x, rng.randrange(3, 60)) for x in langs]
    model = language.fit(docs(spark, texts[:80], lang=langs[:80]))
    tests = texts[80:] + [None, "", "12 34 !!", "É", prose(rng, "de", 20000)]
    got = language.predict(docs(spark, tests).withColumn("lang_score", F.lit("clash")), model).orderBy("doc_id").collect()
    assert np.mean([r["lang_pred"] == x for r, x in zip(got[:40], langs[80:], strict=True)]) >= 0.95
    assert [r["lang_pred"] for r in got[40:43]] == ["und"] * 3 and got[43]["lang_pred"] in ("en", "de") and got[44]["lang_pred"] == "de"
    assert all(0 <= r["lang_score"] <= 1 for r in got)
    assert language.predict(empty, model).count() == 0
    none = language.predict(docs(spark, ["abc"]), language.fit(empty)).first()
    assert (none["lang_pred"], none["lang_score"]) == ("und", 0.0)


def byte_grams(text):
    low = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in f" {text}  ".encode())
    return [low[i : i + 4] for i in range(len(low) - 3) if low[i : i + 2] != b"  "]


def test_language_against_exact_counts(spark):
    """More languages than bits in a word; ties go to the language with more rows, then by name."""
    rng = random.Random(13)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    syllables = {f"l{i:02d}": ["".join(rng.choices(alphabet, k=3)) for _ in range(12)] for i in range(70)}
    text = lambda x, n: " ".join("".join(rng.choices(syllables[x], k=rng.randrange(1, 4))) for _ in range(n))
    langs = [x for x in syllables for _ in range(6)]
    texts = [text(x, 40) for x in langs]
    model = language.fit(docs(spark, texts, lang=langs))
    counts = {x: Counter(g for t, y in zip(texts, langs, strict=True) if y == x for g in byte_grams(t)) for x in syllables}
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    most = Counter()
    for c in share.values():
        for g, v in c.items():
            most[g] = max(most[g], v)
    held = {x: {g for g, n in c.items() if n >= language.LEAST_COUNT and share[x][g] >= language.LEAST_SHARE * most[g]} for x, c in counts.items()}
    tests = [text(x, rng.randrange(2, 30)) for x in syllables for _ in range(2)]
    got = [r["lang_pred"] for r in language.predict(docs(spark, tests), model).orderBy("doc_id").collect()]
    expected = [max(sorted(held), key=lambda x: sum(g in held[x] for g in byte_grams(t))) for t in tests]
    assert got == expected and {"l00", "l69"} <= set(got)
    tie = language.predict(docs(spark, ["qqqq " * 3]), model).first()
    assert tie["lang_pred"] == "l00" or any(g in h for g in byte_grams("qqqq " * 3) for h in held.values())


# search


@pytest.mark.parametrize("seed", [1, 2])
def test_topk_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(300, 8)) * (1 if seed == 1 else rng.random((300, 1)) * 5)).astype(np.float32)
    x[100:160] = x[7]  # ties
    rows = [(i, [float(v) for v in r], "e") for i, r in enumerate(x)] + [(300, None, "e"), (301, [1.0, None], "e"), (350, [float("nan")], "e"), (400, [float("inf")] * 8, "e"), (None, [1.0] * 8, "e"), (7, rows_of(x[7]), "e")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    got = {}
    for r in topk.top_k(table, table.filter(F.col("vec_id") % 50 == 0)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    expected = {}
    for i in range(0, 300, 50):
        s = q @ q[i]
        best = sorted((j for j in [*range(300), 7] if j != i), key=lambda j: (-s[j], j))[:5]
        expected[i] = {k + 1: (j, int(s[j])) for k, j in enumerate(best)}
    assert got == expected


def rows_of(v):
    return [float(a) for a in v]


def test_topk_in_many_groups_and_shares(spark, monkeypatch):
    """As on large tables: a task holds some blocks of vectors and some of the queries."""
    for name, value in (("BLOCK", 8), ("QUERY_BLOCK", 4), ("GROUP", 4), ("GROUPS", 2), ("TASK_QUERIES", 16)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (240, 4)).astype(float) / 256
    table = spark.createDataFrame([(i, rows_of(r)) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(table, table.filter("vec_id % 5 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = np.round(256 * x).astype(int)
    for i in range(0, 240, 5):
        s = q @ q[i]
        best = sorted((j for j in range(240) if j != i), key=lambda j: (-s[j], j))[:5]
        assert sorted(got[i]) == [(k + 1, j, int(s[j])) for k, j in enumerate(best)]
    assert len(got) == 48


def test_topk_few_rows(spark):
    table = spark.createDataFrame([(0, [0.5, 1.0]), (1, [1.0]), (50, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(table, table.filter("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 1, 128 * 256), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0)]
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_topk_repeated_ids_and_large_values(spark):
    big = float(1 << 20)
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0]), (50, [big, 1.0]), (51, [big, -1.0]), (52, [1e300, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(table, table.filter("vec_id % 50 = 0"), 4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    b = 256 << 20
    # every finite vector is a candidate; a score that doesn't fit into a long is null
    assert got[0] == {1: (52, None), 2: (50, 256 * b), 3: (51, 256 * b), 4: (1, 256 * 768)}
    assert got[50] == {1: (52, None), 2: (51, b * b - 65536), 3: (1, b * 768), 4: (1, b * 512)}


def test_topk_wide_vectors_against_whole_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) * 10.0 ** rng.choice([0, 0, 0, 5, 8, 9, 30]) for _ in range(3)]) for i in range(120)] + [(50, [1e8, 1.0]), (7, [-1e8, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [n * 256 // d for n, d in (x.as_integer_ratio() for x in v)]) for i, v in rows]
    got = {}
    for r in topk.top_k(table, table.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in (0, 100):
        own = next(v for i, v in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in whole if i != q)[:5]
        assert got[q] == {k + 1: (i, -s if abs(s) < 1 << 63 else None) for k, (s, i) in enumerate(best)}
    assert set(got) == {0, 50, 100}


def test_topk_leaves_out_far_annuli(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 12)) * 4
    x = (centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 12)) * 0.02).astype(float)
    table = stash(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert topk.scored_share(table, table.filter("vec_id % 50 = 0")) < 0.3


# toxicity


def test_toxicity(spark, empty):
    rng = random.Random(4)
    bad = ["zorgle", "blastfut", "grumwit"]
    texts, labels = [], []
    for _ in range(240):
        words = prose(rng, "en", rng.randrange(10, 60)).split()
        toxic = rng.random() < 0.3
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(". ".join([" ".join(words[:8]), " ".join(words[8:])]))
        labels.append(int(toxic))
    train = docs(spark, texts[:160]).withColumn("toxic", F.element_at(F.array(*[F.lit(y) for y in labels[:160]]), (F.col("doc_id") + 1).cast("int")))
    model = toxicity.fit(train)
    tests = texts[160:] + [None, "", "İİ fine words. you GRUMWIT!", "zorgle " * 5000]
    got = toxicity.tag(docs(spark, tests).withColumn("tox_score", F.lit("clash")), model).orderBy("doc_id").collect()
    right = np.mean([(r["tox_score"] >= toxicity.THRESHOLD) == y for r, y in zip(got[:80], labels[160:], strict=True)])
    assert right >= 0.95
    assert all(0 <= r["tox_score"] <= 1 for r in got) and got[80]["tox_spans"] == got[81]["tox_spans"] == []
    spans = got[82]["tox_spans"]
    assert [tests[82][s["start"] : s["end"]] for s in spans] == ["GRUMWIT"]
    assert len(got[83]["tox_spans"]) == 5000
    kept = toxicity.drop_toxic(docs(spark, tests).withColumn("tox_score", F.lit("clash")), model)
    assert kept.columns[-1] == "tox_score" and kept.filter("tox_score = 'clash'").count() == sum(r["tox_score"] < toxicity.THRESHOLD for r in got)
    assert toxicity.tag(empty, model).count() == 0
    assert toxicity.tag(docs(spark, ["a"]), toxicity.fit(train.withColumn("toxic", F.lit(0)))).first()["tox_score"] == 0.0
    # labels on wordless texts only: nothing is learned, nothing rejected
    for labels in ([1, 1], [1, 0]):
        wordless = toxicity.fit(docs(spark, ["", None]).withColumn("toxic", F.element_at(F.array(*map(F.lit, labels)), (F.col("doc_id") + 1).cast("int"))))
        assert {r["tox_score"] for r in toxicity.tag(docs(spark, tests), wordless).collect()} == {0.0}
        assert toxicity.drop_toxic(docs(spark, tests), wordless).count() == len(tests)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(5)
    e, (a, b, c) = rng.normal(size=5), (0.3, 0.7, -0.4)
    left, right = toxicity.forward_backward(e, np.array([0]), np.array([5]), a, b, c)
    weights = {}
    for y in np.ndindex(*[2] * 5):
        s, before = 0.0, 0
        for t, v in enumerate(y):
            s += e[t] * v + ((a if v else 0) if t == 0 or not before else (b if v else c))
            before = v
        weights[y] = math.exp(s)
    total = sum(weights.values())
    for t in range(5):
        assert 1 / (1 + math.exp(-(left[t] + right[t]))) == pytest.approx(sum(w for y, w in weights.items() if y[t]) / total)


# decontamination


def test_decontamination(spark, empty):
    rng = random.Random(6)
    item = "A train leaves at 14 and runs 90 km to Lisbon. How many hours does the trip of Anna take if she pays 20 euros for 3 tickets?"
    other = "A train leaves at 25 and runs 70 km to Madrid. How many hours does the trip of Pedro take if she pays 31 euros for 8 tickets?"
    mixed = "A train leaves at 14 and runs 14 km to Lisbon. How many hours does the trip of Lisbon take if she pays 14 euros for 14 tickets?"
    items = spark.createDataFrame([(1, item), (2, prose(rng, "de", 30)), (3, "too short"), (4, "alpha beta gamma delta epsilon"), (5, None), (1, item)], "item_id long, text string")
    noise = [prose(rng, "en", 50) for _ in range(20)]
    texts = noise + [f"{noise[0]}. {item} {noise[1]}", f"{noise[2]}. {other} {noise[3]}", f"{noise[4]}. {mixed}", "x. alpha beta gamma delta epsilon y", None, "", item[:50], f"{noise[0]}. {item}"]
    table = docs(spark, texts).withColumn("item_id", F.lit(9))
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.find_contaminated(table, items).collect()}
    assert got == {(20, 1): False, (21, 1): True, (23, 4): False, (27, 1): False}
    assert decontaminate.find_contaminated(empty, items).count() == 0
    assert decontaminate.find_contaminated(table, items.limit(0)).count() == 0


def test_decontamination_of_other_forms(spark):
    tom = "Tom has 5 red apples. Tom buys 3 more apples. Tom eats 2 apples. How many apples are left?"
    may = "In May Maria sent 48 cards to Peter and Susan and half as many to her old aunt"
    short = "Tom eats two very red apples"
    items = spark.createDataFrame([("q1", tom), ("q2", may), ("q3", short), (None, "alpha beta gamma delta epsilon zeta")], "item_id string, text string")
    texts = ["Anna has 7 red apples. Anna buys 4 more apples. Anna eats 1 apples. How many apples are left?", may.lower(), may.upper(), f"Question: {short}", "x alpha beta gamma delta epsilon zeta"]
    table = docs(spark, texts).withColumn("form", F.lit(1)).withColumn("hash", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.find_contaminated(table, items).collect()}
    assert got == {(0, "q1"): True, (1, "q2"): False, (2, "q2"): False, (3, "q3"): False, (4, None): False}


def brute_contaminated(texts, items):
    def forms(text):
        tokens = re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text or "")
        template, slots = [], []
        for i, t in enumerate(tokens):
            number = t[0].isdigit()
            unit = not number and t.lower() in decontaminate.UNITS and i > 0 and tokens[i - 1][0].isdigit()
            name = not number and not unit and t[0].isupper() and not (len(t) > 1 and t.isupper())
            template.append("<u>" if unit else "<n>" if number else "<name>" if name else t.lower())
            slots.append(number or unit or name)
        return tokens, (template, [t.lower() for t in tokens]), slots

    def one_to_one(pairs):
        return len(set(pairs)) == len({a for a, _ in pairs}) == len({b for _, b in pairs})

    out = set()
    for d, text in enumerate(texts):
        tokens, own, slots = forms(text)
        for i, item in items:
            them, theirs, free = forms(item)
            size = min(8, len(them))
            if size < 4:
                continue
            for form in (0, 1):
                places = range(len(them) - size + 1)
                if form == 0:
                    places = [p for p in places if size - sum(free[p : p + size]) >= 4] or list(places)
                copies = {}
                for p in places:
                    for at in range(len(tokens) - size + 1):
                        if own[form][at : at + size] == theirs[form][p : p + size]:
                            pairs = [(tokens[at + k].lower(), them[p + k].lower()) for k in range(size) if free[p + k]] if form == 0 else []
                            if one_to_one(pairs):
                                copies.setdefault(at - p, []).append((p, pairs))
                matched = set()
                for windows in copies.values():
                    fits = one_to_one([x for _, pairs in windows for x in pairs])
                    matched |= {p for p, pairs in windows if fits or all(a == b for a, b in pairs)}
                if len(matched) >= len(places) * decontaminate.COVER:
                    out.add((d, i))
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(16)
    word = lambda: rng.choice(["apples", "red", "has", "the", "a", "buys", "How", "Tom", "Anna", "5", "7.5", "km", "left", "many", "so"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(2, 20)))) for i in range(12)]
    texts = [None, "", "Tom " * 3000]
    for _ in range(120):
        _, text = rng.choice(items)
        text = " ".join(rng.choice([w, w, w, w, word()]) if rng.random() < 0.4 else w for w in text.split())
        for a, b in rng.sample([("Tom", "Anna"), ("5", "7.5"), ("apples", "pears"), ("has", "HAS"), ("How", "how")], 2):
            text = text.replace(a, b)
        texts.append(f"{word()} {word()}. {text} {word()}")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.find_contaminated(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()]
    expected = brute_contaminated(texts, items)
    assert sorted(got) == sorted(expected) and len(expected) > 40


# personal data


def brute_base(t):
    t, out = t or "", []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = [c for c in m.group() if c in "0123456789"]
            if k == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == "card" and not (13 <= len(d) <= 19 and pii.luhn("".join(d))):
                continue
            if k == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_base_spans_against_regular_expressions():
    rng = random.Random(7)
    for _ in range(3000):
        t = "".join(rng.choice("a1.@@+- 4(_é%\n") for _ in range(rng.randrange(0, 40)))
        assert pii.base_spans(t) == brute_base(t)
    for t in ("card 4111 1111-1111 1111 or 4111111111111112", "a@b.c@d.e f@g", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "+1 (415) 555-0100 +12"):
        assert pii.base_spans(t) == brute_base(t)
    assert pii.base_spans("a" * 200000 + "@" + "1" * 200000) == []
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}.0.0.0") == [("ip", 0, 5006)] and pii.base_spans(f"1{zeros}.0.0.0") == []
    assert pii.scan_text(f"{zeros} {zeros}" * 20)[0] == []


def test_discovered_identifiers_and_redaction(spark, empty):
    rng = random.Random(8)
    noise = lambda: prose(rng, "en", 5)
    texts = [f"{noise()} call my office at +1 415 555 01{i:02d} please {noise()}" for i in range(6)]
    # unseen by form: found by the pattern of the seeds; and it makes a pattern of its own with others of the kind
    texts += ["so call my office at (415) 555 0199 please now", "the code 4155550199x is plain", None, "", "mail a@b.org, a@b.org", "mail a@b.org, a@b.org"]
    texts += [f"{noise()} password={i}ab81c8f77 {noise()}" for i in range(5)] + ['my password = "only9letters" and', f"{noise()} passphrase 3ab81c8f77 {noise()}"]
    table = docs(spark, texts).withColumn("spans", F.lit(1)).withColumn("row_key", F.lit("clash")).withColumn("marks", F.lit(2))
    found = {r["doc_id"]: (r["base"], [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]]) for r in pii.find_spans(table).collect()}
    assert len(found) == len(texts)
    assert found[6] == ([], [("phone", "(415) 555 0199")])
    assert found[7] == found[8] == found[9] == ([], [])
    assert found[12] == ([], [("secret", "0ab81c8f77")]) and found[17] == ([], [("secret", "only9letters")])
    assert found[18] == ([], [("secret", "3ab81c8f77")])
    out = pii.redact_documents(table)
    assert out.columns == table.columns
    clean = {r["doc_id"]: r["text"] for r in out.collect()}
    assert clean[10] == clean[11] == "mail [EMAIL], [EMAIL]" and clean[6] == "so call my office at [PHONE] please now"
    assert clean[8] is None and clean[9] == "" and clean[7] == texts[7]
    assert pii.find_spans(empty).count() == 0 and pii.redact_documents(empty).count() == 0


def brute_bootstrap(rows, turns):
    seeds = {}
    for i, k, _, _ in rows:
        if k:
            seeds[i] = max(seeds.get(i, ""), k)
    fits = {i: f for i, _, f, _ in rows}
    of = {}
    for i, _, _, p in rows:
        of.setdefault(p, set()).add(i)
    beliefs = {i: (1.0, k) for i, k in seeds.items()}
    for _ in range(turns):
        found = {}
        for members in of.values():
            known = [beliefs[i] for i in members if i in beliefs]
            weight = len(known) + pii.UNSEEN * (len(members) - len(known)) + pii.DOUBT
            for kind in {k for _, k in known}:
                mass = [s for s, k in known if k == kind]
                score = sum(mass) / weight
                if len(mass) >= pii.SUPPORT and score >= pii.LEAST_SCORE:
                    for i in members - set(seeds):
                        if kind in fits[i]:
                            found[i] = max(found.get(i, (0, "")), (score, kind))
        beliefs = {i: (1.0, k) for i, k in seeds.items()} | found
    return beliefs


@pytest.mark.parametrize("turns", [1, 3])
def test_graph_scores_against_brute_force(spark, turns):
    rng = random.Random(turns)
    rows = []
    for i in range(160):
        kind = rng.choice(["phone", "card", None, None])
        for _ in range(rng.randrange(1, 4)):
            group = {"phone": 0, "card": 10, None: rng.choice([0, 10])}[kind]
            rows.append((f"i{i}", kind, ["card", "phone"] if i % 3 else ["phone"], f"p{group + rng.randrange(9)}"))
    table = spark.createDataFrame(rows, "instance string, kind string, fits array<string>, pattern string")
    got = {r["instance"]: (pytest.approx(r["score"]), r["kind"]) for r in pii.bootstrap(table, turns).collect()}
    expected = brute_bootstrap(rows, turns)
    assert got == expected and len(expected) > len({i for i, k, _, _ in rows if k}) + 5


# repeated passages


def brute_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        m = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if n[b[s : s + length]] > 1:
                m[s : s + length] = True
        runs = int((np.diff(np.concatenate([[0], m.astype(int), [0]])) == 1).sum())
        out.append((len(b), int(m.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return out


def removed(table, **options):
    out = suffix_dedup.remove_repeats(table, **options).orderBy("doc_id").collect()
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out]


def kept_first(texts, length):
    """Bytes left when a window goes that an earlier one (by document, then place) equals."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                m[s : s + length] = True
            seen.add(b[s : s + length])
        out.append(np.frombuffer(b, np.uint8)[~m].tobytes())
    return out


def passages(rng, n, words):
    parts = [prose(rng, "en", words) for _ in range(4)]
    texts = [None, "", "short", "ab" * 4 * words, "ab" * 3 * words, "é" * 5 * words]
    for _ in range(n):
        own = [prose(rng, "de", rng.randrange(1, words + 5)) for _ in range(2)]
        if rng.random() < 0.6:
            p = rng.choice(parts)
            own.insert(1, p[rng.randrange(9) : len(p) - rng.randrange(9)])
        texts.append(" ".join(own))
    return texts + texts[-3:]


@pytest.mark.parametrize("group", [1, 128])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_against_brute_force(spark, seed, group):
    texts = passages(random.Random(seed), 40, 20)
    table = docs(spark, texts).withColumn("ranges", F.lit(1)).withColumn("row_key", F.lit("clash"))
    assert removed(table, length=40, gram=16, group=group) == brute_removed(texts, 40)
    left = suffix_dedup.remove_repeats(table.coalesce(1).sortWithinPartitions("doc_id"), 40, "first", gram=16, group=group).orderBy("doc_id").collect()
    assert [bytes(r["kept"]) for r in left] == kept_first(texts, 40)


def test_repeats_at_full_length_in_a_large_group(spark):
    rng = random.Random(3)
    p = prose(rng, "en", 100)
    assert len(p.encode()) > 430
    texts = passages(rng, 30, 90) + [f"{prose(rng, 'de', 30)} {p[: len(p) - rng.randrange(40)]} {prose(rng, 'de', 30)}" for _ in range(150)] + [p * 100]
    expected = brute_removed(texts, 400)
    assert removed(docs(spark, texts), group=16) == expected == removed(docs(spark, texts), group=1000)


def test_keep_first(spark, empty):
    rng = random.Random(9)
    p = prose(rng, "en", 40)
    left = suffix_dedup.remove_repeats(docs(spark, [p, "x " + p, p, prose(rng, "de", 30)]), 40, "first", gram=16).orderBy("doc_id").collect()
    assert sorted(r["n_removed"] for r in left) == [0, 0, len(p), len(p)] and left[3]["n_removed"] == 0
    assert suffix_dedup.remove_repeats(empty, 40).count() == 0


def brute_shares(texts, words):
    held = {}
    for i, t in enumerate(texts):
        found = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        for (a, _), (_, b) in zip(found, found[words - 1 :], strict=False):
            held.setdefault(t[a:b], set()).add(i)
    return {i for x in held.values() if len(x) > 1 for i in x}


def test_short_passages_of_over_50_words(spark, empty):
    rng = random.Random(6)
    short = [" ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(n)) for n in (51, 50, 60, 51)]
    own = [prose(rng, "de", 70) for _ in range(12)]
    texts = [f"{own[2 * i]} {short[i]} {own[2 * i + 1]}" for i in range(3)] + [f"{prose(rng, 'en', 60)}\n{short[i]}\t{prose(rng, 'en', 5)}" for i in range(3)]
    texts += [short[3].replace(" ", "  "), f"{short[3]} {own[8]} {short[3]}", "twice " + own[9], "twice " + own[9], None, "", " ", own[10]]
    out = suffix_dedup.remove_repeats(docs(spark, texts), words=51).orderBy("doc_id").collect()
    assert {r["doc_id"] for r in out if r["shares_passage"]} == brute_shares(texts, 51) == {0, 2, 3, 5, 8, 9}
    assert [tuple(r)[1:5] for r in out] == brute_removed(texts, 400) and not any(r["n_removed"] for r in out[:8])
    assert suffix_dedup.remove_repeats(empty, words=51).count() == 0


@pytest.mark.parametrize(("words", "gram"), [(1, 1), (5, 8), (8, 4), (20, 8)])
def test_shared_passages_against_brute_force(spark, words, gram):
    rng = random.Random(words)
    texts = passages(rng, 60, words) + [" ".join(rng.choice("ab") for _ in range(rng.randrange(4 * words))) for _ in range(20)] + ["a b " * 50, "c " * 80, "\u00a0 \u00e9\x0b" * 30]
    table = docs(spark, texts)
    keyed = suffix_dedup.with_row_keys(table, id="doc_id", text="text")
    found = suffix_dedup.shared_passages(keyed, words, gram).join(keyed, "row_key").select("id").collect()
    assert sorted(r["id"] for r in found) == sorted(brute_shares(texts, words))


def test_windows_of_many_strings_at_once():
    texts = ["a b c d", "", "é\u00a0x y\tz ", "b c", " b c d", "a  b c"]
    digests, sizes = window_digests([t.encode() for t in texts], 3)
    assert sizes.tolist() == [2, 0, 1, 0, 1, 1]
    alone = [window_digests([t.encode()], 3)[0].tolist() for t in texts]
    assert digests.tolist() == sum(alone, []) and alone[4] == alone[0][1:] and len(set(digests.tolist())) == 4


def test_word_hashes_in_slices_of_any_size():
    short = np.frombuffer(b"one two three", np.uint8)
    long = np.concatenate([np.full(SLICE_BYTES, 32, np.uint8), short])
    found = [word_hashes(raw, *word_bounds(raw, np.array([0, len(raw)]))).tolist() for raw in (short, long)]
    assert found[0] == found[1] and len(set(found[0])) == 3


@pytest.mark.parametrize("length", [3, 6, 40, 100])
def test_longest_previous_factors(length):
    rng = random.Random(length)
    raw = bytes(rng.choice(b"ab") for _ in range(300)) + b"abc" * 60
    windows = np.array([i for i in range(len(raw) - length + 1) if i % 7])
    lpf, source = longest_previous_factors(np.frombuffer(raw, np.uint8), windows, length)

    def common(i, j):
        return next((k for k in range(length) if raw[i + k] != raw[j + k]), length)

    for k, i in enumerate(windows.tolist()):
        assert lpf[k] == max((common(i, j) for j in windows[:k].tolist()), default=0)
        assert source[k] < k and (source[k] < 0 or common(i, int(windows[source[k]])) == lpf[k])


def test_super_strings():
    text = np.frombuffer(prose(random.Random(1), "en", 200).encode(), np.uint8)
    _, first, n = super_strings(text, 40, 16)
    assert first[0] == 0 and (first[1:] == (first + n)[:-1]).all() and (first + n)[-1] == len(text) - 39


# near duplicates


def brute_components(texts, n, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            c = len(a & sets[j])
            if a and sets[j] and 100 * c >= percent * (len(a) + len(sets[j]) - c):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return [len(s) for s in sets], root


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 128), (5, 80, 128), (5, 80, 4), (2, 60, 8)])
def test_near_duplicates_against_brute_force(spark, n, percent, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", 6)
    rng = random.Random(10)
    line = prose(rng, "en", 9)
    texts = [None, "", "  ", "one", "ONE", "one two", "é É", "é é"]
    for _ in range(25):
        words = prose(rng, rng.choice(["en", "de"]), rng.randrange(1, 90)).split()
        for _ in range(rng.randrange(1, 8)):
            copy = list(words)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(["x", "y", "z"])
            texts.append(" ".join(copy + ([line] if rng.random() < 0.4 else [])))
    texts += [texts[-1].upper()] * 20
    table = docs(spark, texts).withColumn("root", F.lit("clash"))
    sizes, roots = brute_components(texts, n, percent)
    counts = ngram_join.ngram_join(table, n, percent, block=block).orderBy("doc_id").collect()
    assert [r["n_shingles"] for r in counts] == sizes and [r["component_id"] for r in counts] == roots


def test_near_duplicates_of_many_copies(spark, monkeypatch):
    """As on large tables: no broadcast by size, more candidates than may be broadcast. Of copies one is compared, and texts
    aren't shuffled to drop rows."""
    rng = random.Random(4)
    base = [prose(rng, "en", 40) for _ in range(30)]
    texts = base + [f"{b} end" for b in base[:8]] + base * 5
    keyed = with_row_keys(docs(spark, texts), id="doc_id", text="text")
    compared, edges = [], ngram_join.candidate_edges
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST", 0)
    monkeypatch.setattr(ngram_join, "candidate_edges", lambda rows, *a: compared.append(rows.count()) or edges(rows, *a))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r["row_key"]: r["root"] for r in ngram_join.jaccard_components(keyed, 5, 80).collect()}
        left = corpus_pipeline._without(keyed, "row_key", spark.createDataFrame([(k,) for k, root in found.items() if k != root], "row_key long"))
        assert left.count() == 30 and left.columns == ["id", "text"]
        assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    keys = [r["row_key"] for r in keyed.orderBy("id").collect()]
    assert [found[k] for k in keys] == [keys[i if i < 30 else i - 30 if i < 38 else (i - 38) % 30] for i in range(len(texts))]
    assert compared == [38]


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_derived_answers(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(12):
        s = rng.choice(1 << 40, rng.integers(1, 300), replace=False)
        for _ in range(rng.integers(1, 9)):
            s = np.union1d(rng.permutation(s)[rng.integers(0, 1 + len(s) // 20) :], rng.choice(1 << 40, rng.integers(0, 1 + len(s) // 30), replace=False))
            sets.append(s.astype(np.uint64))
    sizes = np.array([len(s) for s in sets])
    links = 0
    for i, shared in ngram_join.answers(sets, sets, percent):
        true = np.array([len(np.intersect1d(sets[i], t)) for t in sets])
        linked = ngram_join._linked(sizes[i], sizes, true, percent)
        assert (ngram_join._linked(sizes[i], sizes, shared, percent) == linked).all() and (shared[linked] == true[linked]).all()
        assert (shared <= true).all()
        links += int(linked.sum()) - 1
    assert links > 50


def test_near_duplicates_of_nothing(spark, empty):
    assert ngram_join.ngram_join(empty).count() == 0
    assert ngram_join.ngram_join(docs(spark, [None, "", " "])).filter("n_shingles = 0 and component_id = doc_id").count() == 3


def test_components_of_a_chain(spark):
    edges = spark.range(500).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = connected_components(edges)
    assert got.count() == 501 and got.filter("root != 0").count() == 0

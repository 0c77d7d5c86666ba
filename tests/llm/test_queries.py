"""The registered queries on small tables: their columns, one row for each document, held-out folds, reruns."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import brute_base, brute_components, brute_contaminated, brute_removed, docs, prose
from ultraspan.llm.queries import queries

ITEM = "A train leaves at 14 and runs 90 km to Lisbon and then it goes back to Porto with 3 more stops"
COLUMNS = {
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_topk_search": ["query_id", "rank", "vec_id", "score"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op8_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op9_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op10_ngram_join": ["doc_id", "n_shingles", "component_id"],
}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    passage = prose(rng, "en", 90)
    base = [prose(rng, "en", 30) + (" zorgle grumwit" if i % 3 == 0 else "") for i in range(30)]
    return [None, "", " ", *base, base[0], f"{base[1]} {passage} end", f"{base[2]} {passage} stop", f"{base[3]}. {ITEM}", "mail a@b.org or +1 (415) 555-0100 " * 3]


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs(spark, texts, lang=["en"] * len(texts)).withColumn("row_key", F.lit("clash")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0, int(3 <= i < 33 and (i - 3) % 3 == 0)) for i in range(33)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)] + [(100, None)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(1, "https://Example.org/es/x?q"), (2, None), (3, "http://a.com/de/")], "page_id long, url string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def rows(spark, folder):
    return {name: queries()[name](spark, folder).collect() for name in [*COLUMNS, "op5_decontaminate"]}


def test_contract_columns(rows, texts):
    for name, columns in COLUMNS.items():
        assert list(rows[name][0].asDict())[: len(columns)] == columns
        if columns[0] == "doc_id":
            assert sorted(r["doc_id"] for r in rows[name]) == list(range(len(texts)))


def test_folds_and_scores(rows):
    for name in ("op2_language_id", "op4_toxicity"):
        for r in rows[name]:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows["op4_toxicity"])
    assert {r["doc_id"] for r in rows["op2_language_id"] if r["lang_pred"] == "und"} == {0, 1, 2}


def test_against_brute_force(rows, texts):
    by = {name: {r["doc_id"]: r for r in rows[name]} for name in ("op8_pii", "op9_suffix_dedup", "op10_ngram_join")}
    for i, t in enumerate(texts):
        base = brute_base(t)
        assert [by["op8_pii"][i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(b[0] == k for b in base) for k in ("email", "ip", "card", "phone")]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(by["op8_pii"][i]["spans"].split(","))
    assert [tuple(by["op9_suffix_dedup"][i])[1:] for i in range(len(texts))] == brute_removed(texts, 400)
    sizes, roots = brute_components(texts, 3, 90)
    assert [tuple(by["op10_ngram_join"][i])[1:] for i in range(len(texts))] == list(zip(sizes, roots, strict=True))
    assert {(r["doc_id"], r["item_id"]) for r in rows["op5_decontaminate"]} == brute_contaminated(texts, [(1, ITEM)])


def test_verdicts_and_ranks(rows):
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows["op7_url_filter"]} == {1: ("example.org", "/es/x", "example.org/es/", "block"), 2: ("", "", None, "allow"), 3: ("a.com", "/de/", "com/de/", "block")}
    best = {}
    for r in rows["op3_topk_search"]:
        best.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(best) == {0, 50}
    for q, found in best.items():
        score = lambda i: 65536 * ((i % 7) * (q % 7) + 1)  # noqa: B023, E731
        expected = sorted((i for i in range(60) if i != q), key=lambda i: (-score(i), i))[:5]
        assert found == {k + 1: (i, score(i)) for k, i in enumerate(expected)}

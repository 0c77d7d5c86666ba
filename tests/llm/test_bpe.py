"""The tokenization automaton: an explicit one, the vocabulary's own library, round trips, edge cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import docs
from ultraspan.llm import bpe
from ultraspan.llm.common import stash


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer(path):
    return bpe.Tokenizer(path)


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def random_merges(rng, letters, n):
    labels, merges = [bytes([c]) for c in letters], []
    while len(merges) < n:
        a, b = rng.choice(labels), rng.choice(labels)
        if a + b not in labels:
            merges.append((a, b))
            labels.append(a + b)
    return merges


def explicit_automaton(merges, letters):
    """Arcs spelled out: each state is a dict of label to state."""
    arcs = [{bytes([c]): 0 for c in letters}]
    for u, v in merges:
        targets = {s[u] for s in arcs if u in s}
        split = {}
        for t in targets:
            if v in arcs[t]:
                split[t] = len(arcs)
                arcs.append(dict(arcs[t]))
                del arcs[split[t]][v]
        through = {t: arcs[t][v] for t in split}
        for s in arcs:
            if u in s and s[u] in split:
                t = s[u]
                s[u + v], s[u] = through[t], split[t]
    return arcs


def in_order(word, merges):
    """The merges, each applied from left to right."""
    parts = [bytes([b]) for b in word]
    for a, b in merges:
        i = 0
        while i + 1 < len(parts):
            if (parts[i], parts[i + 1]) == (a, b):
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


def test_gadgets_against_explicit_automaton_and_merges():
    rng = random.Random(2)
    for _ in range(60):
        letters = b"abc"[: rng.randrange(1, 4)]
        merges = random_merges(rng, letters, rng.randrange(1, 12))
        ids = {bytes([b]): b for b in range(256)} | {a + b: 256 + i for i, (a, b) in enumerate(merges)}
        own = bpe.Automaton(merges, ids)
        arcs = explicit_automaton(merges, letters)
        number = {label: n for n, label in enumerate(own.labels)}
        behind = {label: t for s in arcs for label, t in s.items()}
        for u, t in behind.items():
            if u in number:
                assert {x for x in arcs[t] if x in number} == {x for x in number if x[0] in letters and own.has_arc(number[u], number[x])}
        words = [bytes(rng.choice(letters) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
        for word, packed in zip(words, own.encode(words), strict=True):
            assert np.frombuffer(packed, "<u4").tolist() == [ids[p] for p in in_order(word, merges)]
            assert packed == own._encode_one(word)


def test_table_and_wrong_vocabularies():
    rng = random.Random(1)
    items = {rng.randrange(1 << 40): i for i in range(3000)}
    keys = np.array([*items, 5, 6, 7])
    assert bpe.Table(items).get(keys).tolist() == [*items.values(), -1, -1, -1]
    with pytest.raises(ValueError, match="two merges"):
        bpe.Automaton([(b"a", b"b"), (b"a", b"b")], {bytes([b]): b for b in range(256)} | {b"ab": 256})


TEXTS = ["", "a", " ", "  \n x", "it's we'll I'd", "<|endoftext|>", "a <|endoftext|>  b<|endoftext", "é" * 300, "a" * 1000, "=" * 70, "日本語 テキスト 12½", "՘౜ a\U00012550", "Ᲊx \U00013460y", "  \u0085᠎​.", " x"]


def random_texts(n):
    rng = random.Random(4)
    pools = ["ab ", "etaoinshr", "0123 .,", [chr(c) for c in range(0x20, 0x250)], [chr(rng.choice([rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x30000)])) for _ in range(400)], ["the", "ing", " ", "\n", "<|endoftext|>", "'s", "!!"]]
    return ["".join(rng.choice(rng.choice(pools[i % 6 :][:2])) for _ in range(rng.randrange(150))) for i in range(n)]


def test_ids_against_the_library(tokenizer, library, monkeypatch):
    monkeypatch.setattr(bpe, "CUT", 50)
    monkeypatch.setattr(bpe, "LONG", 120)
    texts = TEXTS + random_texts(1200)
    for text, packed, expected in zip(texts, tokenizer.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(packed, "<u4")
        assert ids.tolist() == expected.ids, text
        assert tokenizer.decode(ids).decode() == text == library.decode(expected.ids, skip_special_tokens=False)
    assert tokenizer.decode(np.array([127, 128], np.uint32)).decode() == library.decode([127, 128], skip_special_tokens=False)  # halves of letters
    with pytest.raises(ValueError, match="not in the vocabulary"):
        tokenizer.decode(np.array([99999]))


def test_every_code_point_is_cut_as_by_the_library():
    from tokenizers.pre_tokenizers import ByteLevel

    library = ByteLevel(add_prefix_space=False, use_regex=True)
    for base in range(0, 0x110000, 64):
        if not 0xD800 <= base < 0xE000:
            for step in (1, 64) if base < 0x3400 else (17,):
                text = "".join(f"a{c}1{c}{c}!{c} {c}" for c in map(chr, range(base, base + 64, step)))
                words = [w for part in bpe._word_lists(text, {}) for w in part]
                spans = np.cumsum([0, *map(len, words)])
                assert [p[1] for p in library.pre_tokenize_str(text)] == list(zip(spans.tolist(), spans[1:].tolist(), strict=False))


def test_documents(spark, tokenizer, library, tmp_path):
    texts = [None, *TEXTS, TEXTS[4]]
    table = docs(spark, texts).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    encoded = stash(bpe.encode(table, tokenizer))
    rows = sorted(bpe.decode(encoded, tokenizer).withColumn("list", bpe.unpacked()).collect())
    assert len(rows) == len(texts)
    for r in rows:
        expected = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["list"], r["n_tokens"], r["decoded"], r["source"]) == (expected, len(expected), texts[r["doc_id"]] or "", "s")
    table.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for r in bpe.op11_bpe(spark, str(tmp_path)).collect():
        text = texts[r["doc_id"]] or ""
        packed = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert list(r.asDict()) == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert tuple(r)[1:] == (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    none = bpe.decode(bpe.encode(table.filter("false"), tokenizer), tokenizer)
    assert none.count() == 0

"""Byte-pair encoding by a deterministic automaton, and decoding.

The merges of a vocabulary are compiled into an automaton over tokens by one gadget after the other. It starts with one
state and an arc for each byte. The gadget of the merge (u, v) works on the state that the arcs u lead to: a copy of it
without the arc v takes its place behind the arcs u, and every state with an arc u gets an arc uv to where the arc v led.
What the automaton then accepts is exactly the sequences that the merges, applied in order, can give; so a word has one
path, and so has each of its prefixes.

All arcs with one label lead to one state, so a state is known by the label before it. Spelled out, 50,000 merges have
2.5e9 arcs; here a state is its parent without one arc, and a label's column of arcs is a copy of the column of its left
part, so both are trees: the tables hold the arc that each gadget took away, and the left and right part of each label.
Whether an arc is there is looked up along the two trees, newest gadget first. A second table walks the labels byte by
byte. A word is encoded by moving along both tables: at each of its positions just one label can end with all arcs there,
and the path is read backwards from its end. Many words move at once, in numpy.

Words are the pieces that the byte-level pattern cuts a text into; their ids are kept in a bounded cache of each worker.
The compiled tables depend on the vocabulary file alone and are broadcast. Decoding emits the labels of the ids.

Edge cases: a null or empty text has no tokens and decodes to the empty text; the string of an added token in a text
becomes that token, as the vocabulary's own library does by default; bytes that aren't UTF-8 after decoding unknown
orders of ids are replaced by U+FFFD, an id outside the vocabulary is an error; a text is cut into words a bounded number
at a time, whatever its length, and words over ``WIDE`` bytes are encoded one by one; repeated rows and ids keep one row
each; empty tables give empty results; columns called like the new ones are replaced, others pass through.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import added_schema, text_slices, with_columns
from .common import read_table

VOCABULARY = "byte_bpe_50k.json"
#: Words of up to so many bytes are encoded together, in numpy; what stands between them there.
WIDE, END = 64, 256
#: Words whose ids a worker keeps; words of a long text that are cut at once.
CACHED, CUT = 400_000, 500_000
#: Characters of a text that is cut in one go.
LONG = 1 << 20
#: Ids decoded at once; bytes of text that a worker handles at once.
DECODED, SLICE = 1 << 18, 1 << 22


class Table:
    """Whole numbers to whole numbers >= 0, by open addressing; -1 for keys that aren't there."""

    def __init__(self, items: dict[int, int]):
        bits = max(8, (4 * len(items)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, values = np.fromiter(items.keys(), np.int64, len(items)), np.fromiter(items.values(), np.int64, len(items))
        slots = self._slots(keys)
        while len(keys):
            first = np.zeros(len(keys), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            put = first & (self.keys[slots] == -1)
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            keys, values, slots = keys[~put], values[~put], (slots[~put] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        at = self.keys[slots]
        out = np.where(at == keys, self.values[slots], np.int32(-1))
        open_ = np.flatnonzero((at != keys) & (at != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            at = self.keys[slots[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
        return out


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be seen, else the next one
    from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class Automaton:
    """``labels``: the bytes of each label, by label number (the bytes 0..255, then the merges in order); ``ids``: the
    vocabulary's id of each label."""

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int]):
        self.labels = [bytes([b]) for b in range(256)]
        self.left, self.right = list(range(256)), list(range(256))
        self.removed: dict[int, int] = {}
        number = {label: n for n, label in enumerate(self.labels)}
        for a, b in merges:
            u, v = number.get(a, -1), number.get(b, -1)
            if a + b in number:
                raise ValueError(f"two merges give {a + b!r}")
            if u >= 0 and v >= 0 and self.has_arc(u, v):  # else no text gets to this merge
                number[a + b] = self.removed[u << 32 | v] = len(self.labels)
                self.labels.append(a + b)
                self.left.append(u)
                self.right.append(v)
        steps: dict[int, int] = {}
        ends = [-1]
        for n, label in enumerate(self.labels):
            node = 0
            for byte in label:
                key = node << 9 | byte
                if key not in steps:
                    steps[key] = len(ends)
                    ends.append(-1)
                node = steps[key]
            ends[node] = n
        self.steps, self.ends = steps, ends
        self.ids = np.array([ids[label] for label in self.labels], np.uint32)
        self.step_table, self.removed_table = Table(steps), Table(self.removed)
        self.ends_array, self.left_array, self.right_array = np.array(ends, np.int32), np.array(self.left, np.int64), np.array(self.right, np.int64)
        self.size_array = np.array([len(x) for x in self.labels])

    def has_arc(self, u: int, t: int) -> bool:
        """Whether the state behind label ``u`` has an arc ``t``: no gadget took it away from a state that this one was
        copied from, while ``t``'s column was still that gadget's."""
        before = len(self.labels) + 1
        while True:
            taken = self.removed.get(u << 32 | t)
            if taken is not None and taken < before:
                return False
            if t >= 256 and t >= u:
                before, t = t + 1, self.left[t]  # the column of t is copied after the state of its own gadget
            elif u >= 256:
                before, u = u, self.right[u]  # the state behind u is the one behind its right part before its gadget
            else:
                return True

    def has_arcs(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """``has_arc`` of many pairs; ``u`` = -1 is the start, which has all arcs."""
        out = np.ones(len(u), bool)
        rest = np.flatnonzero(u >= 0)
        u, t = u[rest].astype(np.int64), t[rest].astype(np.int64)
        before = np.full(len(rest), len(self.labels) + 1)
        while len(rest):
            taken = self.removed_table.get(u << 32 | t)
            bad = (taken >= 0) & (taken < before)
            out[rest[bad]] = False
            go = ~bad & ((t >= 256) | (u >= 256))
            rest, u, t = rest[go], u[go], t[go]
            column = (t >= 256) & (t >= u)
            before = np.where(column, t + 1, u)
            u, t = np.where(column, u, self.right_array[u]), np.where(column, self.left_array[t], t)
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit numbers."""
        out = [self._encode_one(w) if len(w) > WIDE else b"" for w in words]
        short = [i for i, w in enumerate(words) if 0 < len(w) <= WIDE]
        if not short:
            return out
        sizes = np.array([len(words[i]) for i in short])
        ends = np.cumsum(sizes + 1) - 1  # each word is followed by END, where no label goes on
        text = np.full(ends[-1] + 1, END, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.frombuffer(b"".join(words[i] for i in short), np.uint8)
        place = np.arange(len(text)) - np.repeat(ends - sizes, sizes + 1)
        # all labels that the text holds, from each position on
        starts = np.flatnonzero(inside)
        node, at, found = np.zeros(len(starts), np.int64), starts, []
        while len(starts):
            node = self.step_table.get(node << 9 | text[at]).astype(np.int64)
            on = node >= 0
            node, starts, at = node[on], starts[on], at[on] + 1
            label = self.ends_array[node]
            some = label >= 0
            found.append((starts[some], at[some], label[some]))
        first, end, label = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(place[first], kind="stable")
        first, end, label = first[order], end[order], label[order].astype(np.int64)
        cuts = np.searchsorted(place[first], np.arange(sizes.max() + 1))
        last = np.full(len(text), -1, np.int64)  # the label that ends before each position
        for a, b in zip(cuts, cuts[1:], strict=False):
            fits = self.has_arcs(last[first[a:b]], label[a:b])
            last[end[a:b][fits]] = label[a:b][fits]
        # backwards from the ends; labels are written where they start
        taken = np.full(len(text), -1, np.int64)
        at, begins = ends, ends - sizes
        while len(at):
            back = last[at]
            at = at - self.size_array[back]
            taken[at] = back
            going = at > begins
            at, begins = at[going], begins[going]
        kept = np.flatnonzero(taken >= 0)
        flat = self.ids[taken[kept]].astype("<u4").tobytes()
        upto = 4 * np.searchsorted(kept, ends)
        before = 0
        for i, to in zip(short, upto.tolist(), strict=True):
            out[i] = flat[before:to]
            before = to
        return out

    def _encode_one(self, word: bytes) -> bytes:
        """The same for one long word; positions that no label reaches yet hold -1."""
        last = [-1] * (len(word) + 1)
        known: dict[tuple[int, int], bool] = {}
        for p in range(len(word)):
            node = 0
            for q in range(p, len(word)):
                node = self.steps.get(node << 9 | word[q], -1)
                if node < 0:
                    break
                if (t := self.ends[node]) >= 0:
                    pair = (last[p], t)
                    if pair not in known:
                        known[pair] = p == 0 or self.has_arc(*pair)
                    if known[pair]:
                        last[q + 1] = t
        path, at = [], len(word)
        while at:
            path.append(last[at])
            at -= len(self.labels[last[at]])
        return self.ids[path[::-1]].astype("<u4").tobytes()


class Tokenizer:
    """A compiled vocabulary: automaton, added tokens, and the labels of all ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("a byte-level BPE vocabulary without normalisation is needed")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that depend on their neighbours are not supported")
        ids = {raw(s): i for s, i in model["vocab"].items() if s not in self.added}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = Automaton([(raw(a), raw(b)) for a, b in merges], ids)
        labels = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.added.items()}
        known = [labels.get(i) for i in range(max(labels) + 1)]
        self.known = np.array([x is not None for x in known])
        self.sizes = np.array([len(x or b"") for x in known])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.blob = np.frombuffer(b"".join(x or b"" for x in known), np.uint8)
        self.cache: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        out = [[] for _ in texts]
        pending: list[tuple[int, list[str]]] = []
        count = 0
        for i, text in enumerate(texts):
            for words in _word_lists(text, self.added):
                pending.append((i, words))
                count += len(words)
                if count >= CUT:
                    self._flush(pending, out)
                    pending, count = [], 0
        self._flush(pending, out)
        return [b"".join(x) for x in out]

    def _flush(self, pending: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if len(self.cache) > CACHED:
            self.cache.clear()
        new = {w for _, words in pending for w in words if w not in self.cache}
        for w in new & self.added.keys():  # only added tokens are cut out as such: a word with their letters is shorter
            self.cache[w] = np.uint32(self.added[w]).astype("<u4").tobytes()
        new = list(new - self.added.keys())
        self.cache.update(zip(new, self.automaton.encode([w.encode() for w in new]), strict=True))
        get = self.cache.__getitem__
        for i, words in pending:
            out[i].append(b"".join(map(get, words)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of ``ids`` one after the other, as UTF-8."""
        if len(ids) and (int(ids.max()) >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        parts = []
        for s in range(0, len(ids), DECODED):
            part = ids[s : s + DECODED]
            size = self.sizes[part]
            ends = np.cumsum(size)
            parts.append(self.blob[np.repeat(self.starts[part] - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(parts).decode("utf-8", "replace").encode()


# fixed values: letters and numbers of Unicode 16 (first and last code point), which Python's tables may not have yet
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)

#: The byte-level pattern, as published with its vocabularies.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@lru_cache(maxsize=1)
def _newer() -> tuple[regex.Pattern, regex.Pattern]:
    """Code points that are letters or numbers to ``regex`` but not in Unicode 16, the version the vocabulary's library
    goes by: a quick test that can tell they are absent, and the pattern of one of them."""
    known = {c for a, b in UNICODE_16 for c in range(a, b + 1)}
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = [m.group() for m in regex.finditer(r"[\p{L}\p{N}]", points) if unicodedata.category(m.group())[0] not in "LN" and ord(m.group()) not in known]
    low = min(new, default=chr(0x10FFFF))
    return regex.compile(f"[{low}-{chr(0x10FFFF)}]"), regex.compile(f"[{''.join(new)}]" if new else r"(?!)")


def _spans(text: str) -> Iterator[str]:
    """The words of a text one by one."""
    quick, newer = _newer()
    # a private character is neither letter, number nor space, too
    like = newer.sub("\uE000", text) if quick.search(text) else text
    return (text[m.start() : m.end()] for m in PATTERN.finditer(like))


def _word_lists(text: str, added: dict[str, int]) -> Iterator[list[str]]:
    """The words of a text, in lists of bounded length. An added token is a word of its own; the text on either side of
    it is cut as if it stood alone."""
    quick, newer = _newer()
    parts = regex.split("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")", text) if any(a in text for a in added) else [text]
    for k, part in enumerate(parts):
        if k % 2:
            yield [part]
        elif len(part) <= LONG and not (quick.search(part) and newer.search(part)):
            yield PATTERN.findall(part)
        else:
            words = _spans(part)
            while some := list(islice(words, CUT)):
                yield some


def encode(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit numbers) and their number."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # its size is the vocabulary's
    schema = added_schema(docs.schema, f"`{ids}` binary, `{count}` long")

    def run(batches):
        tok = shared.value
        for batch in batches:
            for a, b, offsets, data in text_slices(batch.column(text), SLICE):
                raw = data.tobytes()
                packed = tok.encode([raw[offsets[i] : offsets[i + 1]].decode() for i in range(b - a)])
                part = batch.slice(a, b - a)
                yield with_columns(part, {ids: pa.array(packed, pa.binary()), count: pa.array([len(x) // 4 for x in packed], pa.int64())})

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: Tokenizer, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its packed ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer)
    schema = added_schema(encoded.schema, f"`{text}` string")

    def run(batches):
        tok = shared.value
        for batch in batches:
            for a, b, offsets, data in text_slices(batch.column(ids), SLICE):
                raw = data.tobytes()
                texts = [tok.decode(np.frombuffer(raw, "<u4", (offsets[i + 1] - offsets[i]) // 4, offsets[i])) for i in range(b - a)]
                yield with_columns(batch.slice(a, b - a), {text: pa.array(texts, pa.binary()).cast(pa.string())})

    return encoded.mapInArrow(run, schema)


def unpacked(ids: str = "ids"):
    """Packed ids as an array of longs: each byte pair of hex digits, the last byte first."""
    digits = F.hex(ids)
    word = lambda i: F.substring(digits, i * 8 + 1, F.lit(8))
    number = lambda w: F.conv(F.concat(*[F.substring(w, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    n = (F.length(ids) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: number(word(i)))).otherwise(F.array().cast("array<long>"))


def op11_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """``vocabulary``: path of the vocabulary file, on the driver."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    tokenizer = Tokenizer(vocabulary)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs, tokenizer).drop("text"), tokenizer)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

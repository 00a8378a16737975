"""BPE encoding and decoding with contiguous rank arrays.

A short word is a row of adjacent ranks beside its part boundaries. The least rank of the row is found by a scan, the
boundary behind it is deleted, and the two ranks next to it are looked up again; this goes on until no rank is left.
All new words of a batch do so at once, as rows of one array. A long word, for which scanning would be quadratic,
takes its next pair from a heap instead, in the same order. Words already encoded are kept in a bounded store.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import MADE, small_batches, tidy

#: Fixed values of the vocabulary file's format.
END = "</w>"
BLANKS = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
BLANK = "".join(map(chr, BLANKS))
SPLIT = rf"[\p{{L}}]+|[\p{{N}}]|'s|'t|'re|'ve|'m|'ll|'d|[^{BLANK}\p{{L}}\p{{N}}]+"
NONE = np.int64(1 << 40)
SHORT = 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, others follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in own else extra))
        extra += b not in own
    return out


def _ranges(kind: str) -> str:
    """The code points below U+10000 of a general category, for a character class."""
    own = [c for c in range(0x10000) if unicodedata.category(chr(c))[0] == kind]
    starts = [c for k, c in enumerate(own) if not k or own[k - 1] != c - 1]
    ends = [c for k, c in enumerate(own) if k + 1 == len(own) or own[k + 1] != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


def check_settings(spec: dict) -> None:
    """Raises unless a file asks for what is built in here: composed, blanks folded, lower-cased; words, single digits
    and runs of marks; byte letters with an end-of-word mark; no decoder."""
    model, norm, split = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    wanted = {
        "normalizer": [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"],
        "pre_tokenizer": [x["type"] for x in split.get("pretokenizers", [])] == ["Split", "ByteLevel"] and split["pretokenizers"][0].get("invert") is True,
        "decoder": spec.get("decoder") is None, "end of word": model.get("end_of_word_suffix") == END, "model": model.get("type") == "BPE" and not model.get("byte_fallback") and not model.get("ignore_merges"),
    }
    if wrong := [k for k, ok in wanted.items() if not ok]:
        raise ValueError(f"the vocabulary file has other settings than this codec: {', '.join(wrong)}")


class RankBpe:
    """Encoder and decoder of one vocabulary file, given as its JSON text."""

    def __init__(self, source: str, keep: int = 200_000):
        import regex

        spec = json.loads(source)
        check_settings(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        added = spec.get("added_tokens", [])
        self.tokens = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in added}
        self.names = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.added = {x["content"]: x["id"] for x in added}
        self.outside = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        letter, number = _ranges("L"), _ranges("N")
        rest = f"'s|'t|'re|'ve|'m|'ll|'d|[^{BLANK}"
        self.ascii = re.compile(f"[a-z]+|[0-9]|{rest}a-z0-9]+")
        self.plane = re.compile(f"[{letter}]+|[{number}]|{rest}{letter}{number}]+")
        self.above = re.compile(f"[{chr(0x10000)}-{chr(0x10FFFF)}]")
        self.split = regex.compile(SPLIT)
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([self.vocab[c + END] for c in letters], dtype=np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        keys = np.array([(self.vocab[a] << 20) | self.vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.rank_of = {int(k): r for r, k in enumerate(keys)}
        self.keep, self.known = keep, {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def _short(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of 1 to SHORT bytes, as little-endian 32-bit integers."""
        n = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        width = int(n.max())
        inside = np.arange(width) < n[:, None]
        parts = np.full((len(words), width + 1), -1, dtype=np.int64)
        parts[:, :width][inside] = self.inner[flat]
        parts[np.arange(len(words)), n - 1] = self.last[flat[np.cumsum(n) - 1]]
        ranks = self._rank(parts[:, :-1], parts[:, 1:])
        out, row = [b""] * len(words), np.arange(len(words))
        cols = np.arange(width)
        while len(row):
            at = ranks.argmin(axis=1)
            i = np.arange(len(row))
            best = ranks[i, at]
            over = best == NONE
            if over.any():
                size = (parts[over] >= 0).sum(axis=1)
                for k, ids, m in zip(row[over].tolist(), parts[over].astype("<u4"), size.tolist(), strict=True):
                    out[k] = ids[:m].tobytes()
                stay = ~over
                row, parts, ranks, at, best = row[stay], parts[stay], ranks[stay], at[stay], best[stay]
                i = np.arange(len(row))
                if not len(row):
                    break
            behind = cols[None, :] >= at[:, None]
            shifted = np.where(behind, np.concatenate([parts[:, 2:], np.full((len(row), 1), -1)], axis=1), parts[:, 1:])
            parts = np.concatenate([parts[:, :1], shifted], axis=1)
            parts[i, at] = self.made[best]
            ranks = np.where(behind, np.concatenate([ranks[:, 1:], np.full((len(row), 1), NONE)], axis=1), ranks)
            ranks[i, at] = self._rank(parts[i, at], parts[i, at + 1])
            left = np.maximum(at - 1, 0)
            ranks[i, left] = np.where(at > 0, self._rank(parts[i, left], parts[i, at]), ranks[i, left])
        return out

    def _long(self, word: bytes) -> bytes:
        """The same for a word of any length, in O(n log n)."""
        ids = self.inner[np.frombuffer(word, dtype=np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        n = len(ids)
        after, before, rank_of = [*range(1, n), -1], [-1, *range(n - 1)], self.rank_of
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of.get((ids[i] << 20) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.made[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := rank_of.get((ids[x] << 20) | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        short = [k for k, w in enumerate(raw) if len(w) <= SHORT]
        for lo in range(0, len(short), 8192):
            some = short[lo : lo + 8192]
            some.sort(key=lambda k: len(raw[k]))
            for part in range(0, len(some), 1024):
                piece = some[part : part + 1024]
                for k, ids in zip(piece, self._short([raw[k] for k in piece]), strict=True):
                    self.known[words[k]] = ids
        for k, w in enumerate(raw):
            if len(w) > SHORT:
                self.known[words[k]] = self._long(w)

    @staticmethod
    def normalise(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if chr(0x3A3) in text:  # lower case letter by letter: no final form
                return "".join([c.lower() for c in text])
        return text.lower()

    def cut(self, text: str) -> list[str]:
        """Words of a text without added tokens."""
        text = self.normalise(text)
        if text.isascii():
            return self.ascii.findall(text)
        return (self.split if self.above.search(text) else self.plane).findall(text)

    def _parts(self, text: str) -> list[list[str] | int]:
        """Words of a text, and the ids of added tokens that stand between them."""
        if self.outside is None or not any(x in text for x in self.added):
            return [self.cut(text)]
        return [self.added[x] if x in self.added else self.cut(x) for x in self.outside.split(text)]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as arrays of little-endian unsigned 32-bit integers."""
        if len(self.known) > self.keep:
            self.known.clear()
        parts = [self._parts(t) for t in texts]
        new: set[str] = set()
        for some in parts:
            for ws in some:
                if ws.__class__ is list:
                    new.update(ws)
        self._learn([w for w in new if w not in self.known])
        get, out = self.known.__getitem__, []
        for some in parts:
            raw = [b"".join(map(get, ws)) if ws.__class__ is list else ws.to_bytes(4, "little") for ws in some]
            out.append(np.frombuffer(raw[0] if len(raw) == 1 else b"".join(raw), dtype="<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Token strings with blanks between, as a file without a decoder asks for."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


_loaded: dict[str, RankBpe] = {}


def _codec(source: str) -> RankBpe:
    key = hashlib.md5(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = RankBpe(source)
    return _loaded[key]


def _slices(texts: list[str], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def vocabulary(path: str) -> str:
    """The vocabulary file's text; some MB, whatever the corpus, so that it may travel with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe(docs: DataFrame, path: str, *, ids: bool = False, round_trip: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes the whole text of every row; null counts as empty and gives no ids.

    Returns the kept columns (by place, so that their names may clash with nothing), n_tokens, ids_sha256,
    decoded_sha256 (if round_trip), ids (if asked for, little-endian unsigned 32-bit integers). Rows are independent: repeated rows give repeated results.
    """
    small_batches(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = "struct<n_tokens bigint, ids_sha256 string" + ", decoded_sha256 string" * round_trip + ", ids binary" * ids + ">"

    @F.pandas_udf(kind)
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(source.value)
        for batch in batches:
            texts, rows = ["" if t is None else t for t in batch], []
            for lo, hi in _slices(texts):
                for got in codec.encode_batch(texts[lo:hi]):
                    row = [len(got), hashlib.sha256(got.tobytes()).hexdigest()]
                    row += [hashlib.sha256(codec.decode(got).encode()).hexdigest()] * round_trip
                    rows.append(row + [got.tobytes()] * ids)
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", *["decoded_sha256"] * round_trip, *["ids"] * ids])
        codec.known.clear()  # a worker may serve other jobs next

    out: Column = run(F.col("text"))
    return docs.select(*keep, out.alias(MADE)).select(*keep, f"{MADE}.*")


def op8(spark, sf_dir: str) -> DataFrame:
    """Query: digests of ids and of the decoded text of every document."""
    import public_tokenizers

    from veriloom.llm.common import table

    return bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

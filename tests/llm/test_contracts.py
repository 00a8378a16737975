"""The registered queries against what their contracts say, row by row."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from veriloom.llm.rank_bpe import check_settings


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def rows(spark, data, docs, name):
    got = __spark_entry__.queries()[name](spark, data).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    return got


def test_op4(spark, data, docs):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in docs.items()}
    by = {}
    for i, r in docs.items():
        by[r["source"]] = by.get(r["source"], 0) + size[i]
    got = rows(spark, data, docs, "op4_cube_mixing")
    taken, again = {}, {(r["doc_id"], r["taken"]) for r in rows(spark, data, docs, "op4_cube_mixing")}
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[s] and 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    target = {docs[r["doc_id"]]["source"]: r["target"] for r in got}
    assert abs(sum(target.values()) - sum(by.values())) < 1e-6 * sum(by.values()) or all(abs(target[s] - 3 * by[s]) < 1e-6 for s in by)
    assert all(abs(taken[s] - target[s]) <= max(size[i] for i in docs if docs[i]["source"] == s) for s in by)


def test_op5(spark, data, docs):
    name = r"(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else f"{c}?" for c in w) for w in ("password", "passwd", "secret", "token", "api_key")) + ")"
    for r in rows(spark, data, docs, "op5_secret_scan"):
        t = docs[r["doc_id"]]["text"] or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 8]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")]


def test_op7(spark, data, docs):
    for r in rows(spark, data, docs, "op7_media_shards"):
        raw = (docs[r["doc_id"]]["text"] or "").encode()
        full = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(full))
        assert r["payload_sha256"] == hashlib.sha256(full).hexdigest() and r["tail_crc32"] == zlib.crc32(full[-16:]) and r["feature"] and len(r["media_sha256"]) == 64


def test_op8(spark, data, docs):
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows(spark, data, docs, "op8_rank_bpe"):
        ids = theirs.encode(docs[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_vocabulary_files_are_refused():
    with pytest.raises(ValueError, match="other settings"):
        check_settings({"model": {"type": "BPE", "end_of_word_suffix": None}, "normalizer": None, "pre_tokenizer": None, "decoder": {"type": "ByteLevel"}})


def test_kept_columns_of_any_name(spark, odd):
    """What an operator names itself clashes with no kept column."""
    import public_tokenizers

    from veriloom.llm.kn_quality import score
    from veriloom.llm.rank_bpe import bpe

    keep = ("doc_id", "made", "row", "kept", "lang", "text2")
    assert bpe(odd, public_tokenizers.path("word_bpe_49k.json"), keep=keep).columns[: len(keep)] == list(keep)
    assert bpe(odd, public_tokenizers.path("word_bpe_49k.json"), keep=keep).count() == odd.count()
    got = score(odd, keep=keep)
    assert got.columns[: len(keep)] == list(keep) and got.count() == odd.count()

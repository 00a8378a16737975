import hashlib
import json
import math
import random
import tarfile
import zlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__

from veriloom.llm.chat_tools import as_messages, call_levels, link_calls, reply_schema
from veriloom.llm.langid_ftrl import UNKNOWN, Ftrl, buckets_for, draw, features, fit, learn, predict, weigh
from veriloom.llm.media_shards import decode, encode, media_columns, payload, read_header


def test_round_trip():
    for t in ("", None, "a", "é" * 96, "x" * 192, "x" * 193, "😀\n" * 5000):
        data = payload(t)
        assert len(data) % 192 == 0 and len(data) >= 192 and decode(encode(data)) == data
        assert read_header(encode(data)[:33])[:2] == (192, len(data) // 192)


def test_shards(odd, none, tmp_path):
    rows = media_columns(odd, f"file://{tmp_path}/media").collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(rows) == odd.count() and media_columns(none).count() == 0
    for r in rows:
        if r["doc_id"] is not None:
            data = payload(texts[r["doc_id"]])
            assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-16:])
        with open(f"{tmp_path}/media/{r['shard']}", "rb") as f:
            f.seek(r["offset"])
            assert hashlib.sha256(f.read(r["media_bytes"])).hexdigest() == r["media_sha256"] == r["digest"]
        with tarfile.open(f"{tmp_path}/media/{r['shard']}") as tar:
            assert f"{r['digest'][:2]}/{r['digest']}.png" in tar.getnames()
    assert len({(r["digest"], r["shard"], r["offset"]) for r in rows}) == len({r["digest"] for r in rows})


def test_language(spark, odd, none):
    random.seed(8)
    parts = {"xx": "ba be bi do du".split(), "yy": "ka ke ti tö üs".split(), "zz": "да не то ми ла".split()}
    rows = [(i, " ".join("".join(random.choice(p) for _ in range(3)) for _ in range(30)), k) for i, (k, p) in enumerate(list(parts.items()) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn(docs.filter("doc_id % 4 <> 2"))
    got = predict(docs.filter("doc_id % 4 = 2").select("doc_id", "text"), model).collect()
    lang = {i: k for i, _, k in rows}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.95 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    out = {r["doc_id"]: r["lang_pred"] for r in predict(odd.select("doc_id", "text"), model).collect()}
    assert out[3] == out[4] == out[5] == UNKNOWN and out[6] != UNKNOWN
    assert learn(none) is None and {r["lang_pred"] for r in predict(odd.select("doc_id", "text"), None).collect()} == {UNKNOWN}


def test_sample_is_bounded_and_of_distinct_texts(spark):
    docs = spark.createDataFrame([("one text of many copies", "en")] * 20_000 + [(f"text number {i} of this language", "en") for i in range(3000)] + [(f"texte {i}", f"l{i % 7}") for i in range(70)], "text string, lang string")
    got = draw(docs.repartition(5), 40).collect()
    per = {}
    for r in got:
        per.setdefault(r["lang"], []).append(r["text"])
    assert len(per) == 8 and len(per["en"]) == len(set(per["en"])) == 40 and all(len(per[f"l{k}"]) == 10 for k in range(7))
    names = spark.createDataFrame([("the lines of a text", "en")] * 2000 + [("un texte en peu de mots", "fr")] * 3, "text string, lang string")
    assert learn(names)["langs"] == ["en", "fr"]


def test_seventy_languages(spark):
    random.seed(12)
    parts = {f"l{k:02d}": [chr(0x4E00 + 40 * k + j) for j in range(12)] for k in range(70)}
    rows = [(i, " ".join("".join(random.choice(p) for _ in range(3)) for _ in range(15)), k) for i, (k, p) in enumerate(list(parts.items()) * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn(docs.filter("doc_id % 8 < 6"))
    lang = {i: k for i, _, k in rows}
    got = predict(docs.filter("doc_id % 8 >= 6").select("doc_id", "text"), model).collect()
    assert len(model["langs"]) == 70 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.95 * len(got)
    assert buckets_for(4) == 1 << 16 and buckets_for(128) == 1 << 15 and buckets_for(1 << 20) == 256


def test_frequencies_over_all_documents(spark):
    texts = ["abc", "ab ab", "xyz", "abc", "1 2", "Ü"]
    model = learn(spark.createDataFrame([(t, "en" if i % 2 else "de") for i, t in enumerate(texts)], "text string, lang string"))
    seen = [set(features(t)[0].tolist()) for t in texts]
    n = sum(bool(x) for x in seen)
    for b in set().union(*seen):
        assert abs(model["idf"][b] - (math.log((1 + n) / (1 + sum(b in x for x in seen))) + 1)) < 1e-5


def test_follow_the_leader_by_hand():
    rng, m = random.Random(3), Ftrl(3, 8)
    z, n = [[0.0] * 3 for _ in range(8)], [[0.0] * 3 for _ in range(8)]
    for _ in range(60):
        at, label = sorted(rng.sample(range(8), 3)), rng.randrange(3)
        x = [rng.random() for _ in at]
        w = [[0.0 if abs(z[f][k]) <= m.l1 else -(z[f][k] - math.copysign(m.l1, z[f][k])) / ((m.beta + math.sqrt(n[f][k])) / m.alpha + m.l2) for k in range(3)] for f in at]
        s = [sum(v * row[k] for v, row in zip(x, w, strict=True)) for k in range(3)]
        p = [math.exp(v) / sum(map(math.exp, s)) for v in s]
        for v, f, row in zip(x, at, w, strict=True):
            for k in range(3):
                g = (p[k] - (k == label)) * v
                z[f][k] += g - (math.sqrt(n[f][k] + g * g) - math.sqrt(n[f][k])) / m.alpha * row[k]
                n[f][k] += g * g
        m.learn(np.array(at), np.array(x), label)
    assert np.allclose(m.z, z) and np.allclose(m.n, n)


def test_temperature_is_the_best_of_the_held_part():
    rows = [(k, np.array([f, 3]), np.array([1, 1])) for i in range(30) for k, f in (("a", 0), ("b", 1))] + [("b", np.array([0, 3]), np.array([1, 1]))] * 10
    idf = np.ones(8)
    w, t = fit(rows, idf, ["a", "b"])
    held = [x for k in ("a", "b") for i, x in enumerate([r for r in rows if r[0] == k]) if i % 5 == 4]

    def loss(t):
        total = 0.0
        for k, at, c in held:
            s = weigh(at, c, idf) @ w[at] / t
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            share = np.full(2, 1 / (len(held) + 2))
            share[int(k == "b")] += len(held) / (len(held) + 2)
            total -= float(share @ np.log(p + 1e-12))
        return total

    assert all(loss(t) <= loss(min(max(t * f, 0.05), 5.0)) + 1e-9 for f in (0.5, 0.8, 1.2, 2.0))


def test_language_query(spark, data, odd):
    rows = __spark_entry__.queries()["op9_langid_ftrl"](spark, data).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)
    assert set(learn(odd)["langs"]) == {"en", "fr"}


SCHEMA = "conv_id long, turn long, calls array<struct<id:string,name:string,arguments:string,after:array<string>>>, result_of string, content string"


def test_linking(spark):
    rows = [
        (1, 0, [("a", "reply", '{"turn": 1, "prompt": "x"}', []), ("b", "reply", '{"prompt": 5}', ["a"])], None, None), (1, 1, [], "b", "done b"), (1, 2, [], "a", "done a"), (1, 3, [], "a", "again"),
        (2, 0, [("p", "reply", '{"turn":1,"prompt":"x"}', ["q"])], None, None), (2, 1, [("q", "reply", '{"turn":1,"prompt":"x"}', [])], None, None),
        (3, 0, [("m", "other", "not json", ["n"]), ("n", "reply", "[1]", ["m"])], None, None), (None, 0, [("a", "reply", None, None)], None, None), (4, 0, [], "zz", "lost"),
    ]
    got = {(r["conv_id"], r["id"]): r for r in link_calls(spark.createDataFrame(rows, SCHEMA), reply_schema(spark)).collect()}
    a, b = got[1, "a"], got[1, "b"]
    assert (a["status"], a["n_results"], a["result_turn"], a["valid"], a["level"]) == ("linked", 2, 2, True, 0)
    assert json.loads(a["json"])["result"] == "done a" and a["json"].startswith('{"after":[],"arguments":{"prompt":"x","turn":1},"id":"a"')
    assert b["errors"] == ["missing:turn", "type:prompt"] and not b["valid"]
    assert (got[2, "q"]["level"], got[2, "p"]["level"], got[2, "p"]["status"]) == (0, 1, "open_call")
    assert got[3, "m"]["level"] == got[3, "n"]["level"] == -1 and got[3, "m"]["errors"] == ["no_schema"] and got[3, "n"]["errors"] == ["not_an_object"]
    assert got[None, "a"]["status"] == "open_call" and got[4, "zz"]["status"] == "lost_result"


def test_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (1, 2, "user", None), (2, 0, "system", "s"), (None, None, None, None), (3, 0, "assistant", "early")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1)).withColumn("calls", F.lit(2))
    got = link_calls(as_messages(turns), reply_schema(spark)).collect()
    assert sorted(r["status"] for r in got) == ["linked", "lost_result", "lost_result", "lost_result", "open_call"]
    assert link_calls(as_messages(turns.limit(0)), reply_schema(spark)).count() == 0


def levels_by_hand(after):
    """Level of each id by repeated passes; -1 where there is none."""
    level, needs = {}, {i: {x for x in a if x in after} for i, a in after.items()}
    while free := [i for i in after if i not in level and all(x in level for x in needs[i])]:
        level |= {i: 1 + max((level[x] for x in needs[i]), default=-1) for i in free}
    return {i: level.get(i, -1) for i in after}


def test_levels_of_any_graph(spark):
    random.seed(21)
    rows, wanted = [], {}
    for conv in range(60):
        ids = [f"c{i}" for i in range(random.randint(1, 14))]
        many = random.choice((1, 1, 2, 3))
        after = {i: random.sample([*ids, "nowhere"], random.randint(0, min(many, len(ids)))) for i in ids} if conv % 3 else {x: random.sample(ids[:k], random.randint(0, min(many, k))) for k, x in enumerate(ids)}
        rows += [(conv, i, a) for i, a in after.items()]
        wanted |= {(conv, i): n for i, n in levels_by_hand(after).items()}
    calls = spark.createDataFrame(rows, "conv_id long, id string, after array<string>")
    got = {(r["conv_id"], r["id"]): r["level"] for r in call_levels(calls).collect()}
    assert got == wanted and -1 in wanted.values() and max(wanted.values()) > 3


def test_a_chain_of_twelve_thousand(spark):
    rows = [(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(12_000)] + [(2, f"r{i}", [f"r{(i + 1) % 500}"]) for i in range(500)]
    got = {(r["conv_id"], r["id"]): r["level"] for r in call_levels(spark.createDataFrame(rows, "conv_id long, id string, after array<string>")).collect()}
    assert all(got[1, f"c{i}"] == i for i in range(12_000)) and all(got[2, f"r{i}"] == -1 for i in range(500))


def test_ladders_and_diamonds(spark):
    rows = [(1, f"c{i}", [f"c{j}" for j in (i - 2, i - 1) if j >= 0]) for i in range(4000)]
    rows += [(2, f"{x}{i}", [f"m{i - 1}"] if i else []) for i in range(300) for x in "ab"] + [(2, f"m{i}", [f"a{i}", f"b{i}", "m0"] if i else ["a0", "b0"]) for i in range(300)]
    rows += [(3, "x", ["y", "leaf"]), (3, "y", ["x", "leaf"]), (3, "leaf", []), (3, "z", ["leaf", "x"])]
    got = {(r["conv_id"], r["id"]): r["level"] for r in call_levels(spark.createDataFrame(rows, "conv_id long, id string, after array<string>")).collect()}
    assert all(got[1, f"c{i}"] == i for i in range(4000)) and all(got[2, f"m{i}"] == 2 * i + 1 for i in range(300))
    assert [got[3, k] for k in ("x", "y", "z", "leaf")] == [-1, -1, -1, 0]


def test_odd_calls(spark):
    long = json.dumps({"prompt": "x" * 300_000, "turn": 1})
    rows = [(1, 0, [("a", "reply", long, ["a"])], None, None), (1, 1, [], "a", "y" * 300_000), (1, 1, [], "a", "y" * 300_000), (2, None, [("b", None, None, [None])], None, None), (3, 0, None, None, None)]
    messages = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(7) for k in ("status", "errors", "json", "level", "name", "fields", "x", "n")})
    got = {(r["conv_id"], r["id"]): r for r in link_calls(messages, reply_schema(spark)).collect()}
    assert len(got) == 2 and got[1, "a"]["level"] == -1 and got[1, "a"]["valid"] and got[1, "a"]["n_results"] == 2 and len(got[1, "a"]["json"]) > 600_000
    assert got[2, "b"]["errors"] == ["no_schema"] and got[2, "b"]["level"] == 0

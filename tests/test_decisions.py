"""Decisions, provenance, features, searches and chains against plain versions."""

import datetime
import json
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.operators import collisions, decisions, features, gates, insights, lookups, messages, provenance, rules, series, similar
from veriloom.sources.shared import shared_dir
from veriloom.streaming import flows


def test_worst_source(spark):
    rng = random.Random(3)
    states = list(provenance.DELTAS)
    assets = [(i, rng.choice(states[1:] if i % 37 else states)) for i in range(300)]
    uses = [(i, rng.randrange(300)) for i in range(0, 200) for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))] + [(i, i + 1) for i in range(200, 299)] + [(299, 250), (5, 9999), (9999, 5), (7, 7)]
    parts = {i: {b for a, b in uses if a == i and b < 300} for i, _ in assets}
    rank = {i: (states.index(s), i) for i, s in assets}
    want = []
    for i, _ in assets:
        seen, todo = {i}, [i]
        while todo:
            for j in parts[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        best = min(rank[j] for j in seen)
        want.append((i, states[best[0]], best[1]))
    got = provenance.worst_source(spark.createDataFrame(assets, "id long, state string"), spark.createDataFrame(uses, "id long, part long"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_manifests(spark):
    def store(**more):
        m = {"signature_info": {"issuer": "Exchange Ltd", "time": "t"}, "assertions": [{"label": "c2pa.actions.v2", "data": {"actions": [{"digitalSourceType": "x/camera"}, {"softwareAgent": "y/trainedAlgorithmicMedia"}]}}], "ingredients": [{}, {}]}
        return json.dumps({"active_manifest": "a", "manifests": {"a": m | more.pop("m", {})}, "validation_status": []} | more)

    rows = [(0, store()), (1, store(validation_status=[{"code": "claim.b"}, {"code": "assertion.a"}, {"code": "info"}])), (2, store(m={"signature_info": {"common_name": "Someone"}})), (3, None), (4, " "), (5, "{"), (6, "{}"), (7, store(active_manifest="none"))]
    got = {r.i: r.p for r in spark.createDataFrame(rows, "i int, m string").select("i", provenance.interpret(F.col("m"), ("exchange",)).alias("p")).collect()}
    assert [got[i].state for i in range(8)] == ["verified_signed", "tampered", "signed_untrusted", "no_credentials", "no_credentials", "unsupported", "unsupported", "signed_untrusted"]
    assert (got[0].delta, got[0].declared, got[0].n_ingredients, got[1].delta, list(got[1].codes), got[2].signer) == (20, "trainedAlgorithmicMedia", 2, -35, ["assertion.a", "claim.b"], "Someone")


def test_links_in_order_of_cost(spark):
    links = [(1, "https://user@evil.example.com/"), (2, "https://news.example.org/x"), (3, "https://shop.site.com/"), (4, "https://bit.ly/a"), (5, "https://bit.ly/b"), (6, "https://bit.ly/c?token=1"), (7, None), (8, "http://plain.com/"), (9, "https://bad.com/"), (10, "https://bit.ly/d")]
    hops = [("https://bit.ly/a", "https://bad.com/x"), ("https://bit.ly/b", "https://fine.com/"), ("https://bit.ly/c?token=1", "https://bad.com/"), ("https://bit.ly/b", "https://zz.com/")]
    rows = decisions.preflight_links(spark.createDataFrame(links, "k int, url string"), "k", "url", spark.createDataFrame([("bad.com",), ("bad.com",)], "host string"), spark.createDataFrame(hops, "url string, final string"))
    got = {r.k: (r.local, r.verdict, r.destination, r.reason) for r in rows.collect()}
    assert got == {
        1: ("dangerous", "dangerous", None, "settled"), 2: ("safe", "safe", None, "settled"), 3: ("safe", "safe", None, "looked_up"), 4: ("unverified", "dangerous", "https://bad.com/x", "followed"), 5: ("unverified", "unverified", "https://fine.com/", "followed"),
        6: ("unverified", "unverified", None, "single_use"), 7: ("safe", "safe", None, "looked_up"), 8: ("unverified", "unverified", None, "looked_up"), 9: ("safe", "dangerous", None, "looked_up"), 10: ("unverified", "unverified", None, "unknown"),
    }


def test_settled_urls_meet_no_join(spark):
    rows = spark.createDataFrame([(1, "https://a.example.org/"), (2, "http://imit-orang.com/"), (3, ""), (4, None), (5, "https://young.com/")], "k int, url string")
    domains = spark.createDataFrame([("young.com", 3, False), ("a.example.org", 1, True), ("imit-orang.com", 900, True)], "host string, age_days int, listed boolean")
    got = {r.k: r for r in decisions.url_trust(rows, "url", domains).collect()}
    assert (got[1].trust_score, got[1].signals) == (95, []) and got[5].signals == ["young"] and got[5].trust_score == 50
    assert {"listed", "plain_http"} <= set(got[2].signals) and got[3].trust_score == got[4].trust_score == 50 and got[2].risk_level in ("HIGH", "CRITICAL")
    plan = decisions.url_trust(rows, "url", domains)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Union") < plan.index("Join")


def test_collisions(spark):
    rng = random.Random(8)
    day = datetime.datetime(2024, 1, 1)
    rows = [(rng.randrange(30), rng.choice(["own", "x", "y", "z"]), day + datetime.timedelta(days=rng.random() * 300)) for _ in range(160)] + [(50, "x", day), (50, "y", day), (51, "x", day), (51, "x", day)]
    owners = [(n, "own") for n in range(60)]
    got = collisions.detect(spark.createDataFrame(rows, "number long, handle string, ts timestamp"), spark.createDataFrame(owners, "number long, handle string"), 5)
    want = {a[0] for a in rows for b in rows if a[0] == b[0] and "own" not in (a[1], b[1]) and a[1] != b[1] and abs(a[2] - b[2]) <= datetime.timedelta(days=5)}
    assert {r.number for r in got.collect()} == want and 50 in want and 51 not in want
    register = spark.range(100).select("id", (F.col("id") % 3).alias("s"))
    drawn = collisions.draw(register, "id", "s", 7)
    assert {r.s: r["count"] for r in drawn.groupBy("s").count().collect()} == {0: 7, 1: 7, 2: 7} and drawn.exceptAll(collisions.draw(register.repartition(5), "id", "s", 7)).count() == 0


def test_entity_ties_are_those_of_all_pairs(spark):
    rng = random.Random(12)
    day = datetime.datetime(2024, 1, 1)
    seen = []
    for obs in range(120):
        ts = day + datetime.timedelta(days=rng.random() * 200)
        seen += [(obs, ts, rng.choice("uv"), str(rng.randrange(7))) for _ in range(rng.choice([1, 2, 3, 4]))]
    df = spark.createDataFrame(seen, "obs long, ts timestamp, type string, value string")
    whole = {r.id: r.component for r in similar.connected(lookups.shared_entities(df.distinct(), 6, 2).select("a", "b")).collect()}
    assert {r.obs: r.campaign for r in insights.campaigns(df, 6).collect()} == whole and len(set(whole.values())) > 3


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(similar, "BLOCK", 40)
    monkeypatch.setattr(similar, "CELLS", 8)
    x = np.concatenate([rng.normal(size=(150, 6)), 5 * np.eye(6)[rng.integers(0, 6, 150)] + 0.1 * rng.normal(size=(150, 6))])
    x[20:25] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 6), (901, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = similar.nearest(df, df.filter("vec_id % 9 = 0"), 4)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = []
    for q in range(0, 300, 9):
        ranked = sorted((-round(float(u[q] @ u[j]), 5), j) for j in range(300) if j != q)[:4]
        want += [(q, j, pytest.approx(-s, abs=2e-5), n + 1) for n, (s, j) in enumerate(ranked)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want, key=lambda w: w[:2])
    assert similar.nearest(df.limit(0), df, 3).count() == 0


def test_out_of_fold_sees_no_group(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(g), float(y), float(y + 0.3 * rng.normal()), float(rng.normal())) for i in range(400) for g, y in [(rng.integers(0, 40), rng.integers(0, 2))]]
    df = spark.createDataFrame(rows, "id int, g int, y double, a double, b double")
    out = features.out_of_fold(df, ["a", "b"], "y", F.col("g"), 4)
    assert out.count() == 400 and out.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    m = features.pooled(out, "y").first()
    assert m.n == 400 and m.mcc > 0.7 and m.average_precision > 0.9
    same = features.out_of_fold(df.withColumn("y", F.lit(1.0)), ["a", "b"], "y", F.col("g"), 3)
    assert {r.p for r in same.select("p").collect()} == {1.0}


def test_features_of_odd_pages(spark):
    html = """<html><!-- <a href="http://x.com"> --><body><a href="#">a</a><a href='https://other.com/'>b</a><a href="/in">c</a><script>var s = "<a href=''>";</script>
      <form action="https://steal.net/x"><input type=PASSWORD><input></form><iframe style="display:none"></iframe><div/><img src="https://cdn.net/a"><img src="/b"><meta http-equiv="Refresh"></body></html>"""
    rows = [(1, "http://www.xn--paytm.co.in/a?x=1&y=2", html), (2, "", ""), (3, None, None), (4, "http://10.0.0.1:8080/p.php#f", "pay me@upi guaranteed returns")]
    got = {r.k: r for r in features.extract(spark.createDataFrame(rows, "k int, url string, html string")).collect()}
    r = got[1]
    assert (r.empty_links_ratio, r.external_link_ratio, r.suspicious_form_action, r.hidden_iframe_count, r.password_field_count, r.input_field_count, r.meta_refresh_present, r.external_resource_ratio) == (0.3333, 0.3333, 1, 1, 1, 2, 1, 0.5)
    assert (r.param_count, r.has_punycode, r.brand_token_count, r.tld_len, r.dom_nesting_depth) == (2, 1, 1, 2, 3)
    assert got[3].url_length == 0 and got[2].host_entropy == 0 and (got[4].has_ip, got[4].domain_len, got[4].upi_id_present, got[4].guaranteed_return_claim_present) == (1, 0, 1, 1)
    a = {r.k: r for r in features.with_artefacts(spark.createDataFrame(rows, "k int, url string, html string")).collect()}
    assert (a[4].has_port, a[4].has_fragment, a[4].path_has_ext, a[1].n_params, a[1].has_www, a[2].url_len) == (1, 1, 1, 2, 1, 0)


def test_spaced_calls_and_strides(spark):
    rng = random.Random(5)
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "b", None]), base + datetime.timedelta(seconds=rng.randrange(3000))) for i in range(500)] + [(900, "a", None)]
    got = {r.id: r.allowed for r in insights.spaced(spark.createDataFrame(rows, "id int, k string, ts timestamp"), "k", "ts", 37).collect()}
    for key in ("a", "b"):
        last = None
        for t in sorted({r[2] for r in rows if r[1] == key and r[2]}):
            ok = last is None or t >= last + datetime.timedelta(seconds=37)
            last = t if ok else last
            assert {got[r[0]] for r in rows if r[1] == key and r[2] == t} == {ok}
    assert not got[900] and len(got) == 501 and not any(got[r[0]] for r in rows if r[1] is None)
    numbers = series.numbered(spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")), "v")
    assert [(r.v, r._i) for r in numbers.orderBy("v").collect()] == [(i, i) for i in range(1000)]


def test_market_of_several_events(spark):
    rng = np.random.default_rng(9)
    day = datetime.date(2024, 1, 1)
    bars = [(t, day + datetime.timedelta(days=int(d)), float(rng.uniform(90, 110)), float(rng.uniform(1e3, 2e3))) for t in "ab" for d in range(0, 60, 1 if t == "a" else 2)]
    events = [("a", day + datetime.timedelta(days=d)) for d in (3, 10, 30, 31, 59, 90)] + [("b", day + datetime.timedelta(days=41)), ("c", day)]
    got = {(r.ticker, r.at): (r.n_base, r.volume_z, r.return_z) for r in series.market_scores(spark.createDataFrame(bars, "ticker string, day date, close double, volume double"), spark.createDataFrame(events, "ticker string, day date")).collect()}
    want = {}
    for t, at in events:
        own = [(b[1], b[3], b[2] / p[2] - 1 if p else None) for p, b in zip([None, *[x for x in bars if x[0] == t]], [x for x in bars if x[0] == t])]
        win = [b for b in own if abs((b[0] - at).days) <= 2]
        before = [b for b in own if (at - b[0]).days > 2][-20:]
        if len(before) >= 5 and win:
            v, r = np.array([b[1] for b in before]), np.array([b[2] for b in before if b[2] is not None])
            want[t, at] = (len(before), round((max(b[1] for b in win) - v.mean()) / v.std(ddof=1), 2), round(max(abs(b[2]) for b in win) / r.std(ddof=1), 2))
    assert got == {k: (v[0], pytest.approx(v[1], abs=0.011), pytest.approx(v[2], abs=0.011)) for k, v in want.items()} and len(want) == 5


def test_masks_and_claims(spark):
    long = "call +49 170 1234567 or a.b@c.de, " * 30_000
    got = {r.doc_id: r for r in rules.mask(spark.createDataFrame([(1, "mail x@y.zz from 10.0.0.1"), (2, None), (3, long)], "doc_id long, text string")).collect()}
    assert got[1].masked == "mail [EMAIL] from [IP]" and got[2].masked == "" and got[3].masked == "call [PHONE] or [EMAIL], " * 30_000
    lines = spark.createDataFrame([(1, "not a claim, but a claim\nno claim"), (2, "never\nclaim")], "doc_id long, text string")
    assert {(r.doc_id, r.line) for r in gates.blocked_claims(lines, "claim", 8).collect()} == {(1, 0), (2, 1)}


def test_gateway_takes_an_id_once(spark):
    top = f"{shared_dir(spark)}/g-{uuid.uuid4().hex}"
    kind = "message_id string, sender string, subject string, body string"
    for part in ([("1", "a", "s", "pay upi://x"), ("2", "a", "s", "hello"), ("2", "a", "s", "hello")], [("2", "b", "s", "again"), ("3", "a", None, "x")], [("3", "c", "s", "y")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{top}/in")
        stream = spark.readStream.schema(kind).parquet(f"{top}/in")
        flows.gateway(stream, f"{top}/rows", f"{top}/state", flows.simple_verdict).awaitTermination()
    rows = spark.read.parquet(f"{top}/rows")
    assert sorted((r.message_id, r.sender) for r in rows.collect()) == [("1", "a"), ("2", "a"), ("3", "a")]


def test_messages(spark):
    asks = ["Never share your OTP with anyone. Bye", "please share the OTP", "we will never ask. Pay a processing fee", "hello", None]
    assert [r.a for r in spark.createDataFrame([(i, t) for i, t in enumerate(asks)], "i int, t string").orderBy("i").select(messages.solicits_value(F.col("t")).alias("a")).collect()] == [False, True, True, False, False]
    assert spark.range(1).select(messages.solicits_value(F.lit("hi"), F.lit(True)).alias("a")).first().a
    register = spark.createDataFrame([("Alpha Capital Ltd", None, None, "R1"), ("Alpha Capital", "a.example", "x@a", None), ("Beta Alpha Capital One", None, "c", None), ("Zed", "z", None, None)], "name string, domains string, contact string, reg_no string")
    claims = spark.createDataFrame([(1, "ALPHA capital pvt ltd"), (2, "alpha capital one"), (3, "nobody"), (4, None), (5, "ed")], "k int, n string")
    got = {r.k: (r.name, r.by) for r in messages.official_contact(claims, "k", "n", register).collect()}
    assert got == {1: ("Alpha Capital", "exact"), 2: ("Beta Alpha Capital One", "within"), 5: ("Zed", "within")}
    feeds = [("urlhaus_url", '{"listed":true}'), ("phishtank", '{"is_phish":false}'), ("virustotal", '{"score":0.2}'), ("virustotal", "{"), ("ipqualityscore", '{"malware":true}'), ("new", '{"listed":true}'), (None, None)]
    assert [r.a for r in spark.createDataFrame([(i, *f) for i, f in enumerate(feeds)], "i int, f string, a string").orderBy("i").select(messages.feed_flagged(F.col("f"), F.col("a")).alias("a")).collect()] == [True, False, True, False, True, False, False]

"""Operators on small cases of their own."""

import random
import re
from email.message import EmailMessage

import pandas as pd
import pyspark.sql.functions as F
import pytest

from veriloom.functions import checks, entities, markup, text, urls
from veriloom.operators import lookups, registers, rollups, rules, scoring, similar
from veriloom.sources import readers
from veriloom.streaming import flows


def one(spark, expr, **columns):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return df.select(expr.alias("x")).first()["x"]


def test_normalisation(spark):
    assert one(spark, text.for_matching(F.col("t")), t="Ｐаy​  now ") == "pay now"
    assert one(spark, text.company_name(F.col("t")), t="Foo & Sons Pvt Ltd India") == "foo and sons"
    assert one(spark, text.domain(F.col("t")), t="https://u:p@WWW.Example.com:80/a?b#c") == "example.com"
    assert one(spark, text.identity_host(F.col("t")), t="nsеindia。com") == "nsеindia.com"  # not folded
    assert one(spark, text.resemblance_host(F.col("t")), t="nsеíndia。com") == "nseindia.com"


def test_public_suffixes(spark):
    cases = {"a.b.co.uk": "b.co.uk", "y.ck": None, "x.y.ck": "x.y.ck", "a.x.y.ck": "x.y.ck", "www.ck": "www.ck", "z.www.ck": "www.ck", "com": None}
    for host, domain in cases.items():
        assert one(spark, urls.site(F.col("h"))["domain"], h=host) == domain, host
    assert one(spark, urls.numeric_ipv4(F.col("h")), h="0x7f000001") == "127.0.0.1"
    assert one(spark, urls.should_resolve(F.col("u")), u="http://2130706433/") == "private"


def test_entities(spark):
    assert one(spark, entities.handles(F.col("t")), t="pay a.b@okbank not x@mail.example.com or me@gmail") == ["a.b@okbank"]
    assert one(spark, checks.valid_isin(F.col("t")), t="US0378331005") is True
    assert one(spark, checks.valid_isin(F.col("t")), t="US0378331006") is False


def test_mask_prefers_the_earliest_then_the_longest(spark):
    df = spark.createDataFrame([(1, "call +91 98765 43210 or 4111111111111111, a.b@c.example"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["masked"] for r in rules.mask(df).collect()}
    assert got == {1: "call [PHONE] or [CARD], [EMAIL]", 2: "", 3: ""}


def test_rules(spark):
    df = spark.createDataFrame([(1, "please send the deposit fee now"), (2, "never send the deposit fee"), (3, "the fee will be paid to you"), (4, None)], "doc_id long, text string")
    pack = [rules.Rule("fee", "fee", "deposit|paid", "FROM_USER", ("never",), 60, True, 4), rules.Rule("bad", "((")]
    assert [(r["doc_id"], r["rule"]) for r in rules.evaluate(df, pack).collect()] == [(1, "fee")]


def test_ladder_order(spark):
    m = spark.createDataFrame([(1, True, True, 0), (2, True, False, 0), (3, False, False, 3), (4, True, False, 0), (5, True, False, 9)], "msg_id long, asks boolean, tampered boolean, passes int")
    r = spark.createDataFrame([(1, "C", "x", 5, True), (2, "C", "x", 5, True), (4, "C", "y", 3, False), (4, "C", "z", 4, False)], "msg_id long, check string, code string, severity int, disqualifying boolean")
    got = {x["msg_id"]: x["verdict"] for x in scoring.ladder(r, m).collect()}
    assert got == {1: "TAMPERED", 2: "FRAUDULENT", 3: "GENUINE", 4: "UNVERIFIED", 5: "GENUINE"}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["id"]: r["component"] for r in similar.connected(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and got[501] == 500


def test_similar_pairs_against_all_pairs(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta gamma", "alpha beta gamma delta", "zeta eta", "zeta eta theta", "alpha beta gamma"])], "id long, text string")
    w = similar.tfidf(docs, "id", "text")
    rows = {}
    for r in w.collect():
        rows.setdefault(r["id"], {})[r["token"]] = r["weight"]
    wanted = {(a, b) for a in rows for b in rows if a < b and sum(rows[a][k] * rows[b].get(k, 0) for k in rows[a]) >= 0.6}
    assert {(r["a"], r["b"]) for r in similar.similar_pairs(w, "id", 0.6).collect()} == wanted


def test_lookalikes(spark):
    known = spark.createDataFrame([("paytown", 0), ("example", 1)], "name string, ord int")
    hosts = spark.createDataFrame([(1, "paytovvn"), (2, "exampel"), (3, "example"), (4, "unrelated")], "id long, label string")
    assert {r["id"]: r["name"] for r in lookups.lookalikes(hosts, "id", "label", known).collect()} == {1: "paytown", 2: "example"}


def test_messages_and_pages(spark):
    m = EmailMessage()
    m["From"], m["Subject"], m["Reply-To"] = "A B <A@Mail.example>", "Hi", "c@d.example"
    m.set_content("hello")
    m.add_attachment(b"%PDF", maintype="application", subtype="pdf", filename="a.pdf")
    df = spark.createDataFrame([(bytearray(m.as_bytes()),), (None,)], "raw binary").select(markup.message(F.col("raw")).alias("m")).select("m.*").collect()
    assert (df[0]["from_address"], df[0]["reply_to"], df[0]["text"].strip(), df[0]["attachments"][0]["name"]) == ("a@mail.example", "c@d.example", "hello", "a.pdf")
    html = spark.createDataFrame([('<p>x<div style="display:none"><a href="h">t</a></div><a href="v">u</a><br>',), (None,)], "h string").select(markup.page(F.col("h")).alias("p")).collect()
    assert [(x["href"], x["hidden"]) for x in html[0]["p"]["links"]] == [("h", True), ("v", False)] and html[1]["p"]["n_links"] == 0


def test_readers(spark, tmp_path):
    (tmp_path / "hosts.txt").write_text("# c\n0.0.0.0 bad.example\n||ads.example^\n@@ok.example\nwww.plain.example\n127.0.0.1 localhost\n")
    assert {r["host"] for r in readers.blocklist(spark, str(tmp_path / "hosts.txt"), "l").collect()} == {"bad.example", "ads.example", "plain.example"}
    (tmp_path / "pack.csv").write_text('id,entity,action,direction,suppressors,window,requires_ask,severity\nr1,fee,pay,,never|||not,50,true,4\n,x,,,,,,\n')
    pack = rules.read_pack(spark, str(tmp_path / "pack.csv"))
    assert [(r.id, r.suppressors, r.window, r.requires_ask) for r in pack] == [("r1", ("never", "not"), 50, True)]


def test_insert_and_update(spark):
    old = spark.createDataFrame([("a", 1), ("", 2)], "url string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 3), ("b", 4), ("", 5)], "url string, v int")
    assert sorted(map(tuple, rollups.insert_new(old, new, "url").collect())) == [("", 2), ("", 5), ("a", 1), ("b", 3)]
    assert sorted(map(tuple, rollups.update(old, new.filter("url = 'a'"), "url", ["v"]).collect())) == [("", 2), ("a", 9)]


def test_gateway_judges_each_message_once(spark, tmp_path):
    for i, rows in enumerate(([("m1", "s", "hi", "send money"), ("m2", "s", None, "hello")], [("m1", "s", "hi", "send money"), ("m3", "s", "x", None)])):
        spark.createDataFrame(rows, "message_id string, sender string, subject string, body string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        flows.gateway(flows.file_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "state"), flows.simple_verdict).awaitTermination()
    got = {r["message_id"]: (r["verdict"], r["subject"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["m1"] == ("FRAUDULENT", "[FRAUD] hi") and len(got) == 3 == spark.read.parquet(str(tmp_path / "out")).count()


def test_rate_limit_counts_accepted_rows_only(spark, tmp_path):
    rows = [(1, "a", f"2024-01-01 00:00:{s:02d}") for s in (0, 10, 20, 30)] + [(1, "a", "2024-01-01 00:01:05")]
    spark.createDataFrame(rows, "user_id long, k string, t string").select("user_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = flows.run_to_table(flows.rate_limited(flows.file_stream(spark, str(tmp_path / "in")), "user_id", "ts", 2))
    assert [r["accepted"] for r in got.orderBy("ts").collect()] == [True, True, False, False, True]


def test_resolve_against_all_pairs(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abdeilnorst") for _ in range(rnd.randint(4, 10)))
    tails = ["industries", "finance", "industries india", "capital and finance", ""]
    register = ["reliance industries", "bajaj", *(f"{word()} {rnd.choice(tails)}".strip() for _ in range(250))]
    names = ["relianse industries", "industries", "bajai", "reliancee"]
    for x in rnd.sample(register, 50):
        y = list(x)
        for _ in range(rnd.randint(1, 3)):
            y[rnd.randrange(len(y))] = rnd.choice(["", "x", "ab", "e"])
        z = "".join(y).split()
        rnd.shuffle(z)
        names.append(" ".join(z + [word()] * rnd.randint(0, 1)))
    wanted = {}
    for i, x in enumerate(names):
        score = lookups.set_ratio.func(pd.Series([x] * len(register)), pd.Series(register))
        near = [(100.0 if x == y else s, y) for s, y in zip(score, register) if s >= 85 and (s >= 92 or set(x.split()) & set(y.split()))]
        if near:
            wanted[i] = max(near)[::-1]
    got = lookups.resolve(spark.createDataFrame(list(enumerate(names)), "k int, n string"), "k", "n", spark.createDataFrame([(x, x) for x in register], "registered string, normalised string")).collect()
    assert {r["k"]: (r["registered"], r["score"]) for r in got} == wanted and wanted[0][0] == "reliance industries" and len(wanted) > 10


@pytest.mark.parametrize("slots", [8, 1 << 20])
def test_names_meet_no_shuffled_words(spark, monkeypatch, slots):
    """Against brute force, with full slots too; few names are broadcast, so that no text's words are shuffled."""
    monkeypatch.setattr(lookups, "SLOTS", slots)
    docs = [(1, "Acme & Sons of the North, ACME"), (2, "the sons, of"), (3, None), (3, "of\nthe north bank and of the"), (4, ""), (5, "a1#b of-the-north bank and trust company x")]
    names = [("A", "acme"), ("S", "acme sons"), ("O", "of the"), ("O", "of"), ("N", "of the north"), ("B", "of the north bank and trust"), ("C", "of the north bank and trust company"), ("E", ""), ("U", "Acme"), ("D", "the  sons"), ("H", "a1#b")]
    got = lookups.names_in_text(spark.createDataFrame(docs, "k int, t string"), "k", "t", spark.createDataFrame(names, "name string, normalised string"))
    spaced = [(k, f" {' '.join(re.findall('[a-z0-9#]+', (t or '').lower()))} ") for k, t in docs]
    assert {tuple(r) for r in got.collect()} == {(k, n) for k, t in spaced for n, x in names if 0 < len(x.split()) <= 6 and f" {x} " in t}
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_entity_in_message_shuffles_no_words(spark):
    rows = spark.createDataFrame([(1, "", "pay acme bank of x now", "x.example"), (2, "Desk - Team", "acme bank", "x.example"), (3, "", "nothing", "X.example"), (4, "", "bank", "y")], "k int, display string, body string, domain string")
    names = spark.createDataFrame([("Acme Bank", "acme bank"), ("Acme Bank of X", "acme bank of x")], "name string, normalised string")
    got = registers.entity_in_message(rows, "k", F.col("display"), "body", "domain", names, spark.createDataFrame([("x.example", "X")], "domain string, entity string"))
    assert sorted(map(tuple, got.collect())) == [(1, "Acme Bank of X", "text"), (2, "Desk", "display"), (3, "X", "domain"), (4, None, None)]
    assert not re.search(r"Exchange hashpartitioning\(gram", got._jdf.queryExecution().executedPlan().toString())


def test_full_ratios_are_settled_before_the_others(spark, monkeypatch):
    """Names within one another need no look-up of all that may be alike; the result is that of all pairs."""
    register = [*(f"supplier {i}" for i in range(60)), "north", "a b c", "c b a d", "a  b"]
    names = [*(f"supplier {i} india" for i in range(0, 60, 7)), "b a", "d c a b x", "supplier", "north star", "supplierr 3x", "zz"]
    asked, looked = [], lookups.candidates
    monkeypatch.setattr(lookups, "candidates", lambda rows, *a: (asked.append({r["n"] for r in rows.collect()}), looked(rows, *a))[1])
    got = lookups.resolve(spark.createDataFrame(list(enumerate(names)), "k int, n string"), "k", "n", spark.createDataFrame([(x, x) for x in register], "registered string, normalised string")).collect()
    wanted = {}
    for i, x in enumerate(names):
        score = lookups.set_ratio.func(pd.Series([x] * len(register)), pd.Series(register))
        near = [(s, y) for s, y in zip(score, register) if s >= 85 and (s >= 92 or set(x.split()) & set(y.split()))]
        if near:
            wanted[i] = max(near)[::-1]
    assert {r["k"]: (r["registered"], r["score"]) for r in got} == wanted and asked == [{"supplierr 3x", "zz"}]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_shared_entities_in_tiles(spark, monkeypatch, kind):
    """Pairs counted in tiles, over several batches of one entity, are those of all pairs."""
    rnd = random.Random(4)
    rows = {(rnd.randrange(40), rnd.randrange(60), rnd.choice("xy"), str(rnd.randrange(2))) for _ in range(700)}
    want = {}
    for o, t, k, v in rows:
        for p, u, m, w in rows:
            if (k, v) == (m, w) and o < p and abs(t - u) <= 3 * 24:
                want[o, p] = want.get((o, p), 0) + 1
    name = (lambda o: f"o{o:02d}") if kind == "string" else (lambda o: o)
    df = spark.createDataFrame([(name(o), t * 3600, k, v) for o, t, k, v in rows], f"obs {kind}, s long, type string, value string")
    df = df.select("obs", F.timestamp_seconds("s").alias("ts"), "type", "value")
    monkeypatch.setattr(lookups, "BLOCKS", 3)
    monkeypatch.setattr(lookups, "AT_ONCE", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = lookups.shared_entities(df, 3, 5)
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
        assert {(r["a"], r["b"]): r["shared"] for r in got.collect()} == {(name(o), name(p)): n for (o, p), n in want.items() if n >= 5}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

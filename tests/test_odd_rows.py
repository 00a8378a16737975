"""Queries against their SQL on odd rows of their own."""

from email import message_from_bytes, policy
from email.utils import getaddresses, parseaddr

import duckdb
import pytest

from veriloom.functions import markup
from veriloom.plans.registry import ORACLES, QUERIES


@pytest.fixture
def rows_of(spark, tmp_path):
    """The rows of a query and those of its SQL over a table of given rows."""

    def both(name: str, table: str, rows: list[tuple], schema: str):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        want = con.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        order = lambda found: sorted(found, key=repr)
        return order(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*columns).collect())), order(want.fetchall())

    return both


TEXTS = ["token = zz near deadbeef", "never share token = 'deadbeef1", 'TOKEN = "0123abcd', "to\u212aen = 0123abcd", "!! a!!", "!! A1!!", "1 !! \u212a\u0130!! 2", "!! \u017f!!", "!! \u0131!!", "LICENSE", "l\u0130cense", "licen\u017fe", "l\u0131cense", None, ""]


@pytest.mark.parametrize("name", ["a36_rule_counts", "r01_rules", "r02_compile"])
def test_rules_hit_what_their_sql_hits(rows_of, name):
    got, want = rows_of(name, "documents", [(i // 2, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    assert got == want


HOSTS = ["example.org", "a.example.org", "example.org.evil.test", "examp.le.org", "examp1e.org", "www.spam-farm.example.com", "m-x.test", "spam.test", "x.m", "-m.test", "", None]


def test_official_match_cuts_labels_as_its_sql(rows_of):
    got, want = rows_of("j28_official_match", "pages", [(i, h and f"https://{h}/en/") for i, h in enumerate(HOSTS)], "page_id long, url string")
    assert got == want


def test_status_ids_of_many_customers(rows_of):
    got, want = rows_of("u31_status_url", "customer", [(k,) for k in (0, 1, 14_999, 399_999, 899_999, 1_160_000)], "c_custkey long")
    assert got == want


def test_headers_are_parsed_once():
    """Plain headers go to the standard parser only where it could give something else, and repeated ones once."""
    markup._known.cache_clear()
    for i in range(300):
        got = markup._message(f"From: Some One <U{i}@Mail.example>\nSubject: Re: no {i}\nContent-Type: text/plain\n\nhello".encode())
        assert got[:3] == (f"Re: no {i}", "Some One", f"u{i}@mail.example") and got[8] == "hello"
    assert markup._known.cache_info().misses == 1
    for head in ("=?utf-8?B?w6k=?= x", "a  b\tc", '"Q, R" <q@R.s>', "a..b@c", "A <.a@b>, c@d", "x\n y", "é <a@b>", "<A@b.C>", "A B <A+b_c@d-e.F>", ""):
        m = message_from_bytes(f"From: {head}\nSubject: {head}\nReturn-Path: {head}\nReply-To: {head}\n\nx".encode(), policy=policy.default)
        name, address = parseaddr(str(m["From"]))
        got = markup._message(f"From: {head}\nSubject: {head}\nReturn-Path: {head}\nReply-To: {head}\n\nx".encode())
        assert got[:5] == (str(m["Subject"]), name or None, address.lower() or None, getaddresses([str(m["Reply-To"])])[0][1].lower() or None, str(m["Return-Path"]))

"""E-mail messages and HTML pages, read by the standard parsers over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from email import message_from_bytes, policy
from email.utils import getaddresses, parseaddr
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|opacity\s*:\s*0(?![.\d])", re.I)
BREAKS = re.compile(r"<(?:br|/p|/div|/tr|/li|/h[1-6])\b[^>]*>", re.I)


class _Page(HTMLParser):
    """Links with their text and whether an ancestor hides them, counts of elements, and the visible text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.links, self.text, self.open = [], [], None
        self.counts = dict.fromkeys(("a", "form", "iframe", "script", "input", "img"), 0)
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.counts:
            self.counts[tag] += 1
        hidden = (self.stack[-1][1] if self.stack else False) or "hidden" in a or bool(HIDDEN.search(a.get("style") or ""))
        if tag == "a":
            self.open = {"href": a.get("href") or "", "text": "", "hidden": hidden}
            self.links.append(self.open)
        if tag not in VOID:
            self.stack.append((tag, hidden))
            self.depth = max(self.depth, len(self.stack))

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        inside = {t for t, _ in self.stack}
        if not inside & {"script", "style"} and not (self.stack and self.stack[-1][1]):
            self.text.append(data)
        if self.open is not None:
            self.open["text"] += data


def page(html: Column) -> Column:
    """links, visible text, counts of links, forms, frames, scripts, inputs and images, and the depth of a page."""

    @F.pandas_udf("struct<links array<struct<href string, text string, hidden boolean>>, text string, n_links int, n_forms int, n_iframes int, n_scripts int, n_inputs int, n_images int, depth int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["links", "text", "n_links", "n_forms", "n_iframes", "n_scripts", "n_inputs", "n_images", "depth"]
        for batch in batches:
            rows = []
            for t in batch:
                p = _Page()
                p.feed(t or "")
                p.close()
                rows.append((p.links, " ".join(" ".join(p.text).split()), *[p.counts[k] for k in ("a", "form", "iframe", "script", "input", "img")], p.depth))
            yield pd.DataFrame(rows, columns=names)

    return run(html)


def plain_text(html: Column) -> Column:
    """Text of HTML by expressions alone: scripts and styles out, block ends become line ends, tags go."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/tr|/li|/h[1-6])\b[^>]*>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), r"[ \t]+", " "))


MESSAGE = "struct<subject string, from_name string, from_address string, reply_to string, return_path string, message_id string, date string, auth string, text string, html string, attachments array<struct<name string, type string, bytes int>>>"


@lru_cache(1 << 12)
def _known(name: str, value: str):
    return policy.default.header_factory(name, value)


def _parsed(name: str, value: str):
    """A header read by the standard parser; short ones that are met again are not read again."""
    return _known(name, value) if len(value) < 200 else policy.default.header_factory(name, value)


READ = policy.EmailPolicy(header_factory=_parsed)
#: Headers without structure, and the form in which these and a sender are what the parser would give.
FREE, PLAIN = ("subject", "return-path", "authentication-results"), re.compile(r"[!-~]+(?: [!-~]+)*")
SENDER = re.compile(r"([A-Za-z0-9]+(?: [A-Za-z0-9]+)*) <([A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")


def _message(b: bytes) -> tuple:
    m = message_from_bytes(b, policy=READ)
    first = {}
    for name, value in m.raw_items():
        first.setdefault(name.lower(), value)

    def head(k: str) -> str | None:
        v = first.get(k)
        if v is None or (k in FREE and "=?" not in v and PLAIN.fullmatch(v)):
            return v
        return str(m[k])

    sender = SENDER.fullmatch(first.get("from") or "")
    name, address = sender.groups() if sender else parseaddr(head("from") or "")
    reply = getaddresses([head("reply-to")]) if "reply-to" in first else []
    text, html, files = [], [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        body, kind = part.get_payload(decode=True) or b"", part.get_content_type()
        if file := part.get_filename():
            files.append({"name": file, "type": kind, "bytes": len(body)})
        elif kind in ("text/plain", "text/html"):
            (text if kind == "text/plain" else html).append(body.decode(part.get_content_charset() or "utf-8", "replace"))
    return (head("subject"), name or None, address.lower() or None, (reply[0][1].lower() or None) if reply else None, head("return-path"), head("message-id"), head("date"), head("authentication-results"), "\n".join(text) or None, "\n".join(html) or None, files)


def message(raw: Column) -> Column:
    """Headers, bodies and attachments of raw messages; what can't be read is null."""

    @F.pandas_udf(MESSAGE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0].split("<")[-1] for x in ("subject ", "from_name ", "from_address ", "reply_to ", "return_path ", "message_id ", "date ", "auth ", "text ", "html ", "attachments ")]
        for batch in batches:
            yield pd.DataFrame([_message(bytes(b or b"")) for b in batch], columns=names)

    return run(raw)


def authentication(header: Column) -> Column:
    """First spf, dkim and dmarc results and the signer of an Authentication-Results header."""
    first = lambda k: F.nullif(F.lower(F.regexp_extract(header, rf"(?i)\b{k}\s*=\s*([a-z]+)", 1)), F.lit(""))
    signer = F.coalesce(F.nullif(F.regexp_extract(header, r"(?i)header\.d=([A-Za-z0-9.-]+)", 1), F.lit("")), F.nullif(F.regexp_extract(header, r"(?i)header\.i=[^@\s;]*@([A-Za-z0-9.-]+)", 1), F.lit("")))
    return F.struct(first("spf").alias("spf"), first("dkim").alias("dkim"), first("dmarc").alias("dmarc"), F.lower(signer).alias("signer"))


def kind_of(data: Column, name: Column) -> Column:
    """EMAIL, PDF, IMAGE, URL or TEXT by first bytes, then file name, then header lines."""
    head = F.decode(F.substring(data, 1, 512), "ISO-8859-1")
    ends = lambda *xs: F.lower(F.coalesce(name, F.lit(""))).rlike(r"\.(" + "|".join(xs) + ")$")
    return (
        F.when(head.startswith("%PDF"), "PDF").when(head.rlike(r"^(\x89PNG|\xFF\xD8\xFF|GIF8)"), "IMAGE")
        .when(ends("pdf"), "PDF").when(ends("png", "jpe?g", "gif", "webp"), "IMAGE").when(ends("eml", "msg"), "EMAIL")
        .when(head.rlike(r"(?im)^(from|received|return-path|message-id):"), "EMAIL").when(F.trim(head).rlike(r"^https?://\S+$"), "URL").otherwise("TEXT")
    )


def chat_header(c: Column) -> Column:
    """Sender and time of a chat line `[time, date] sender: body`; day before month, two-digit years from 2000."""
    p = r"^\[(\d{1,2}):(\d{2})(?::\d{2})?\s*([AaPp][Mm])?,\s*(\d{1,2})/(\d{1,2})/(\d{2,4})\]\s*([^:]+):\s?(.*)$"
    g = lambda i: F.regexp_extract(c, p, i)
    n = lambda i: g(i).try_cast("int")
    hour = F.when(F.lower(g(3)) == "pm", n(1) % 12 + 12).when(F.lower(g(3)) == "am", n(1) % 12).otherwise(n(1))
    year = F.when(n(6) < 100, n(6) + 2000).otherwise(n(6))
    at = F.concat_ws(" ", F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(g(5), 2, "0"), F.lpad(g(4), 2, "0")), F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), F.lpad(g(2), 2, "0"), F.lit("00")))
    return F.when(g(7) != "", F.struct(F.trim(g(7)).alias("sender"), at.alias("sent_at"), g(8).alias("body")))

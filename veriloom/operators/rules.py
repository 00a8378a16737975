"""Declarative rules: compiled once on the driver, evaluated over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that tell to whom or from whom something goes.
TO_USER = r"\b(?:will be (?:credited|paid|sent) to you|you will receive)\b"
FROM_USER = r"\b(?:send|pay|transfer|deposit|share)\b"
ASKING = r"\?|\b(?:please|kindly|click|call|send|pay)\b"


@dataclass
class Rule:
    """One row of a rule pack; a rule whose patterns don't compile is off, one without action weighs 1 at most."""

    id: str
    entity: str
    action: str | None = None
    direction: str | None = None
    suppressors: tuple[str, ...] = ()
    window: int = 120
    requires_ask: bool = False
    severity: int = 3
    compiled: tuple = field(default=(), compare=False)

    def compile(self) -> Rule | None:
        try:
            on = lambda p: re.compile(p, re.IGNORECASE)
            self.compiled = (on(self.entity), on(self.action) if self.action else None, [on(s) for s in self.suppressors])
        except re.error:
            return None
        self.severity = self.severity if self.action else min(self.severity, 1)
        return self


def first_hit(rule: Rule, text: str, asking: bool) -> tuple[int, int, str] | None:
    """Start, end and reason of a rule's first hit; a place where something speaks against it is passed over."""
    entity, action, suppressors = rule.compiled
    for m in entity.finditer(text):
        around = text[max(0, m.start() - rule.window) : m.end() + rule.window]
        if any(s.search(around) for s in suppressors) or (action and not action.search(around)):
            continue
        to, frm = re.search(TO_USER, around, re.I), re.search(FROM_USER, around, re.I)
        if (rule.direction == "FROM_USER" and to and not frm) or (rule.direction == "TO_USER" and frm and not to):
            continue
        if not rule.requires_ask or asking:
            return m.start(), m.end(), m[0]
    return None


def evaluate(docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each rule that hits a text: key, rule, severity, start, end, matched."""
    live = [r for r in (x.compile() for x in rules) if r]

    @F.pandas_udf("array<struct<rule string, severity int, start int, end int, matched string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch:
                t = t or ""
                asking = re.search(ASKING, t, re.I) is not None
                found = [(r, first_hit(r, t, asking)) for r in live]
                out.append([{"rule": r.id, "severity": r.severity, "start": h[0], "end": h[1], "matched": h[2]} for r, h in found if h])
            yield pd.Series(out, dtype=object)

    return docs.select(key, F.explode(run(F.col(text))).alias("h")).select(key, "h.*")


def read_pack(spark, path: str) -> list[Rule]:
    """Rules of a CSV pack with a header; a few rows, so that they may live on the driver."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').collect()
    blank = lambda v: v if v and v.strip() else None
    return [Rule(r["id"], r["entity"], blank(r["action"]), blank(r["direction"]), tuple(s for s in (r["suppressors"] or "").split("|||") if s), int(r["window"] or 120), (r["requires_ask"] or "").lower() == "true", int(r["severity"] or 3)) for r in rows if blank(r["id"]) and blank(r["entity"])]


#: Kinds of identifiers that are masked, in the order in which they are looked for.
IDENTIFIERS = (("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("IP", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"), ("CARD", r"\b[0-9]{13,19}\b"), ("PHONE", r"\+\d[\d ()-]{8,}\d"), ("NUMBER", r"\b[0-9]{6,}\b"))


def mask(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, masked text and spans: identifiers give way to their kind in brackets; of spans that overlap the
    earliest stays, then the longest; a null text masks as an empty one."""
    compiled = [(k, re.compile(p)) for k, p in IDENTIFIERS]

    def one(t: str) -> dict:
        spans, out, at = [], [], 0
        for start, back, kind in sorted((m.start(), -m.end(), k) for k, p in compiled for m in p.finditer(t)):
            if start >= at:
                spans.append({"start": start, "end": -back, "kind": kind})
                out += [t[at:start], f"[{kind}]"]
                at = -back
        return {"masked": "".join([*out, t[at:]]), "spans": spans}

    @F.pandas_udf("struct<masked string, spans array<struct<start int, end int, kind string>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(t or "") for t in batch], columns=["masked", "spans"])

    return docs.select(key, run(F.col(text)).alias("m")).select(key, "m.*")

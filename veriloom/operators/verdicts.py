"""From findings to verdicts: what a finding weighs, when evidence speaks against it, and how sure the result is.

Findings are rows of msg_id, check, code, severity; checks rows of msg_id, check, passed (null: not determined).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.operators.scoring import GATES, choose, clamp

# Order of preflight and of chat codes, factors of the manipulation score, caps of single lanes.
CHAT_ORDER = ("W6_CAMPAIGN_LINKED", "W5_IDENTITY_MISMATCH", "W4_UNSAFE_APP_OFFER", "W4_PAYMENT_SOLICITATION", "W3_TYPOLOGY_MATCH", "W2_UNVERIFIED_ADVISORY", "W1_UNSOLICITED_CONTEXT", "W0_NO_SIGNALS")
UNSOLICITED = ("unsolicited_add", "sender_not_in_contacts", "group_name_securities_funnel_pattern", "skewed_poster_ratio")
CONCENTRATION = ((4, 15), (3, 10), (2, 5))
EVIDENCE_OF_VALUE = ("MONEY", "DELIVERY")


def findings(messages: DataFrame, key: str, text: str, pack: list[tuple[str, str, int, str]]) -> DataFrame:
    """A row for each pattern of a pack (check, code, severity, pattern) that a text holds."""
    hits = [F.when(F.col(text).rlike(p), F.struct(F.lit(c).alias("check"), F.lit(k).alias("code"), F.lit(s).alias("severity"))) for c, k, s, p in pack]
    return messages.select(key, F.explode(F.array_compact(F.array(*hits))).alias("f")).select(key, "f.*")


def classified(found: DataFrame, disqualifying: list[str], mechanisms: list[str]) -> DataFrame:
    """Findings with kind: disqualifying (a listed code, or a mechanism of severity 4 or more), weak (severity 3 or
    more), note; and mechanism, whether it shows a way to lose something."""
    way = F.col("check").isin(*mechanisms)
    out = F.col("code").isin(*disqualifying) | (way & (F.col("severity") >= 4))
    return found.withColumns({"kind": F.when(out, "disqualifying").when(F.col("severity") >= 3, "weak").otherwise("note"), "mechanism": way | F.col("code").isin(*disqualifying)})


def counted(messages: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Each message with what was found: n_out, n_weak, n5, n4 and whether there is a mechanism."""
    n = found.groupBy(key).agg(F.count_if(F.col("kind") == "disqualifying").alias("n_out"), F.count_if(F.col("kind") == "weak").alias("n_weak"), F.count_if(F.col("severity") >= 5).alias("n5"), F.count_if(F.col("severity") == 4).alias("n4"), F.max("mechanism").alias("mechanism"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_out", "n_weak", "n5", "n4")}
    return messages.join(n, key, "left").withColumns({**zero, "mechanism": F.coalesce("mechanism", F.lit(False))})


def sureness(verdict: Column, n5: Column, n4: Column, mechanism: Column, read_well: Column, evidence: Column) -> Column:
    """Confidence in a verdict: fraud by the strength of findings, tampering by how well it was read, else evidence."""
    fraud = F.least(F.lit(100), 55 + 15 * F.least(n5, F.lit(2)) + 5 * F.least(n4, F.lit(2)) + F.when(mechanism, 15).otherwise(0))
    return F.when(verdict == "FRAUDULENT", fraud).when(verdict == "TAMPERED", F.when(read_well, 90).otherwise(70)).otherwise(evidence).cast("int")


def countervailed(verdict: Column, takes_value: Column, known_domains: Column, pays: Column, sender_fails: Column) -> Column:
    """FRAUDULENT becomes UNVERIFIED where nothing of value is asked, all domains are known and the sender holds."""
    return F.when((verdict == "FRAUDULENT") & ~takes_value & known_domains & ~pays & ~sender_fails, "UNVERIFIED").otherwise(verdict)


def gate(verdict: Column, confidence: Column) -> Column:
    """Verdicts below their least confidence are UNVERIFIED."""
    return F.when(confidence < choose(verdict, GATES, 0), "UNVERIFIED").otherwise(verdict)


def judged(messages: DataFrame, key: str, found: DataFrame, checks: list[str], disqualifying: list[str], mechanisms: list[str], n_checks: Column | None = None) -> DataFrame:
    """The whole ladder for messages with asks, known_domains and sender_fails: verdict, confidence and counts.

    A check passes where it has no finding of severity 3 or more; evidence is the share of checks that pass, in
    percent. Order: disqualifying findings; no ask; two weak findings; more passes than weak findings. Then what speaks
    against fraud, fraud without a mechanism, and the gate.
    """
    rows, n_checks = classified(found, disqualifying, mechanisms), F.lit(len(checks)) if n_checks is None else n_checks
    failed = rows.filter("severity >= 3").groupBy(key).agg(F.count_distinct("check").alias("failed"), F.max((F.col("check") == "MONEY") & (F.col("severity") >= 4)).alias("pays"), F.max(F.col("check").isin(*EVIDENCE_OF_VALUE)).alias("value"))
    m = counted(messages, key, rows).join(failed, key, "left").withColumns({"passes": n_checks - F.coalesce("failed", F.lit(0)), "pays": F.coalesce("pays", F.lit(False)), "value": F.coalesce("value", F.lit(False))})
    raw = F.when(F.col("n_out") > 0, "FRAUDULENT").when(~F.col("asks"), F.when(F.col("passes") >= 2, "GENUINE").otherwise("UNVERIFIED")).when(F.col("n_weak") >= 2, "FRAUDULENT").when(F.col("passes") > F.col("n_weak"), "GENUINE").otherwise("UNVERIFIED")
    m = m.withColumn("raw", raw).withColumn("held", countervailed(F.col("raw"), F.col("value"), F.col("known_domains"), F.col("pays"), F.col("sender_fails")))
    m = m.withColumn("held", F.when((F.col("held") == "FRAUDULENT") & ~F.col("mechanism"), "UNVERIFIED").otherwise(F.col("held")))
    m = m.withColumn("confidence", sureness(F.col("held"), F.col("n5"), F.col("n4"), F.col("mechanism"), F.lit(True), F.floor(F.col("passes") * 100 / n_checks + 0.5)))
    return m.select(key, "raw", gate(F.col("held"), F.col("confidence")).alias("verdict"), "confidence", F.col("n_out").cast("int").alias("n_out"), F.col("n_weak").cast("int").alias("n_weak"), F.col("passes").cast("int").alias("passes"))


def without_each(messages: DataFrame, key: str, found: DataFrame, checks: list[str], disqualifying: list[str], mechanisms: list[str]) -> DataFrame:
    """Ablation: verdict counts with one check disabled at a time (and with none), off, verdict, n."""
    every = F.explode(F.array(*[F.lit(c) for c in ("", *checks)])).alias("off")
    case = F.struct("off", key).alias("case")
    asked = messages.select("*", every).withColumn("case", case)
    left = found.select("*", every).filter("`check` <> off").withColumn("case", case)
    n = F.when(F.col("case.off") == "", len(checks)).otherwise(len(checks) - 1)
    return judged(asked, "case", left, checks, disqualifying, mechanisms, n).groupBy(F.col("case.off").alias("off"), "verdict").agg(F.count(F.lit(1)).alias("n"))


def sender_state(dmarc: Column, free_mail: Column, mapped: Column, claims: Column, claim_fits: Column) -> Column:
    """What authentication and the domain map say together: code and severity.

    mapped: the domain is in the map; claims: the message names an entity; claim_fits: the map gives that entity.
    """
    said = lambda code, severity: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    return (
        F.when(dmarc == "fail", said("DMARC_FAIL", 5)).when(dmarc.isNull(), said("NO_AUTHENTICATION_RESULTS", 1)).when(free_mail, said("INSTITUTIONAL_CLAIM_FROM_FREEMAIL", 4))
        .when((dmarc == "pass") & mapped & claims & ~claim_fits, said("ENTITY_DOMAIN_MISMATCH", 4)).when((dmarc == "pass") & mapped, said("AUTHENTICATED_RECOGNISED", 0))
        .when(dmarc == "pass", said("AUTHENTICATED_UNRECOGNISED", 3)).otherwise(said("AUTHENTICATION_INCONCLUSIVE", 2))
    )


def header_anomalies(site, sender: Column, reply_to: Column, return_path: Column, display: Column) -> Column:
    """Codes of headers that name another site than the sender's; site maps a domain to its registrable part."""
    shown = F.transform(F.regexp_extract_all(F.lower(display), F.lit(r"\b([a-z0-9-]+\.(?:com|in|co\.in|org|net))\b"), 1), lambda d: site(d))
    cases = [("REPLY_TO_MISMATCH", F.coalesce(site(reply_to) != site(sender), F.lit(False))), ("RETURN_PATH_MISMATCH", F.coalesce(site(return_path) != site(sender), F.lit(False))), ("DISPLAY_NAME_DOMAIN_MISMATCH", F.coalesce(F.exists(shown, lambda d: d != site(sender)), F.lit(False)))]
    return F.array_compact(F.array(*[F.when(test, code) for code, test in cases]))


def short_circuit(kind: Column, forwarded: Column, dkim: Column, dmarc: Column, aligned: Column, authority: Column, solicits: Column) -> Column:
    """Whether a message needs no further check: mail, sent directly, signed and aligned, by an authority, asking nothing."""
    return F.coalesce((kind == "EMAIL") & ~forwarded & (F.lower(dkim) == "pass") & (dmarc == "pass") & aligned & authority.isNotNull() & ~solicits, F.lit(False))


def chat_code(outgoing: Column, shared: Column, registration: Column, payment: Column, app: Column, typologies: Column, dated: Column, disclosure: Column, signals: Column) -> Column:
    """Codes of a chat message, gravest first; a message of one's own is never scored."""
    no_number = (registration == "absent") & (dated.isNull() | (dated >= disclosure))
    unsolicited = F.size(F.array_intersect(signals, F.array(*map(F.lit, UNSOLICITED)))) >= 2
    tests = (shared >= 2, registration == "collision", app, payment, typologies > 0, no_number | (registration == "unverified"), unsolicited)
    fired = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), code) for code, t in zip(CHAT_ORDER, tests, strict=False)]))
    return F.when(outgoing | (F.size(fired) == 0), F.array(F.lit(CHAT_ORDER[-1]))).otherwise(fired)


def origin_score(matched: Column, imitates: Column, issuer_known: Column, issuer_fits: Column, signed: Column) -> Column:
    """Distrust of a source, 0 to 1: half for an unknown one, by what the register and a signature say. signed is null without a document."""
    start = F.when(matched, 0.0).when(imitates, 0.95).otherwise(0.5)
    claimed = F.when(issuer_known & ~issuer_fits, F.greatest(start, F.lit(0.9))).otherwise(start)
    return clamp(F.when(signed.isNull(), claimed).when(signed, F.least(claimed, F.lit(0.1))).otherwise(F.greatest(claimed, F.lit(0.7))), 0.0, 1.0)


def polarity(label: Column, confidence: Column, bad: str = "phishing") -> Column:
    """Score of a two-class answer: the confidence if it is the bad class, what is left of it otherwise."""
    return F.round(F.when(F.lower(label) == bad, confidence).otherwise(1 - confidence), 6)


def fake_probability(classes: Column) -> Column:
    """Probability of FAKE of an array of name and confidence, else what REAL leaves; null without both."""
    of = lambda name: F.try_element_at(F.filter(classes, lambda c: F.upper(c["name"]) == name), F.lit(1))["confidence"]
    return F.coalesce(of("FAKE"), 1 - of("REAL"))


def manipulation_signals(c: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Signs of manipulation: how many patterns of each group a text holds, capitals beyond a fifth and exclamations."""
    hits = {g: sum((c.rlike(p).cast("int") for p in ps), F.lit(0)) for g, ps in groups.items()}
    capitals = F.when(F.length(c) > 100, (F.length(c) - F.length(F.regexp_replace(c, r"\p{Lu}", ""))) / F.length(c)).otherwise(0.0)
    marks = F.length(c) - F.length(F.replace(c, F.lit("!"), F.lit("")))
    signs = [F.when(n > 0, F.concat(F.lit(f"{g}:"), F.least(n, F.lit(2)).cast("string"))) for g, n in hits.items()]
    signs += [F.when(capitals > 0.3, "capitals:2").when(capitals > 0.2, "capitals:1"), F.when(marks >= 5, "exclamations:2").when(marks >= 3, "exclamations:1")]
    return F.array_compact(F.array(*signs))


def manipulation_score(c: Column, pack: list[tuple[str, str, bool, int]]) -> Column:
    """Score and number of the patterns (pattern, category, high, weight) that a text holds: weights, 5 for each high
    one, and more the more categories there are."""
    hit = F.array_compact(F.array(*[F.when(c.rlike(p), F.struct(F.lit(k).alias("category"), F.lit(w + 5 * h).alias("weight"))) for p, k, h, w in pack]))
    kinds = F.size(F.array_distinct(F.transform(hit, lambda x: x.category)))
    bonus = F.lit(0)
    for least, more in reversed(CONCENTRATION):
        bonus = F.when(kinds >= least, more).otherwise(bonus)
    total = F.aggregate(hit, F.lit(0), lambda n, x: n + x.weight)
    return F.struct(F.least(F.lit(100), total + bonus).alias("score"), F.size(hit).alias("patterns"))


def typologies(c: Column, pack: list[tuple[str, int, str, tuple[str, ...]]]) -> Column:
    """Matched typologies (id, weight, pattern, keywords), the heaviest first, by pattern or else by keyword, and the penalty of all."""
    low = F.lower(c)

    def one(name: str, weight: int, pattern: str, words: tuple[str, ...]) -> Column:
        word = F.lit(False)
        for w in words:
            word = word | low.contains(w)
        how = F.when(c.rlike(pattern), "pattern").when(word, "keyword")
        return F.when(how.isNotNull(), F.struct(F.lit(-weight).alias("rank"), F.lit(name).alias("id"), how.alias("how")))

    found = F.array_sort(F.array_compact(F.array(*[one(*t) for t in pack])))
    return F.struct(F.transform(found, lambda x: F.concat(x["id"], F.lit(":"), x["how"])).alias("matched"), F.aggregate(found, F.lit(0), lambda n, x: n - x["rank"]).alias("penalty"))


def merged_layers(l0: Column, l1: Column, l2: Column, alone: Column, cap: int = 35) -> Column:
    """Score of three layers: the keyword layer (capped where it stands alone), raised by a blocklist hit, settled by a
    model's answer where there is one; with level. Null layers don't count."""
    base = F.when(alone & l1.isNull(), F.least(l0, F.lit(cap))).otherwise(l0) + F.coalesce(l1, F.lit(0))
    score = clamp(F.when(l2.isNull(), base).otherwise(F.floor((base + 2 * l2) / 3 + 0.5)), 0, 100).cast("int")
    return F.struct(score.alias("score"), F.when(score >= 75, "scam").when(score >= 45, "suspicious").otherwise("safe").alias("level"))


def signal_kind(label: Column, protective: str, context: str, high: str, medium: str) -> Column:
    """Polarity and severity of a signal's label by ordered patterns, lane tag aside."""
    bare = F.regexp_replace(label, r"(?i)^\s*\[[a-z_]+\]\s*", "")
    said = lambda p, s: F.struct(F.lit(p).alias("polarity"), F.lit(s).alias("severity"))
    return F.when(bare.rlike(protective), said("protective", "none")).when(bare.rlike(context), said("context", "none")).when(bare.rlike(high), said("risk", "high")).when(bare.rlike(medium), said("risk", "medium")).otherwise(said("risk", "low"))


def partitioned(signals: Column) -> Column:
    """Labels of an array of label, polarity, severity: risks by severity, then protective ones, then context."""
    rank = lambda s: F.when(s.severity == "high", 0).when(s.severity == "medium", 1).when(s.severity == "low", 2).otherwise(3)
    numbered = F.transform(signals, lambda s, i: F.struct(rank(s).alias("rank"), i.alias("place"), s["label"].alias("label"), s["polarity"].alias("polarity")))
    of = lambda p: F.transform(F.array_sort(F.filter(numbered, lambda s: s["polarity"] == p)), lambda s: s["label"])
    return F.struct(of("risk").alias("risk"), of("protective").alias("protective"), of("context").alias("context"))


def distinct_first(items: Column, most: int = 5) -> Column:
    """The first so many of an array of texts, those that differ in case only counted once."""
    low = F.transform(items, lambda x: F.lower(x))
    return F.transform(F.slice(F.array_distinct(low), 1, most), lambda d: F.element_at(items, F.array_position(low, d).cast("int")))


def summary_line(verdict: Column, confidence: Column, reason: Column) -> Column:
    """One sentence that says the verdict as firmly as the confidence allows."""
    how = F.when(confidence >= 85, "clearly").when(confidence >= 70, "probably").otherwise("possibly")
    return F.when(verdict == "UNVERIFIED", F.lit("not enough to judge")).otherwise(F.concat_ws(" ", how, F.lower(verdict), F.concat(F.lit("("), reason, F.lit(")"))))


def preview(disqualifying: Column, weak: Column, asks: Column) -> Column:
    """The short form of the ladder that runs beside a text field: stop, caution or ok."""
    return F.when((disqualifying >= 1) | ((weak >= 2) & asks), "stop").when(weak >= 1, "caution").otherwise("ok")


def signed_state(body: Column, mac: Column, key: str, digest, revoked: Column) -> Column:
    """State of a signed contract: valid, tampered (the digest under the key differs), revoked or unsigned."""
    return F.when(mac.isNull(), "unsigned").when(digest(body, key.encode()) != mac, "tampered").when(revoked, "revoked").otherwise("valid")

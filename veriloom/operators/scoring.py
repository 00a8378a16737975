"""Scores, ladders and verdicts: sums of weighted flags, then one ordered choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.operators.gates import count_of, weighted

# Weights of signals, band edges, weights of checks, strength of match tiers, gates and orders.
FUSION = {"text": 0.25, "voice": 0.20, "video": 0.20, "source": 0.15, "coordination": 0.10, "market": 0.10}
BANDS = ((0.80, "Critical"), (0.60, "High"), (0.30, "Medium"))
CHECKS = {"MONEY": 1.5, "FILINGS": 1.5, "ENTITY": 1.2, "EMAIL_AUTH": 1.2, "DELIVERY": 1.0, "CLAIM": 1.0}
TIERS = {"EXACT": 1.0, "VISUAL": 0.9, "STRUCTURED": 0.85, "SEMANTIC": 0.75}
GATES = {"FRAUDULENT": 70, "TAMPERED": 65, "GENUINE": 60}
STATES = ("collision", "invalid", "absent", "weak_match", "unverified", "not_applicable", "valid")
DELTAS = {"valid": 25, "not_applicable": 0, "unverified": 0, "weak_match": -10, "absent": -20, "invalid": -40, "collision": -45}
BEHAVIOUR_BANDS = ((80, "severe", 65), (60, "strong", 50), (40, "moderate", 35), (20, "weak", 15), (0, "none", 10))
PREFLIGHT = ("L5", "L4", "L3", "L2", "L1", "L0")


def choose(value: Column, options: dict, default) -> Column:
    out = F.lit(default)
    for k, v in options.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def band(score: Column, edges=BANDS, default: str = "Low") -> Column:
    out = F.lit(default)
    for edge, name in sorted(edges):
        out = F.when(score >= edge, name).otherwise(out)
    return out


def fuse(signals: DataFrame) -> DataFrame:
    """Verdict of each content from rows of content_id, name, score, available: unavailable signals leave both sums.

    A signed match in the register (name `registry`, score 1) holds the score under 0.3. driver is the signal with
    the greatest weighted score (ties: the first in the order of the weights).
    """
    w = choose(F.col("name"), FUSION, 0.0)
    live = F.col("available") & (w > 0)
    total = F.sum(F.when(live, w))
    mean = F.coalesce(F.try_divide(F.sum(F.when(live, w * F.col("score"))), total), F.lit(0.0))
    signed = F.max((F.col("name") == "registry") & F.col("available") & (F.col("score") >= 1))
    place = choose(F.col("name"), {n: i for i, n in enumerate(FUSION)}, len(FUSION))
    driver = F.min_by(F.when(live, F.col("name")), F.when(live, F.struct((-w * F.col("score")).alias("s"), place.alias("place"))))
    got = signals.groupBy("content_id").agg(mean.alias("mean"), signed.alias("signed"), driver.alias("driver"), F.count_if(live).alias("n_live"))
    score = F.round(clamp(F.when(F.col("signed"), F.least("mean", F.lit(0.29))).otherwise(F.col("mean")), 0.0, 1.0), 4)
    return got.select("content_id", score.alias("score"), band(score).alias("band"), "driver", "n_live")


def confidence(checks: DataFrame) -> DataFrame:
    """Evidence of each message from rows of msg_id, check, passed (null: not determined), confidence, in percent."""
    w = choose(F.col("check"), CHECKS, 0.0)
    earned = F.when(F.col("passed").isNotNull(), w * F.greatest("confidence", F.lit(0.35))).otherwise(0.0)
    return checks.groupBy("msg_id").agg(F.floor(100 * F.try_divide(F.sum(earned), F.sum(w)) + 0.5).cast("int").alias("evidence"))


def ladder(reasons: DataFrame, messages: DataFrame) -> DataFrame:
    """Verdict of each message.

    reasons has msg_id, check, code, severity, disqualifying; messages msg_id, asks, tampered, passes (number of
    passed checks). Order: tampered; any disqualifying reason; no ask; two weak reasons; more passes than weak
    reasons; else unverified. Messages without reasons stay.
    """
    weak = (F.col("severity") >= 3) & ~F.col("disqualifying")
    flags = reasons.groupBy("msg_id").agg(F.max("disqualifying").alias("out"), F.count_if(weak).alias("weak"), F.count_if(F.col("severity") == 5).alias("n5"), F.count_if(F.col("severity") == 4).alias("n4"), F.count(F.lit(1)).alias("n"))
    m = messages.join(flags, "msg_id", "left").withColumns({"out": F.coalesce("out", F.lit(False)), **{c: F.coalesce(c, F.lit(0)) for c in ("weak", "n5", "n4", "n")}})
    verdict = (
        F.when(F.col("tampered"), "TAMPERED").when(F.col("out"), "FRAUDULENT")
        .when(~F.col("asks"), F.when(F.col("passes") >= 2, "GENUINE").otherwise("UNVERIFIED"))
        .when(F.col("weak") >= 2, "FRAUDULENT").when(F.col("passes") > F.col("weak"), "GENUINE").otherwise("UNVERIFIED")
    )
    m = m.withColumn("raw", verdict)
    sure = F.when(F.col("raw") == "FRAUDULENT", F.least(F.lit(100), 55 + 15 * F.least("n5", F.lit(2)) + 5 * F.least("n4", F.lit(2)) + F.when(F.col("out"), 15).otherwise(0))).when(F.col("raw") == "TAMPERED", 90).otherwise(F.lit(40) + 10 * F.least("passes", F.lit(5)))
    m = m.withColumn("confidence", sure.cast("int"))
    return m.select("msg_id", F.when(F.col("confidence") < choose(F.col("raw"), GATES, 0), "UNVERIFIED").otherwise(F.col("raw")).alias("verdict"), "confidence", F.col("n").cast("int").alias("n_reasons"))


def behaviour(c: Column, tactics: dict[str, tuple[int, tuple]], combos: dict[str, tuple[tuple, int]], half_up: bool = False) -> Column:
    """Sum of the tactics' weights and of the combinations that hold in full, with band and penalty (halves to the even
    number, or up, as the client rounds)."""
    t = F.lower(c)
    hit = {k: count_of(t, words) > 0 for k, (_, words) in tactics.items()}
    total = F.lit(0)
    for k, (w, _) in tactics.items():
        total += F.when(hit[k], w).otherwise(0)
    for need, bonus in combos.values():
        both = F.lit(True)
        for k in need:
            both = both & hit[k]
        total += F.when(both, bonus).otherwise(0)
    score = F.least(total, F.lit(100))
    cap, name = F.lit(0), F.lit("")
    for edge, label, most in reversed(BEHAVIOUR_BANDS):
        cap, name = F.when(score >= edge, most).otherwise(cap), F.when(score >= edge, label).otherwise(name)
    return F.struct(score.alias("score"), name.alias("band"), F.least(cap, (F.round if half_up else F.bround)(score * 0.65).cast("int")).alias("penalty"))


def keyword_score(c: Column, weights: dict[str, int], edges=((75, "DANGER"), (45, "WARN"), (25, "CAUTION"))) -> Column:
    score = F.least(weighted(F.lower(c), weights), F.lit(100))
    return F.struct(score.alias("score"), band(score, edges, "SAFE").alias("level"))


def credibility(c: Column, tier: Column) -> Column:
    """60, plus the source's tier, less 8 a sign of manipulation, plus up to 15 by the share of lines with a figure."""
    signs = (F.regexp_count(c, F.lit("!{2,}")) > 0).cast("int") + (c.rlike("[A-Z]{4,} [A-Z]{4,}")).cast("int") + (F.regexp_count(c, F.lit("!")) > 5).cast("int")
    lines = F.size(F.split(c, "\n"))
    ratio = F.size(F.filter(F.split(c, "\n"), lambda x: x.rlike("[0-9]"))) / lines
    return clamp(F.lit(60) + tier - 8 * signs + (ratio * 15).cast("int"), 0, 100)


def trust_total(risk: Column, credibility_: Column, domain: Column, manipulation: Column, forms: Column) -> Column:
    """Trust from what the engines say; a missing one adds nothing; the sum is cut to a whole number, then clamped."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    total = F.lit(70.0) + z(30 - 0.9 * risk) + z(0.3 * (credibility_ - 60)) + z(0.4 * (domain - 60)) - z(0.3 * manipulation) - 5 * z(forms)
    return clamp(total.cast("int"), 0, 100)


def risk_level(score: Column, edges=((75, "LOW"), (50, "MODERATE"), (25, "HIGH"))) -> Column:
    return band(score, edges, "CRITICAL")


def worst_state(rows: DataFrame, key: str, state: str) -> DataFrame:
    """The worst of the states of each key, by their fixed order, with its change of trust."""
    rank = choose(F.col(state), {s: i for i, s in enumerate(STATES)}, len(STATES))
    got = rows.groupBy(key).agg(F.min_by(state, rank).alias("state"))
    return got.withColumn("delta", choose(F.col("state"), DELTAS, 0))


def prf(tp: Column, fp: Column, fn: Column) -> Column:
    """Precision, recall and F1, each 0 where it has no denominator."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return F.struct(p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    root = F.sqrt(((tp + fp).cast("double")) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.coalesce(F.try_divide(tp.cast("double") * tn - fp.cast("double") * fn, root), F.lit(0.0))


def compare_fields(pairs: DataFrame, key: str, fields: dict[str, int], tolerance: float = 0.005) -> DataFrame:
    """One row for each field stated on both sides of a pair: whether it agrees, and the severity if it doesn't.

    pairs has <field> and filed_<field> for each; what isn't stated is never compared.
    """
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("said"), F.col(f"filed_{f}").cast("double").alias("filed"), F.lit(s).alias("severity")) for f, s in fields.items()])
    rows = pairs.select(key, F.explode(entries).alias("e")).select(key, "e.*").filter("said is not null and filed is not null")
    same = F.abs(F.col("said") - F.col("filed")) <= tolerance
    return rows.select(key, "field", same.alias("agrees"), F.when(same, 0).otherwise(F.col("severity")).alias("severity"))


def preflight(codes: Column) -> Column:
    """The gravest of the codes that fired, by the fixed order; L0 if none."""
    ranks = F.transform(codes, lambda c: F.array_position(F.array(*map(F.lit, PREFLIGHT)), c))
    return F.coalesce(F.element_at(F.array(*map(F.lit, PREFLIGHT)), F.array_min(F.filter(ranks, lambda r: r > 0)).cast("int")), F.lit("L0"))


def capped(score: Column, caps: list[tuple[Column, int]]) -> Column:
    """A score held under the least cap whose condition holds."""
    return F.least(score, *[F.when(test, cap) for test, cap in caps])

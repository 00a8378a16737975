"""Chokepoints: where a message moves money, sends the reader, or says who it is.

Each takes messages and the registers it needs, and gives one row a finding: key, check, code, severity, evidence. All
registers are joined by equality; a miss in a register is no finding of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import checks, entities, text, urls
from veriloom.operators.registers import by_number


def _rows(df: DataFrame, key: str, check: str, code, severity, evidence: Column) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    severity = F.lit(severity) if isinstance(severity, int) else severity
    return df.select(key, F.lit(check).alias("check"), code.alias("code"), severity.cast("int").alias("severity"), evidence.alias("evidence"))


def money(messages: DataFrame, key: str, body: str, claimed: str, handles: DataFrame, banks: DataFrame, investing: Column) -> DataFrame:
    """Findings on how a message would be paid.

    handles has suffix, category, severity: the severity counts in an investing context, 2 otherwise; banks has prefix
    and bank. A branch code whose bank is another than the claimed one is a mismatch; one of no bank is unknown. A
    payment link and account numbers beside a request to pay are findings as well.
    """
    m = messages.withColumn("_investing", investing)
    h = m.select(key, "_investing", F.explode(F.array_distinct(entities.handles(F.col(body)))).alias("_v"))
    h = h.join(handles.select(F.lower("suffix").alias("_s"), "category", "severity"), F.lower(F.substring_index("_v", "@", -1)) == F.col("_s"), "left")
    code = F.when(F.col("category").isNull(), "UPI_UNKNOWN_HANDLE").otherwise(F.concat(F.lit("UPI_"), F.upper("category")))
    out = _rows(h, key, "MONEY", code, F.when(F.col("_investing"), F.coalesce("severity", F.lit(3))).otherwise(2), F.col("_v"))
    b = m.select(key, claimed, F.explode(entities.distinct(F.col(body), entities.IFSC)).alias("_v"))
    b = b.join(banks.select(F.upper("prefix").alias("_p"), "bank"), F.substring("_v", 1, 4) == F.col("_p"), "left")
    same = F.contains(text.company_name(F.col(claimed)), text.company_name(F.col("bank"))) | F.contains(text.company_name(F.col("bank")), text.company_name(F.col(claimed)))
    b = b.filter(F.col("bank").isNull() | (F.col(claimed).isNotNull() & ~same))
    out = out.unionByName(_rows(b, key, "MONEY", F.when(F.col("bank").isNull(), "IFSC_UNKNOWN_BANK").otherwise("IFSC_BANK_MISMATCH"), F.when(F.col("bank").isNull(), 2).otherwise(4), F.col("_v")))
    link = m.filter(F.lower(body).contains("upi://pay"))
    out = out.unionByName(_rows(link, key, "MONEY", "PAYMENT_LINK", F.when(F.col("_investing"), 4).otherwise(3), F.lit("upi://pay")))
    account = m.filter(F.lower(body).rlike(r"\b(?:account|a/c)\b") & F.lower(body).rlike(r"\b(?:transfer|deposit|pay|send)\b")).select(key, "_investing", F.explode(F.array_except(entities.distinct(F.col(body), entities.ACCOUNT), entities.phones(F.col(body)))).alias("_v"))
    return out.unionByName(_rows(account, key, "MONEY", "ACCOUNT_SOLICITATION", F.when(F.col("_investing"), 4).otherwise(3), F.col("_v")))


def delivery(links: DataFrame, key: str, url: str, known: DataFrame, ages: DataFrame, brands: tuple[str, ...], shorteners: tuple[str, ...] = urls.SHORTENERS, young: int = 90) -> DataFrame:
    """Findings on where a message sends the reader, of rows of key and URL.

    known has domain and entity; ages domain and days (no row: age unknown). For each URL: a known domain; a shortener;
    an app file; an encoded host; a name that imitates a brand; a domain younger than `young` days; a risky ending.
    """
    h = urls.host(F.col(url))
    u = links.withColumn("_h", h).withColumn("_d", urls.plain_registrable(F.col("_h"))).filter("_h <> ''")
    u = u.join(known.select(F.col("domain").alias("_k"), "entity"), F.col("_d") == F.col("_k"), "left").join(ages.select(F.col("domain").alias("_a"), "days"), F.col("_d") == F.col("_a"), "left")
    stranger = F.col("entity").isNull()
    tests = [
        ("KNOWN_OFFICIAL_DOMAIN", 0, ~stranger), ("SHORTENED_LINK", 3, stranger & F.col("_d").isin(*shorteners)), ("APK_LINK", 5, F.lower(url).rlike(r"\.apk(\?|#|$)")), ("PUNYCODE_HOST", 4, F.col("_h").rlike(r"(^|\.)xn--")),
        ("LOOKALIKE_DOMAIN", 5, stranger & F.coalesce(urls.typosquat(F.col("_h"), brands) != "", F.lit(False))), ("NEW_DOMAIN", 4, stranger & F.coalesce(F.col("days") < young, F.lit(False))), ("RISKY_ENDING", 3, stranger & (urls.tld_risk(F.col("_h")) == "high")),
    ]
    found = u.select(key, "_d", F.explode(F.array_compact(F.array(*[F.when(t, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for c, s, t in tests]))).alias("f"))
    return _rows(found, key, "DELIVERY", F.col("f.code"), F.col("f.severity"), F.col("_d")).distinct()


def entity(messages: DataFrame, key: str, body: str, claimant: str, register: DataFrame) -> DataFrame:
    """Findings on who a message says it is: registration numbers against the register (number, name, active), company
    and security numbers by their check digits."""
    text_ = F.col(body)
    numbers = messages.select(key, claimant, F.explode(entities.distinct(text_, entities.REGISTRATION)).alias("_v"))
    states = by_number(numbers, "_v", register, "number", "name", "active", claimant)
    severity = F.when(F.col("state") == "collision", 5).when(F.col("state").isin("invalid", "absent"), 4).when(F.col("state") == "weak_match", 2).when(F.col("state") == "unverified", 3).otherwise(0)
    out = _rows(states, key, "ENTITY", F.concat(F.lit("REGISTRATION_"), F.upper("state")), severity, F.col("_v"))
    isin = messages.select(key, F.explode(entities.distinct(text_, entities.ISIN)).alias("_v")).filter(~checks.valid_isin(F.col("_v")) & ~F.col("_v").rlike(f"^(?:{entities.REGISTRATION})$"))
    cin = messages.select(key, F.explode(entities.distinct(text_, entities.CIN)).alias("_v")).filter(~checks.valid_cin(F.col("_v")))
    return out.unionByName(_rows(isin, key, "ENTITY", "ISIN_INVALID", 4, F.col("_v"))).unionByName(_rows(cin, key, "ENTITY", "CIN_INVALID", 4, F.col("_v")))

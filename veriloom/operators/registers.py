"""Registers: who is listed, under which number, name, domain or contact, and what a lookup proves.

Registers are tables; a miss is never a finding by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import checks, text, urls
from veriloom.operators.lookups import by_suffix, longest_name, names_in_text, resolve
from veriloom.operators.rollups import latest
from veriloom.operators.scoring import choose

# Tiers of sources with their change of credibility.
TIERS = {"trusted": 30, "caution": 0, "unreliable": -30}
STRANGER = -10


def by_number(claims: DataFrame, number: str, register: DataFrame, listed: str, name: str, active: str, claimant: str) -> DataFrame:
    """Claims of registration numbers with state: valid, weak_match (the name is contained only), collision (another's
    number), invalid (the shape of no number), absent, unverified (listed but not active). Numbers meet in upper case.
    """
    r = latest(register.select(F.upper(listed).alias("_no"), F.col(name).alias("_name"), F.col(active).alias("_active")), ["_no"], [F.col("_active").desc(), F.col("_name")])
    both = claims.join(r, F.upper(number) == F.col("_no"), "left")
    said, held = text.register_name(F.col(claimant)), text.register_name(F.col("_name"))
    state = (
        F.when(checks.registration_kind(F.upper(number)).isNull(), "invalid").when(F.col("_no").isNull(), "absent").when(~F.col("_active"), "unverified")
        .when(said == held, "valid").when(F.contains(held, said) | F.contains(said, held), "weak_match").otherwise("collision")
    )
    return both.select(*claims.columns, F.col("_name").alias("registered"), state.alias("state"))


def authority(domains: DataFrame, domain: str, listed: DataFrame, restricted: tuple[str, ...]) -> DataFrame:
    """What vouches for a domain: RESTRICTED (a suffix that only vetted bodies get), EXACT, PARENT (longest listed
    suffix), or nothing. listed has host and entity."""
    d = domains.withColumn("_d", text.domain(F.col(domain)))
    closed = F.lit(False)
    for s in restricted:
        closed = closed | F.col("_d").endswith("." + s)
    found = by_suffix(d.select("_d").distinct(), "_d", listed).select(F.col("_d").alias("_k"), "matched", "entity")
    got = d.join(found, F.col("_d") == F.col("_k"), "left")
    how = F.when(closed, "RESTRICTED").when(F.col("matched") == F.col("_d"), "EXACT").when(F.col("matched").isNotNull(), "PARENT")
    return got.select(*domains.columns, how.alias("how"), "matched", "entity")


def aligned(signer: Column, sender: Column) -> Column:
    """Whether a signing domain and a sender's belong to one site; false where either is missing."""
    return F.coalesce((F.coalesce(signer, F.lit("")) != "") & (urls.plain_registrable(signer) == urls.plain_registrable(sender)), F.lit(False))


def source_tier(pages: DataFrame, host: str, listed: DataFrame) -> DataFrame:
    """Tier of each host by suffix: the first tier in which any suffix is listed; strangers are unknown. listed has host, tier."""
    rank = choose(F.col("tier"), {k: i for i, k in enumerate(TIERS)}, len(TIERS))
    parts = pages.select(F.col(host).alias("_h")).distinct().withColumn("_s", F.explode(text.host_suffixes(F.col("_h"))))
    best = parts.join(listed.select(F.col("host").alias("_s"), "tier"), "_s").groupBy("_h").agg(F.min_by("tier", rank).alias("tier"))
    both = pages.join(best, F.col(host) == F.col("_h"), "left").drop("_h")
    return both.withColumns({"tier": F.coalesce("tier", F.lit("unknown")), "change": choose(F.col("tier"), TIERS, STRANGER)})


def trusted_source(rows: DataFrame, key: str, source: str, organisations: DataFrame, edits: int = 2) -> DataFrame:
    """Organisation of each source (URL, address or @handle) and how it matched: handle, email_domain, domain, else lookalike.

    organisations has name, ord, domains, email_domains, handles (arrays); the first organisation in its order wins.
    A look-alike has a listed domain's letter skeleton or is few edits from it.
    """
    raw = F.trim(source)
    s = rows.select(key, raw.alias("_raw"), F.when(raw.startswith("@"), F.lower(F.ltrim(raw, F.lit("@")))).alias("_handle"), F.when(raw.contains("@") & ~raw.contains("://") & ~raw.startswith("@"), F.lower(F.substring_index(raw, "@", -1))).alias("_mail"), text.registry_domain(raw).alias("_domain"))
    kinds = (("handle", "_handle", "handles"), ("email_domain", "_mail", "email_domains"), ("domain", "_domain", "domains"))
    met = None
    for i, (how, column, listed) in enumerate(kinds):
        dim = organisations.select("name", "ord", F.explode(listed).alias("_v")).select("name", "ord", F.lower("_v").alias("_v"))
        got = s.join(dim, F.col(column) == F.col("_v")).select(key, "ord", F.lit(i).alias("rank"), "name", F.lit(how).alias("how"))
        met = got if met is None else met.unionByName(got)
    first = met.groupBy(key).agg(F.min(F.struct("ord", "rank", "name", "how")).alias("m")).select(key, "m.name", "m.how")
    rest = s.join(first.select(key), key, "left_anti").filter("_domain <> ''")
    dim = organisations.select("name", "ord", F.explode("domains").alias("_v"))
    same = rest.join(dim.withColumn("_k", text.registry_skeleton(F.col("_v"))), text.registry_skeleton(F.col("_domain")) == F.col("_k")).filter("_domain <> _v").select(key, "ord", "name")
    # few edits: one of edits + 1 parts of the listed name stands unchanged, near its place
    n = edits + 1
    part = lambda i: F.substring(F.col("_v"), F.floor(F.length("_v") * i / n).cast("int") + 1, F.floor(F.length("_v") * (i + 1) / n).cast("int") - F.floor(F.length("_v") * i / n).cast("int"))
    pieces = dim.select("name", "ord", "_v", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), part(i).alias("part"), F.floor(F.length("_v") * i / n).cast("int").alias("at")) for i in range(n)])).alias("p")).select("name", "ord", "_v", "p.part", "p.at", F.length("p.part").alias("size"))
    shapes = pieces.select("at", "size").distinct()
    probe = rest.select(key, "_domain").join(shapes, F.col("at") <= F.length("_domain") + edits).withColumn("shift", F.explode(F.sequence(F.lit(-edits), F.lit(edits)))).withColumn("part", F.substring(F.col("_domain"), F.col("at") + F.col("shift") + 1, F.col("size"))).filter("at + shift >= 0")
    near = probe.join(pieces, ["at", "size", "part"]).filter((F.levenshtein("_domain", "_v") <= edits) & (F.col("_domain") != F.col("_v"))).select(key, "ord", "name")
    like = same.unionByName(near).groupBy(key).agg(F.min_by("name", "ord").alias("name")).select(key, "name", F.lit("lookalike").alias("how"))
    return rows.join(first.unionByName(like), key, "left").select(*rows.columns, "name", "how")


def organisation_named(rows: DataFrame, key: str, said: str, organisations: DataFrame, least: int = 4) -> DataFrame:
    """The first organisation whose name or short name a text equals, or holds as whole words (names of `least` characters or more)."""
    dim = organisations.select("name", "ord", F.explode(F.array_distinct(F.filter(F.array(F.lower("name"), F.lower("short_name")), lambda x: x.isNotNull() & (x != "")))).alias("_v"))
    equal = rows.join(dim, F.lower(F.trim(said)) == F.col("_v")).select(key, "ord", "name")
    held = names_in_text(rows, key, said, dim.filter(F.length("_v") >= least).select(F.concat_ws("\t", F.lpad(F.col("ord").cast("string"), 10, "0"), "name").alias("name"), F.trim(F.regexp_replace("_v", "[^a-z0-9#]+", " ")).alias("normalised")))
    held = held.select(key, F.split("name", "\t")[0].cast("int").alias("ord"), F.split("name", "\t")[1].alias("name"))
    return equal.unionByName(held).groupBy(key).agg(F.min_by("name", "ord").alias("name"))


def resolved_company(names: DataFrame, key: str, name: str, register: DataFrame, least: float = 85.0) -> DataFrame:
    """Listed company of a name, by its normal form: equal, else the best word-set ratio. register has registered, listed."""
    own = register.filter("listed").select("registered", text.company_name(F.col("registered")).alias("normalised")).filter("normalised <> ''")
    return resolve(names.select(key, text.company_name(F.col(name)).alias(name)).filter(F.col(name) != ""), key, name, own, least)


def several_companies(docs: DataFrame, key: str, body: str, names: DataFrame, numbers: str, least: int = 2) -> DataFrame:
    """Documents that speak of several companies: so many different numbers, or names that aren't part of longer found ones."""
    ids = docs.select(key, F.size(F.array_distinct(F.regexp_extract_all(body, F.lit(numbers), F.lit(0)))).alias("ids"))
    found = names_in_text(docs, key, body, names).withColumn("_all", F.collect_set("name").over(Window.partitionBy(key)))
    alone = found.filter(~F.exists("_all", lambda x: (x != F.col("name")) & F.contains(F.lower(x), F.lower("name")))).groupBy(key).agg(F.count(F.lit(1)).alias("names"))
    return ids.join(alone, key, "left").select(key, "ids", F.coalesce("names", F.lit(0)).cast("int").alias("names"), ((F.col("ids") >= least) | (F.coalesce("names", F.lit(0)) >= least)).alias("several"))


def contact_state(observed: Column, digest: Column, salt: bytes, kind: str) -> Column:
    """match, mismatch or unknown of an observed address or number against a register's salted digest."""
    plain = text.email(observed) if kind == "email" else text.phone10(observed)
    return F.when(digest.isNull() | plain.isNull() | (plain == ""), "unknown").when(text.keyed_digest(plain, salt) == digest, "match").otherwise("mismatch")


def notice_state(notices: DataFrame, number: str, body: str, dated: str, index: DataFrame, since: Column) -> DataFrame:
    """Official notices against an index (reference, body_hash): exact, reference, outside_coverage (older than the
    index), not_in_index."""
    i = index.select(F.col("reference").alias("_r"), F.col("body_hash").alias("_h")).dropDuplicates(["_r"])
    both = notices.join(i, text.reference(F.col(number)) == F.col("_r"), "left")
    state = F.when(F.col("_r").isNotNull() & (text.notice_hash(F.col(body)) == F.col("_h")), "exact").when(F.col("_r").isNotNull(), "reference").when(F.col(dated) < since, "outside_coverage").otherwise("not_in_index")
    return both.select(*notices.columns, state.alias("state"))


def best_entry(rows: DataFrame, key: str, present: list[str], tie: str) -> DataFrame:
    """The entry of each key that states most: by the presence of columns in their order, then the least of a tie column."""
    return latest(rows, [key], [*[F.col(c).isNotNull().desc() for c in present], F.col(tie)])


def namespace_state(handle: Column, suffixes: DataFrame | None = None, listed: tuple[str, ...] = (), claimed: Column | None = None) -> Column:
    """Whether a payment handle lies in the vetted namespace (name.code@valid...), its code, and whether it is the claimed one."""
    local, suffix = F.lower(F.substring_index(handle, "@", 1)), F.lower(F.substring_index(handle, "@", -1))
    code = F.nullif(F.regexp_extract(local, r"\.([a-z]+)$", 1), F.lit(""))
    inside = handle.contains("@") & suffix.isin(*listed)
    clash = F.lit(False) if claimed is None else F.coalesce(inside & code.isNotNull() & (code != F.lower(claimed)), F.lit(False))
    return F.struct(inside.alias("inside"), F.when(inside, code).alias("code"), clash.alias("clash"))


def recognition_family(rows: DataFrame, column: str) -> DataFrame:
    """Stem (letters before the first digit) of numbers with count, shortest and longest, least and most digits and the lengths met."""
    c = F.upper(F.trim(column))
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return rows.groupBy(F.regexp_extract(c, "^[A-Z]+", 0).alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.min(digits).alias("least_digits"), F.max(digits).alias("most_digits"), F.array_sort(F.collect_set(F.length(c))).alias("lengths"))


def entity_in_message(rows: DataFrame, key: str, display: str, body: str, domain: str, names: DataFrame, owners: DataFrame) -> DataFrame:
    """The entity that a message claims to be: its display name, else the longest listed name in the text, else the
    domain's owner, with where it was found. names has name, normalised; owners domain, entity."""
    inside = longest_name(names_in_text(rows, key, body, names), key).select(key, F.col("name").alias("_text"))
    own = owners.select(F.col("domain").alias("_d"), F.col("entity").alias("_owner")).dropDuplicates(["_d"])
    both = rows.join(inside, key, "left").join(own, F.lower(domain) == F.col("_d"), "left")
    shown = F.nullif(F.trim(F.regexp_replace(display, r"(?i)\s*[-|(]\s*(?:team|support|alerts|no.?reply).*$", "")), F.lit(""))
    return both.select(key, F.coalesce(shown, F.col("_text"), F.col("_owner")).alias("entity"), F.when(shown.isNotNull(), "display").when(F.col("_text").isNotNull(), "text").when(F.col("_owner").isNotNull(), "domain").alias("by"))


def owns(entity: Column, destination: Column, known: Column) -> Column:
    """Whether a destination is among an entity's known ones; null where the entity or its list is unknown."""
    return F.when(entity.isNull() | known.isNull(), F.lit(None).cast("boolean")).otherwise(F.array_contains(F.transform(known, lambda x: F.lower(x)), F.lower(destination)))

"""Content credentials: the state of an asset from its manifest, and the worst state among what it was made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.sources.shared import kept

# States from worst to best with what they add to trust, and codes of failed checks.
DELTAS = {"tampered": -35, "signed_untrusted": 0, "unsupported": 0, "no_credentials": 0, "verified_signed": 20}
FAILED = r"^(assertion\.|claim\.|signingCredential\.|algorithmUnsupported)"
GENERATED = "trainedAlgorithmicMedia"

_ACTION = "struct<digitalSourceType:string,softwareAgent:string>"
_MANIFEST = f"struct<signature_info:struct<issuer:string,common_name:string,time:string>,claim_generator:string,assertions:array<struct<label:string,data:struct<actions:array<{_ACTION}>>>>,ingredients:array<struct<id:string>>>"
_STORE = f"struct<active_manifest:string,manifests:map<string,{_MANIFEST}>,validation_status:array<struct<code:string>>>"


def interpret(manifest: Column, anchors: tuple[str, ...] = ()) -> Column:
    """state, delta, signer, signed_at, declared (how the signer says the asset was made), n_ingredients, codes (failed
    checks, up to four in order) of an asset's manifest store as JSON text.

    Null or blank text is no credentials; text that isn't a store is unsupported. A failed check is tampered, whoever
    signed. A signer counts as known if an anchor's name is part of theirs.
    """
    s = F.from_json(manifest, _STORE)
    active = F.try_element_at(s["manifests"], s["active_manifest"])
    signer = F.coalesce(active["signature_info"]["issuer"], active["signature_info"]["common_name"])
    codes = F.filter(F.transform(F.coalesce(s["validation_status"], F.array()), lambda v: v["code"]), lambda c: c.rlike(FAILED))
    actions = F.flatten(F.transform(F.filter(F.coalesce(active["assertions"], F.array()), lambda a: a["label"].contains("actions")), lambda a: F.coalesce(a["data"]["actions"], F.array())))
    said = F.filter(F.transform(actions, lambda a: F.coalesce(F.nullif(a["digitalSourceType"], F.lit("")), a["softwareAgent"])), lambda x: x.isNotNull())
    declared = F.when(F.exists(said, lambda x: x.contains(GENERATED)), GENERATED).otherwise(F.try_element_at(said, F.lit(1)))
    known = F.coalesce(F.exists(F.array(*[F.lit(a.lower()) for a in anchors]).cast("array<string>"), lambda a: F.lower(signer).contains(a)), F.lit(False))
    blank = F.trim(F.coalesce(manifest, F.lit(""))) == ""
    state = F.when(blank, "no_credentials").when(s["manifests"].isNull(), "unsupported").when(F.size(codes) > 0, "tampered").when(known, "verified_signed").otherwise("signed_untrusted")
    delta = F.lit(0)
    for k, v in DELTAS.items():
        delta = F.when(state == k, v).otherwise(delta)
    return F.struct(state.alias("state"), delta.alias("delta"), signer.alias("signer"), active["signature_info"]["time"].alias("signed_at"), declared.alias("declared"), F.size(F.coalesce(active["ingredients"], F.array())).alias("n_ingredients"), F.slice(F.array_sort(F.array_distinct(codes)), 1, 4).alias("codes"))


def rank(state: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, DELTAS)), state)


def worst_source(assets: DataFrame, uses: DataFrame) -> DataFrame:
    """id, worst and source: the worst state among an asset and all that it was made from, and the least asset of that state.

    assets has id and state, each id once; uses has id and part. Parts that are no assets don't count; an asset may be
    a part of many, and circles are allowed. Assets made from one part each are followed by pointer doubling, so that a
    chain of any length takes as many rounds as its length has digits; what is left, assets of several parts, pass on
    to those made from them only what has changed.
    """
    own = kept(assets.select("id", F.struct(rank(F.col("state")).alias("rank"), F.col("id").alias("source")).alias("v")), "assets")
    edges = uses.select("id", "part").distinct().join(own.select(F.col("id").alias("part")), "part", "left_semi").join(own.select("id"), "id", "left_semi")
    edges = kept(edges, "parts")
    degree = edges.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("part"))
    jump = own.join(degree, "id", "left").select("id", "v", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("part")).otherwise(F.col("id")).alias("to"))
    jump = kept(jump, "jumps")
    length, most = 1, jump.filter("n = 1").count()
    while length <= most:
        there = jump.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("v").alias("w"))
        jump, length = kept(jump.join(there, "to").select("id", F.least("v", "w").alias("v"), "n", F.col("far").alias("to")), "jumps"), 2 * length
    ends = jump.select(F.col("id").alias("part"), F.col("to").alias("stop"), F.col("v").alias("w"))
    several = jump.filter("n > 1").select("id", "v")
    met = edges.join(several.select("id"), "id", "left_semi").join(ends, "part")
    best = kept(several.join(met.groupBy("id").agg(F.min("w").alias("w")), "id").select("id", F.least("v", "w").alias("v")), "worst")
    links = kept(met.select("id", "stop").join(several.select(F.col("id").alias("stop")), "stop", "left_semi").distinct(), "links")
    fresh = best
    while not fresh.isEmpty():
        told = links.join(fresh.select(F.col("id").alias("stop"), F.col("v").alias("w")), "stop").groupBy("id").agg(F.min("w").alias("w"))
        step = kept(best.join(told, "id", "left").select("id", F.least("v", "w").alias("v"), (F.col("w") < F.col("v")).alias("changed")), "worst")
        fresh, best = step.filter("changed").select("id", "v"), step.select("id", "v")
    done = jump.join(best.select(F.col("id").alias("to"), F.col("v").alias("w")), "to", "left").select("id", F.least("v", "w").alias("v"))
    return done.select("id", F.element_at(F.array(*map(F.lit, DELTAS)), F.col("v.rank").cast("int")).alias("worst"), F.col("v.source").alias("source"))

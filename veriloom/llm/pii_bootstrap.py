"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers with their checks. They are the seeds of a
bootstrap: the words around them are lexical patterns; the same patterns around other identifier-like tokens (four
digits or an at sign) tie these to the seeds in a graph of patterns and instances. A pattern's confidence for a kind
is the confidence of its instances over their number and one; an instance's confidence is the odds that not all its
trusted patterns are wrong. Scores go back and forth ROUNDS times, by aggregations over the graph's edges. Patterns
with SUPPORT different seeds and enough confidence then add the tokens that they surround, as found_<kind>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import save, table

SEEDS = ("email", "ip", "card", "phone")
KINDS = (*SEEDS, *(f"found_{k}" for k in SEEDS))
ROUNDS, SUPPORT, TRUST = 3, 3, 0.35

#: Base patterns, written without backtracking: a match starts where the run of its first class does, or where the
#: last match ended, and what follows is taken whole.
MAIL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{MAIL}]))[{MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried on it.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
BLANK = r"\x20\x09-\x0D"
TOKEN = rf"(?<![^{BLANK}])[^{BLANK}0-9@]*+[0-9@][^{BLANK}]*+"
WORD = rf"[^{BLANK}]+"
#: Characters around a span in which the words of its patterns are looked for.
LEFT, RIGHT = 64, 40
#: Characters of a piece of a text.
PIECE = 1024


def _barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, so that they are computed once and not copied into what uses them."""
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_made")
    return df.select("*", made).select(*df.columns, "_made.*")


def _scan(xs: Column, combine, zero: int, chunk: int = 256) -> Column:
    """What all whole numbers before each one of an array combine to, the first being zero; in two levels, so that long
    arrays don't cost their square."""
    size = F.size(xs)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int")), lambda c: F.slice(xs, c * chunk + 1, chunk))
    total = lambda x: F.aggregate(x, F.lit(zero), combine)

    def running(x: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, v: F.struct(combine(a.at, v).alias("at"), F.array_append(a.out, a.at).alias("out"))
        return F.aggregate(x, first, step, lambda a: a.out)

    bases = running(F.transform(chunks, total), F.lit(zero))
    return F.when(size > 0, F.flatten(F.zip_with(chunks, bases, running))).otherwise(F.array().cast("array<int>"))


def _starts(steps: Column) -> Column:
    """Running sums of an array of whole numbers, the first being 0 and the last sum left out."""
    return _scan(steps, lambda a, x: a + x, 0)


def _spans(gaps: Column, hits: Column) -> Column:
    """Start, end and value of matches, from the texts between them and their own; code points."""
    lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
    value = lambda at, i: F.struct((at + F.length(F.element_at(gaps, i + 1))).alias("start"), F.element_at(hits, i + 1).alias("value"))
    return F.transform(_starts(lengths), value)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, p.substr(-3, 3).cast("int")), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(_digits(x)).between(14, 19) & F.coalesce(F.call_function("luhn_check", _digits(x)), F.lit(False))
    return F.length(_digits(x)).between(10, 15) if kind == "phone" else F.lit(True)


def _context(pieces: Column, start: Column, end: Column) -> Column:
    """Patterns around a span: two words to the left; a word on either side. Digits count as 0.

    pieces is the text, cut into PIECE characters each, so that what is around a span isn't looked for from the text's
    beginning. Words are looked for in so many characters to either side; one that goes on beyond them (a run without
    blanks) is no word of a pattern.
    """
    words = lambda x: F.transform(F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)), lambda w: F.regexp_replace(w, "[0-9]", "0"))
    piece = lambda i: F.coalesce(F.try_element_at(pieces, F.greatest(i, F.lit(0)).cast("int") + 1), F.lit(""))
    at, to = F.floor(start / PIECE), F.floor(end / PIECE)
    near = F.concat(F.when(at > 0, piece(at - 1)).otherwise(""), piece(at))
    place = start - F.greatest(at - 1, F.lit(0)) * PIECE
    before = F.substring(near, F.greatest(place - LEFT, F.lit(0)).cast("int") + 1, F.least(place, F.lit(LEFT)).cast("int"))
    behind = F.substring(F.concat(piece(to), piece(to + 1)), (end - to * PIECE).cast("int") + 1, F.lit(RIGHT))
    left = words(F.when(start > LEFT, F.regexp_replace(before, f"^[^{BLANK}]+", "")).otherwise(before))
    right = words(F.when(F.length(behind) == RIGHT, F.regexp_replace(behind, f"[^{BLANK}]+$", "")).otherwise(behind))
    one, two, after = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2)), F.coalesce(F.try_element_at(right, F.lit(1)), F.lit(""))
    return F.array_compact(F.array(F.when(two.isNotNull(), F.concat_ws(" ", F.lit("L"), two, one)), F.when(one.isNotNull(), F.concat_ws(" ", F.lit("B"), one, after))))


def _free(tokens: Column, spans: Column) -> Column:
    """Tokens that overlap no span: in the order of where tokens end and spans start, no span so far reaches beyond the
    token's start. Both are looked at once, however many there are."""
    mark = lambda at, rank, end, token: F.struct(at.alias("at"), F.lit(rank).alias("rank"), end.alias("end"), token.alias("token"))
    none = F.lit(None).cast("struct<start:int,end:int,value:string>")
    events = F.array_sort(F.concat(F.transform(tokens, lambda s: mark(s.end, 0, s.end, s)), F.transform(spans, lambda s: mark(s.start, 1, s.end, none))))
    reach = _scan(F.transform(events, lambda e: F.when(e["rank"] == 1, e.end).otherwise(-1)), lambda a, x: F.greatest(a, x), -1)
    kept = F.filter(F.arrays_zip(events.alias("e"), reach.alias("r")), lambda z: (z.e["rank"] == 0) & (z.r <= z.e.token.start))
    return F.when(F.size(spans) == 0, tokens).otherwise(F.transform(kept, lambda z: z.e.token))


def base_table(docs: DataFrame) -> DataFrame:
    """doc_id, key (128 bits of hashes of the text), base and other spans of each row, with patterns around each."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.concat(F.hex(F.xxhash64(text)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), text))).alias("key"))
    none = F.array().cast("array<string>")
    tried = {k: F.col("text").rlike(h) for k, h in HINTS.items()} | {"token": F.col("text").rlike("[0-9@]")}
    cut = {}
    for k, pattern in (PATTERNS | {"token": TOKEN}).items():
        cut[f"{k}_hits"] = F.when(tried[k], F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
        cut[f"{k}_gaps"] = F.when(tried[k], F.split("text", pattern, -1)).otherwise(none)
    rows = _barrier(rows, **cut)
    rows = _barrier(rows, **{f"{k}_spans": _spans(F.col(f"{k}_gaps"), F.col(f"{k}_hits")) for k in (*SEEDS, "token")}).select("doc_id", "key", "text", *[f"{k}_spans" for k in (*SEEDS, "token")])

    def tagged(k: str) -> Column:
        good = F.filter(f"{k}_spans", lambda s: _valid(k, s.value))
        return F.transform(good, lambda s: F.struct(s.start.alias("start"), F.lit(SEEDS.index(k)).alias("rank"), (s.start + F.length(s.value)).alias("end"), F.lit(k).alias("kind"), F.lower(s.value).alias("value")))

    lead = lambda x: F.length(F.regexp_extract(x, "^[^A-Za-z0-9@+]*+", 0))
    trail = lambda x: F.length(x) - F.length(F.regexp_replace(x, "(?<=[A-Za-z0-9])[^A-Za-z0-9]++$", ""))
    core = F.transform("token_spans", lambda s: F.struct((s.start + lead(s.value)).alias("start"), (s.start + F.length(s.value) - trail(s.value)).alias("end"), s.value.substr(lead(s.value) + 1, F.length(s.value) - lead(s.value) - trail(s.value)).alias("value")))
    likely = F.filter(core, lambda s: (F.length(F.translate(s.value, "0123456789", "")) + 4 <= F.length(s.value)) | F.contains(F.substring(s.value, F.lit(2), F.lit(1 << 30)), F.lit("@")))
    rows = _barrier(rows, base=F.array_sort(F.concat(*[tagged(k) for k in SEEDS])), likely=likely).select("doc_id", "key", "text", "base", "likely")
    rows = _barrier(rows, other=_free(F.col("likely"), F.col("base")), pieces=F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)))
    around = lambda s: _context(F.col("pieces"), s.start, s.end)
    base = F.transform("base", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s["rank"].alias("rank"), s.kind.alias("kind"), s.value.alias("value"), around(s).alias("patterns")))
    other = F.transform("other", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lower(s.value).alias("value"), around(s).alias("patterns")))
    return rows.select("doc_id", "key", base.alias("base"), other.alias("other"))


def trusted_patterns(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """pattern, kind and confidence of the patterns that the graph of patterns and instances leaves trusted."""
    seeds = found.select(F.explode("base").alias("s")).select("s.kind", "s.value", F.explode("s.patterns").alias("pattern")).distinct()
    others = found.select(F.explode("other").alias("s")).select("s.value", F.explode("s.patterns").alias("pattern")).distinct()
    supported = seeds.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= support)
    supported = save(supported, "pii-patterns")
    edges = others.join(supported.select("pattern").distinct(), "pattern", "left_semi")
    edges = save(edges.join(seeds.select("value").distinct(), "value", "left_anti"), "pii-edges")
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("others"))
    # seeds of other kinds count among a pattern's instances as well
    all_seeds = seeds.join(supported.select("pattern").distinct(), "pattern", "left_semi").groupBy("pattern").agg(F.count_distinct("value").alias("all_seeds"))
    fixed = save(supported.join(size, "pattern", "left").join(all_seeds, "pattern", "left").select("pattern", "kind", "seeds", (F.coalesce("others", F.lit(0)) + F.col("all_seeds")).alias("n")), "pii-sizes")
    scored = fixed.select("pattern", "kind", (F.col("seeds") / (F.col("n") + 1)).alias("confidence"))
    for _ in range(rounds):
        good = scored.filter(F.col("confidence") >= trust)
        odds = edges.join(good, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("c"))
        gained = edges.join(odds, "value").groupBy("pattern", "kind").agg(F.sum("c").alias("gain"))
        scored = fixed.join(gained, ["pattern", "kind"], "left").select("pattern", "kind", ((F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / (F.col("n") + 1)).alias("confidence"))
        scored = save(scored, "pii-scores")
    return scored.filter(F.col("confidence") >= trust)


def find_personal_data(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base and spans of every row: arrays of start, rank, end and kind, sorted; spans are base and found.

    Null and empty texts have none. Equal texts have equal spans. Rows without doc_id are served like others. A token
    is found as one kind, that of its most trusted pattern (ties: the first kind).
    """
    rows = save(base_table(docs), "pii-base")
    trusted = trusted_patterns(rows, **options)
    other = rows.select("key", F.explode("other").alias("s")).select("key", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    rank = F.array_position(F.array(*[F.lit(k) for k in SEEDS]), F.col("kind")).cast("int")
    best = F.max(F.struct("confidence", (-rank).alias("place"), "kind")).alias("best")
    found = other.join(trusted, "pattern").groupBy("key", "start", "end").agg(best).select("key", F.struct("start", (F.lit(len(SEEDS) - 1) - F.col("best.place")).cast("int").alias("rank"), "end", F.concat(F.lit("found_"), "best.kind").alias("kind")).alias("span"))
    found = found.groupBy("key").agg(F.collect_set("span").alias("found")).withColumnRenamed("key", "k")
    base = F.transform("base", lambda s: F.struct(s.start.alias("start"), s["rank"].alias("rank"), s.end.alias("end"), s.kind.alias("kind")))
    both = rows.join(found, F.col("key") == F.col("k"), "left").select("doc_id", base.alias("base"), "found")
    return both.select("doc_id", "base", F.when(F.col("found").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "found"))).alias("spans"))


def op2(spark, sf_dir: str) -> DataFrame:
    """Query: counts and digest of base spans and all spans of every document."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    more = [F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("has_personal_data")]
    return found.select("doc_id", *[count(k) for k in KINDS], *more, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))

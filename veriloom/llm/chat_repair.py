"""Conversation structure repair: the cheapest edits that make a conversation's roles legal.

A legal conversation reads `(s?(ua)+)?` in initials of roles. Its grammar has four states; where a conversation can be
finished from is, for each place, a set of states in four bits. Layer c of costs holds these sets for finishing at a
cost of exactly c: it follows from layers c - 3, c - 4, c - 6 and itself by table look-ups, from the last turn to the
first, so the first layer that holds the start state at the first turn gives the cost. The audit is traced forwards
through the layers: at each step the least letter whose state is in the layer of what is left to spend.

A conversation is cut into segments of SEGMENT turns, so that one with a third of all rows is many small groups. For
each segment the layers give the cost between any two states; these small tables are followed from the last segment
back to the first, which tells each segment what finishing costs behind it; then all segments are traced, from each of
the four states, and the traces are joined from the first to the last. Only hashing the repaired text, which its
digest can't do otherwise, follows a conversation's texts one after another, in bounded memory.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.common import SPACES, save, table
from veriloom.llm.turns import numbered

#: Turns of a segment.
SEGMENT = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: 0 nothing yet, 1 after the system turn, 2 after a user's, 3 after an assistant's. Next state by initial.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Inserted and changed turns are the user's or the assistant's: from each state one of them is legal.
NEXT = (2, 2, 3, 2)
#: What finishing costs behind the last turn, by inserting.
END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 40


def _sources(step: dict[int, int]) -> list[int]:
    """For each set of states, the set of states that a step leads from into it."""
    return [sum(1 << a for a, b in step.items() if bits >> b & 1) for bits in range(16)]


FROM = {k: _sources(v) for k, v in STEP.items()} | {"x": [0] * 16}
FROM_NEXT = _sources(dict(enumerate(NEXT)))


def layers(turns: str, ends: tuple) -> list[bytearray]:
    """Sets of states by cost and place, from which turns can be finished at exactly that cost.

    turns has a letter each: the role's initial (x for others), large if the text is truncated, D if the turn must go.
    ends: the cost of finishing from each state behind the last turn, NEVER for none. Layers go on until every state
    that can finish at all is in a layer at the first turn.
    """
    n, out, found, c = len(turns), [], 0, 0
    rows = [(t, FROM.get(t.lower()), 0 if t.islower() else TRUNCATED) for t in turns]
    blank = bytearray(n + 1)
    last = max((e for e in ends if e < NEVER), default=-1) + DELETE * n + 2 * INSERT
    while found != 15 and c <= last:
        now = bytearray(n + 1)
        now[n] = sum(1 << s for s in range(4) if ends[s] == c)
        third, fourth, sixth = (out[c - k] if c >= k else blank for k in (INSERT, DELETE, REROLE + TRUNCATED))
        for i in range(n - 1, -1, -1):
            letter, kept, extra = rows[i]
            bits = fourth[i + 1] | FROM_NEXT[third[i]]
            if letter != "D":
                if extra:
                    bits |= kept[third[i + 1]] | FROM_NEXT[sixth[i + 1]]
                else:
                    bits |= kept[now[i + 1]] | FROM_NEXT[third[i + 1]]
            now[i] = bits
        out.append(now)
        found |= now[0]
        c += 1
    return out


def costs(found: list[bytearray]) -> list[int]:
    """The least cost of finishing from each state at the first turn."""
    return [next((c for c, row in enumerate(found) if row[0] >> s & 1), NEVER) for s in range(4)]


def trace(turns: str, found: list[bytearray], state: int) -> tuple[str, int]:
    """The least of the cheapest audits of all turns from a state, and the state behind the last turn."""
    c, i, out = costs(found)[state], 0, []
    while i < len(turns):
        t = turns[i]
        extra = 0 if t.islower() else TRUNCATED
        ways = [("D", state, DELETE, 1), ("I", NEXT[state], INSERT, 0)]
        if t != "D":
            if (to := STEP.get(t.lower(), {}).get(state)) is not None:
                ways.append(("K", to, KEEP + extra, 1))
            ways.append(("R", NEXT[state], REROLE + extra, 1))
        letter, state, cost, move = next(w for w in ways if w[2] <= c and found[c - w[2]][i + w[3]] >> w[1] & 1)
        out.append(letter)
        c, i = c - cost, i + move
    return "".join(out), state


@functools.lru_cache(4096)
def segment_costs(turns: str) -> list[int]:
    """The least cost from each state to each state behind the last turn, row by row; NEVER where there is no way."""
    by_end = [costs(layers(turns, tuple(0 if s == e else NEVER for s in range(4)))) for e in range(4)]
    return [by_end[e][s] for s in range(4) for e in range(4)]


@functools.lru_cache(4096)
def segment_traces(turns: str, ends: tuple, first: bool) -> tuple[list[str], list[int], int]:
    """Audits and states behind, for each state before (only the start in a first segment), and the cost from the start."""
    found = layers(turns, ends)
    least = costs(found)
    ways = [trace(turns, found, s) if least[s] < NEVER and (s == 0 or not first) else ("", 0) for s in range(4)]
    return [w[0] for w in ways], [w[1] for w in ways], least[0]


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [segment_costs(t) for t in b.column("letters").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("seg"), pa.array(made, pa.list_(pa.int64()))], ["conv", "seg", "table"])


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What finishing costs behind each segment; rows come by conversation, last segment first."""
    at, ends = None, END
    for b in batches:
        convs, out = b.column("conv").to_pylist(), []
        for conv, t in zip(convs, b.column("table").to_pylist(), strict=True):
            if conv != at:
                at, ends = conv, END
            out.append(ends)
            ways = [min(t[4 * s + e] + ends[e] for e in range(4)) for s in range(4)]
            ends = tuple(min(w, NEVER) for w in ways)
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("seg"), pa.array(out, pa.list_(pa.int64()))], ["conv", "seg", "ends"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [segment_traces(t, tuple(e or END), k == 0) for t, e, k in zip(*(b.column(c).to_pylist() for c in ("letters", "ends", "seg")), strict=True)]
        kinds = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("seg"), *(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))], ["conv", "seg", "audits", "exits", "cost"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each segment as the one before leaves it, with what is inserted behind the last turn; rows come by
    conversation and segment."""
    at, state = None, 0
    for b in batches:
        out = []
        for conv, audits, exits, last in zip(*(b.column(c).to_pylist() for c in ("conv", "audits", "exits", "last")), strict=True):
            if conv != at:
                at, state = conv, 0
            audit, state = audits[state], exits[state]
            out.append(audit + "I" * (END[state] // INSERT) if last else audit)
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("seg"), pa.array(out, pa.string())], ["conv", "seg", "audit"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the repaired turns of a conversation; rows come by conversation and place, a segment's audit first."""
    at, h, state, any_, edits = None, None, 0, False, iter("")

    def add(role: str, text: str) -> None:
        nonlocal any_
        h.update(f"{chr(10) if any_ else ''}{role}:".encode())
        h.update(text.encode())
        any_ = True

    def turn(row) -> None:
        """Applies edits up to the one of a turn; without a turn, those that are left."""
        nonlocal state
        for e in edits:
            if e in "IR":
                state = NEXT[state]
                add("user" if state == 2 else "assistant", row[1] if e == "R" else "")
            elif e == "K":
                state = STEP[row[0][0]][state]
                add(*row)
            if e != "I" and row:
                return

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["conv", "repaired_sha256"])

    for b in batches:
        out = []
        for conv, role, text, audit in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text", "audit")), strict=True):
            if conv != at:
                if h:
                    turn(None)
                    out.append((at, h.hexdigest()))
                at, h, state, any_, edits = conv, hashlib.sha256(), 0, False, iter("")
            if audit is not None:
                edits = iter(audit)
            else:
                turn((role, text))
        yield made(out)
    if h:
        turn(None)
        yield made([(at, h.hexdigest())])


def faults(rows: DataFrame) -> DataFrame:
    """Adds letter (see layers), initial and fault (blank, duplicate, truncated or null) to rows with conv, pos, role, text."""
    said = F.rtrim("text", F.lit(SPACES))
    rows = rows.withColumn("same", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    again = rows.groupBy("conv", "same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    fault = F.when(said == "", "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~F.right(said, F.lit(1)).isin(*".!?"), "truncated")
    initial = F.when(F.left("role", F.lit(1)).isin(*"sua"), F.left("role", F.lit(1))).otherwise("x")
    rows = rows.join(again, ["conv", "same"], "left").withColumns({"fault": fault, "initial": initial}).drop("same", "first")
    return rows.withColumn("letter", F.when(F.col("fault").isin("blank", "duplicate"), "D").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial")))


def repair(turns: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation of a table with conv (string, not null), turn, role and text (not null).

    Returns conv, gaps (turn numbers missing between the least and the greatest), blank, duplicate, truncated (rows by
    first fault), illegal (neighbours whose initials aren't su, ua or au), cost, audit (the edits' initials: Keep,
    Rerole, Delete, Insert; the least in ASCII of the cheapest) and repaired_sha256 (of `role:text`, newline-joined).

    Turns go by number (null first), then role, then text; rows alike are duplicates of the first. Roles other than
    those beginning with s, u or a, the empty role among them, can't be kept. Without rows there is no conversation.
    """
    rows = save(faults(numbered(turns.select("conv", "turn", "role", "text"), "conv")), "repair-turns")
    rows = rows.withColumn("seg", F.floor(F.col("pos") / SEGMENT))
    in_order = F.array_sort(F.collect_list(F.struct("pos", "letter", "initial")))
    joined = lambda c: F.concat_ws("", F.transform(in_order, lambda x: x[c]))  # noqa: E731
    segments = save(rows.groupBy("conv", "seg").agg(joined("letter").alias("letters"), joined("initial").alias("initials")), "repair-segments")
    by_conv = Window.partitionBy("conv").orderBy("seg")
    place = segments.select("conv", "seg", "letters", F.lead("seg").over(by_conv).isNull().alias("last"), F.concat(F.coalesce(F.lag(F.right("initials", F.lit(1))).over(by_conv), F.lit("")), "initials").alias("initials"))
    place = save(place, "repair-segments")
    several = place.filter("not last or seg > 0")
    behind = several.mapInArrow(_tables, "conv string, seg long, table array<long>").repartition("conv").sortWithinPartitions("conv", F.desc("seg")).mapInArrow(_behind, "conv string, seg long, ends array<long>")
    known = place.select("conv", "seg", "letters", "last").join(behind, ["conv", "seg"], "left")
    traces = save(known.mapInArrow(_traced, "conv string, seg long, audits array<string>, exits array<long>, cost long").join(place.select("conv", "seg", "last"), ["conv", "seg"]), "repair-traces")
    audits = save(traces.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_joined, "conv string, seg long, audit string"), "repair-audits")

    steps = audits.select("conv", (F.col("seg") * SEGMENT).alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    texts = rows.select("conv", "pos", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("string").alias("audit"))
    hashes = steps.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "pos", "kind").drop("pos", "kind").mapInArrow(_hashed, "conv string, repaired_sha256 string")

    whole = audits.groupBy("conv").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"])).alias("audit"))
    cost = traces.filter("seg = 0").select("conv", "cost")
    # every place but the last begins a pair
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length("initials") - 1, F.lit(1))), lambda i: F.substring(F.col("initials"), i, F.lit(2))), lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au"))
    illegal = place.groupBy("conv").agg(F.sum(F.size(pairs)).alias("illegal"))
    counts = rows.groupBy("conv", "turn").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    counts = counts.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    for more in (illegal, cost, whole, hashes):
        counts = counts.join(more, "conv")
    return counts.select("conv", *[F.col(c).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], "audit", "repaired_sha256")


def spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """conv, turn, role and text of conversations, damaged by crc32 of `conv_id:turn`, nulls as one space: of 20 classes
    0 drops a row, 1 empties its text, 2 removes its ends of sentences, 3 repeats it, 4 makes it the user's."""
    kind = F.crc32(F.concat("conv", F.lit(":"), spaced("turn"))) % 20
    rows = turns.select(spaced("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text")).withColumn("kind", kind).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11(spark, sf_dir: str) -> DataFrame:
    """Query: all conversations, damaged as the contract says, and their cheapest repairs."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    every = turns.select("conv_id", spaced("conv_id").alias("conv")).distinct()
    done = every.join(repair(damaged(turns)), "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return done.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


#: CRC-32 of a string of ASCII characters.
CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
OP11_SQL = f"""
WITH RECURSIVE k AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations
), d AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE kind <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS pos FROM d
), f AS (
  SELECT conv, turn, role, text, pos, left(role, 1) AS initial,
         CASE WHEN rtrim(text, ' 	

') = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN right(rtrim(text, ' 	

'), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY pos) AS earlier
  FROM n
), ins(s, k, t) AS (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 2), (0, 2, 3), (1, 1, 2), (1, 2, 3), (2, 1, 3), (3, 1, 2)),
ops(s, op, initial, cost, t) AS (VALUES (0, 'D', '', 4, 0), (1, 'D', '', 4, 1), (2, 'D', '', 4, 2), (3, 'D', '', 4, 3), (0, 'R', '', 3, 2), (1, 'R', '', 3, 2), (2, 'R', '', 3, 3), (3, 'R', '', 3, 2),
  (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (3, 'K', 'u', 0, 2), (2, 'K', 'a', 0, 3)),
ways AS (
  SELECT DISTINCT conv, 0::BIGINT AS pos, 0 AS state, 0 AS cost, '' AS audit FROM d
  UNION ALL
  (SELECT w.conv, f.pos, o.t, w.cost + 3 * i.k + o.cost + CASE WHEN f.fault = 'truncated' AND o.op <> 'D' THEN 3 ELSE 0 END AS cost, w.audit || repeat('I', i.k) || o.op AS audit
   FROM ways w JOIN f ON f.conv = w.conv AND f.pos = w.pos + 1 JOIN ins i ON i.s = w.state
   JOIN ops o ON o.s = i.t AND (o.op = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (o.op <> 'K' OR o.initial = f.initial)
   QUALIFY row_number() OVER (PARTITION BY w.conv, o.t ORDER BY w.cost + 3 * i.k + o.cost + CASE WHEN f.fault = 'truncated' AND o.op <> 'D' THEN 3 ELSE 0 END, w.audit || repeat('I', i.k) || o.op) = 1)
), best AS (
  SELECT w.conv, w.cost + 3 * i.k AS cost, w.audit || repeat('I', i.k) AS audit
  FROM ways w JOIN (SELECT conv, max(pos) AS pos FROM f GROUP BY 1) USING (conv, pos) JOIN ins i ON i.s = w.state AND i.t IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv ORDER BY w.cost + 3 * i.k, w.audit || repeat('I', i.k)) = 1
), letters AS (SELECT conv, unnest(range(1, length(audit) + 1)) AS spot, unnest(string_split(audit, '')) AS op FROM best WHERE audit <> ''
), placed AS (
  SELECT conv, spot, op, count(*) FILTER (op <> 'I') OVER w AS pos, count(*) FILTER (op <> 'D') OVER w AS out FROM letters WINDOW w AS (PARTITION BY conv ORDER BY spot)
), turns AS (
  SELECT p.conv, p.out, p.op, f.role, f.text, max(CASE WHEN p.out = 1 AND p.op = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv) AS led
  FROM placed p LEFT JOIN f ON f.conv = p.conv AND f.pos = p.pos AND p.op <> 'I' WHERE p.op <> 'D'
), repaired AS (
  SELECT conv, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (out - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY out)) AS sha
  FROM turns GROUP BY 1
), counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY 1
)
SELECT DISTINCT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM k LEFT JOIN counts USING (conv) LEFT JOIN best USING (conv) LEFT JOIN repaired USING (conv)
"""

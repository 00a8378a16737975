"""Conversation prefix trie: which openings conversations share, and what storing each once would save.

Every turn becomes a digest where it is read, and a conversation a chain of digests: the digest of a prefix covers
that of the prefix before it. Each prefix is a row, and the rows of one depth and digest are a node. Chains are cut
into blocks of BLOCK turns that start afresh and are then hung behind the digest of the block before, so that a very
long conversation is many groups, of which only the block ends are followed one by one.

Sums over subtrees come from exploding nodes to their ancestors. A node's ancestors are the prefixes of any of its
members; the one with the least id stands for it, and what all nodes of one such member bring to an ancestor is added
up along its prefixes first, so that there are never more rows than prefixes, and sums of common nodes are combined
before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.common import save, table
from veriloom.llm.turns import numbered

#: Turns whose digests are chained in one group.
BLOCK = 256
#: Ids joined to one piece of text before pieces of a node meet.
PIECE = 4096


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests within blocks, and the one before each; rows come by conv_id, block and depth."""
    at, last = None, None
    for b in batches:
        before, after = [], []
        for c, k, d in zip(b.column("conv_id").to_pylist(), b.column("block").to_pylist(), b.column("digest").to_pylist(), strict=True):
            if at != (c, k):
                at, last = (c, k), None
            before.append(last)
            last = hashlib.sha256((last or b"") + d).digest()
            after.append(last)
        names = ["conv_id", "block", "depth", "bytes"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(after, pa.binary()), pa.array(before, pa.binary())], [*names, "inner", "before"])


def _hung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix digest at the end of each block; rows come by conv_id and block."""
    at, last = None, b""
    for b in batches:
        ids, out = b.column("conv_id").to_pylist(), []
        for c, d in zip(ids, b.column("inner").to_pylist(), strict=True):
            last = hashlib.sha256((last if c == at else b"") + d).digest()
            at = c
            out.append(last)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array(out, pa.binary())], ["conv_id", "block", "base"])


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent and bytes of all prefixes of a table with conv_id, depth (from 1, without gaps),
    digest and bytes of turns. Two prefixes have one digest if their turns have."""
    blocks = turns.select("conv_id", F.floor((F.col("depth") - 1) / BLOCK).alias("block"), "depth", "digest", "bytes")
    dealt = blocks.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")
    inner = save(dealt.mapInArrow(_chains, "conv_id long, block long, depth long, bytes long, inner binary, before binary"), "trie-blocks")
    full = inner.filter(F.col("depth") % BLOCK == 0).select("conv_id", "block", "inner")
    ends = full.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_hung, "conv_id long, block long, base binary")
    joined = inner.join(ends.select("conv_id", (F.col("block") + 1).alias("block"), "base"), ["conv_id", "block"], "left")
    base = F.coalesce("base", F.lit(b""))
    hung = lambda c: F.unhex(F.sha2(F.concat(base, c), 256))
    return joined.select("conv_id", "depth", hung(F.col("inner")).alias("digest"), F.when(F.col("before").isNull(), base).otherwise(hung(F.col("before"))).alias("parent"), "bytes")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a node as comma-joined pieces of at most PIECE; rows come by depth, digest and conv_id."""
    names = ["depth", "digest", "first", "ids"]
    at, ids, out = None, [], []

    def flushed():
        if ids:
            out.append((*at, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for b in batches:
        for node, c in zip(zip(b.column("depth").to_pylist(), b.column("digest").to_pylist(), strict=True), b.column("conv_id").to_pylist(), strict=True):
            if node != at or len(ids) == PIECE:
                flushed()
                at = node
            ids.append(c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.string()), strict=True)], names)
            out.clear()
    flushed()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.string()), strict=True)], names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a node's pieces, comma-joined; rows come by depth, digest and first id."""
    at, h = None, None

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], ["depth", "digest", "ends_sha256"])

    for b in batches:
        out = []
        for node, ids in zip(zip(b.column("depth").to_pylist(), b.column("digest").to_pylist(), strict=True), b.column("ids").to_pylist(), strict=True):
            if node == at:
                h.update(b",")
            else:
                if at:
                    out.append((*at, h.hexdigest()))
                at, h = node, hashlib.sha256()
            h.update(ids.encode())
        yield made(out)
    if at:
        yield made([(*at, h.hexdigest())])


def _sums_to_the_end(rows: DataFrame, *columns: str) -> DataFrame:
    """Sums of columns from each depth of a conversation to its end, by blocks."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    per = rows.groupBy("conv_id", "block").agg(*[F.sum(c).alias(f"{c}_all") for c in columns])
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    rest = per.select("conv_id", "block", *[F.coalesce(F.sum(f"{c}_all").over(later), F.lit(0)).alias(f"{c}_rest") for c in columns])
    within = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("conv_id", "block", "depth", "digest", *[F.sum(c).over(within).alias(c) for c in columns])
    return summed.join(rest, ["conv_id", "block"]).select("conv_id", "depth", "digest", *[(F.col(c) + F.col(f"{c}_rest")).alias(c) for c in columns])


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of turns (conv_id, depth, digest, bytes; see prefixes) of conversations (conv_id, each
    once; those without turns are members of the root only).

    Returns conv_id (least member), depth, digest, parent_conv_id (null for the root), n_convs, n_children, n_leaves
    and saved_bytes (over the subtree, itself included), ends_sha256. Without conversations there are no nodes.
    """
    roots = conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"))
    every = save(prefixes(turns).unionByName(roots), "trie-prefixes")
    found = every.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"))
    found = save(found, "trie-nodes")
    children = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = found.join(parents, ["depth", "parent"], "left").join(children, ["depth", "digest"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = save(nodes.withColumn("saves", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie-nodes")

    own = nodes.filter("saves > 0 or leaf > 0").select("conv_id", "depth", "saves", "leaf")
    paths = every.select("conv_id", "depth", "digest").join(own, ["conv_id", "depth"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("saves", "leaf")})
    brought = _sums_to_the_end(paths, "saves", "leaf").filter("saves > 0 or leaf > 0")
    sums = brought.groupBy("depth", "digest").agg(F.sum("saves").alias("saved_bytes"), F.sum("leaf").alias("n_leaves"))

    ends = every.groupBy("conv_id").agg(F.max(F.struct("depth", "digest")).alias("x")).select("conv_id", "x.*")
    pieces = save(ends, "trie-ends").repartitionByRange("depth", "digest", "conv_id").sortWithinPartitions("depth", "digest", "conv_id")
    pieces = pieces.mapInArrow(_pieces, "depth long, digest binary, first long, ids string")
    hashes = pieces.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "first").mapInArrow(_hashed, "depth long, digest binary, ends_sha256 string")
    rows = nodes.join(sums, ["depth", "digest"], "left").join(hashes, ["depth", "digest"], "left")
    return rows.select("conv_id", "depth", "digest", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved_bytes", F.lit(0)).alias("saved_bytes"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def turn_rows(turns: DataFrame) -> DataFrame:
    """conv_id, pos, digest and bytes of turns (conv_id, turn, role, text): their place from 0 in the conversation, by
    turn (null first), then role and text; a digest of role and text, null as empty; the text's bytes in UTF-8.

    Rows without conv_id belong to no conversation. Repeated rows are turns like others. Other columns don't matter.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = numbered(turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text")), "conv_id")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return rows.select("conv_id", "pos", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def with_shared_openings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, digest, bytes) and conversations of a table of turn_rows, where the first h turns of
    conversation c are those of c - c % 5 (all if it has fewer, none if it isn't there); h = crc32 of c's digits % 9."""
    head = F.crc32(F.col("conv_id").cast("string")) % 9
    count = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    donors = rows.filter("conv_id % 5 = 0 and pos < 8").withColumnRenamed("conv_id", "base")
    opening = count.join(donors, "base").filter("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "bytes")
    there = count.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    short = count.join(there, "base", "left").select("conv_id", (F.col("h") - F.least("h", F.coalesce("n_base", F.lit(0)))).alias("lacks")).filter("lacks > 0")
    own = rows.filter(F.col("pos") >= head).join(short, "conv_id", "left").select("conv_id", (F.col("pos") + 1 - F.coalesce("lacks", F.lit(0))).alias("depth"), "digest", "bytes")
    return opening.unionByName(own), count.select("conv_id")


def op13(spark, sf_dir: str) -> DataFrame:
    """Query: the prefix trie of all conversations, with the openings that the contract gives them."""
    turns, conversations = with_shared_openings(save(turn_rows(table(spark, sf_dir, "conversations")), "trie-turns"))
    return trie(turns, conversations).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"), "ends_sha256")


#: CRC-32 of a string of ASCII characters.
CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC.format("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), joined AS (
  SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos < h
  UNION ALL
  SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h
), rebuilt AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth FROM joined
), p AS (
  SELECT conv_id, depth, list((role, text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path, strlen(text) AS bytes FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, [], 0 FROM c
), lasts AS (SELECT conv_id, max(depth) AS last FROM p GROUP BY 1
), n AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(CASE WHEN depth = last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM p JOIN lasts USING (conv_id) GROUP BY 1, 2
), leaves AS (SELECT n.*, NOT EXISTS (SELECT 1 FROM n m WHERE m.depth = n.depth + 1 AND m.path[:n.depth] = n.path) AS leaf FROM n)
SELECT a.conv_id, a.depth, any_value(u.conv_id) AS parent_conv_id, a.n_convs, count(*) FILTER (b.depth = a.depth + 1) AS n_children,
       count(*) FILTER (b.leaf) AS n_leaves, sum((b.n_convs - 1) * b.bytes)::BIGINT AS saved_tokens, a.ends_sha256
FROM n a JOIN leaves b ON b.depth >= a.depth AND b.path[:a.depth] = a.path
LEFT JOIN n u ON u.depth = a.depth - 1 AND u.path = a.path[:a.depth - 1]
GROUP BY a.conv_id, a.depth, a.path, a.n_convs, a.ends_sha256
"""

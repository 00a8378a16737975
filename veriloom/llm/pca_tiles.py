"""Embedding near-dedup: all pairs with a cosine of THRESHOLD or more, by PCA-ordered tiled comparison.

Vectors become unit vectors and are turned so that the directions of greatest energy come first. The turn, and the
planes that cut space into at most CELLS cells, come from a bounded sample; any turn and any planes give the same
links. A vector visits the cells whose box of leading components, with the greatest rest of their members, could hold
a vector near enough. Members and visitors of a cell are dealt into blocks, and every pair of blocks is one item of
work, so that a cell with a third of all vectors is many items.

An item is compared in tiles. The product of the leading components plus the product of the norms of what is left
bounds a cosine; tiles in which no bound reaches the threshold are done, the pairs that are left get further components,
and those that reach the end are links. Items return counts and a spanning forest of their links, never the links
themselves. Equal vectors are compared once, with their number as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import save, table
from veriloom.llm.components import components

THRESHOLD = 0.9
#: Rounding of products of unit vectors stays below this; bounds give it away, and nearer pairs are computed anew.
EPS = 1e-9
#: The sample that turn and planes come from: so many vectors, and so many bytes of them, at most.
SAMPLE, SAMPLE_BYTES = 8192, 1 << 25
#: Components of the first bound and of the cells' boxes; those of the second bound.
LEAD, MORE = 16, 32
#: Cells: so many vectors each, if there aren't more than CELLS then.
PER_CELL, CELLS = 4096, 1024
#: Vectors of a block, and of a tile.
BLOCK, TILE = 16_384, 512


def _packed(kind: str):
    """Rows with their vector as bytes; null for vectors that link with nothing."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column("vector"):
                values = v.values
                x = None if values is None or values.null_count else np.asarray(values, dtype=kind) + 0.0
                out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "payload"])

    return pack


class Space:
    """Turns vectors; holds planes and boxes of the cells. Size: the square of the dimension, and 2 * LEAD numbers a cell."""

    def __init__(self, kind: str, dim: int, sample: list[bytes], levels: int):
        self.kind, self.dim, self.levels = kind, dim, levels
        x = self.units(sample)
        _, axes = np.linalg.eigh(x.T @ x)
        self.turn = np.ascontiguousarray(axes[:, ::-1])
        self.axis, self.plane = np.zeros(1 << levels, int), np.zeros(1 << levels)
        self.lead = min(LEAD, dim)
        self._cut(1, (x @ self.turn)[:, : self.lead])

    def _cut(self, at: int, x: np.ndarray) -> None:
        if at >= 1 << self.levels:
            return
        if len(x):
            self.axis[at] = a = int(np.argmax(x.var(axis=0)))
            self.plane[at] = np.median(x[:, a])
        right = x[:, self.axis[at]] >= self.plane[at]
        self._cut(2 * at, x[~right])
        self._cut(2 * at + 1, x[right])

    def raw(self, payloads: list[bytes]) -> np.ndarray:
        """Vectors in double precision, shorter ones filled up with zeros."""
        x = np.zeros((len(payloads), self.dim))
        for i, p in enumerate(payloads):
            v = np.frombuffer(p, self.kind)
            x[i, : len(v)] = v
        return x

    def units(self, payloads: list[bytes]) -> np.ndarray:
        x = self.raw(payloads)
        x /= np.abs(x).max(axis=1, initial=0)[:, None]  # squares neither overflow nor vanish
        return x / np.linalg.norm(x, axis=1)[:, None]

    def turned(self, payloads: list[bytes]) -> np.ndarray:
        return self.units(payloads) @ self.turn

    def cells(self, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), int)
        for _ in range(self.levels):
            at = 2 * at + (x[np.arange(len(x)), self.axis[at]] >= self.plane[at])
        return at - (1 << self.levels)


def rest(x: np.ndarray, k: int) -> np.ndarray:
    """Norms of what stands behind the first k components."""
    return np.linalg.norm(x[:, k:], axis=1)


def _placed(space):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = space.value.cells(space.value.turned(b.column("payload").to_pylist())) if len(b) else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int32())], [*b.schema.names, "cell"])

    return place


def _boxes(space):
    """The least and greatest of each leading component in a cell; as component -1 the greatest rest."""

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            x, cells = space.value.turned(b.column("payload").to_pylist()), np.asarray(b.column("cell"))
            lead = space.value.lead
            x = np.hstack([x[:, :lead], rest(x, lead)[:, None]])
            for c in np.unique(cells):
                own = x[cells == c]
                now = np.array([own.min(axis=0), own.max(axis=0)])
                if (old := seen.get(int(c))) is not None:
                    now = np.array([np.minimum(now[0], old[0]), np.maximum(now[1], old[1])])
                seen[int(c)] = now
        for c, (low, high) in seen.items():
            n = len(low)
            yield pa.RecordBatch.from_arrays([pa.array([c] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(low), pa.array(high)], ["cell", "axis", "low", "high"])

    return box


def _visits(space, boxes):
    """Cells that a vector must be compared with: its own, and of those with greater numbers the ones that could link."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, low, high = boxes.value
        for b in batches:
            if not len(b):
                continue
            x, cells = space.value.turned(b.column("payload").to_pylist()), np.asarray(b.column("cell"))
            lead = space.value.lead
            head, out = x[:, :lead], []
            up, down, far = np.maximum(head, 0), np.minimum(head, 0), rest(x, lead)
            bound = up @ high[:, :lead].T + down @ low[:, :lead].T + far[:, None] * high[:, lead]
            near = (bound >= THRESHOLD - EPS) & (names > cells[:, None]) | (names == cells[:, None])
            for row in near:
                out.append(names[row].tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], [*b.schema.names, "visits"])

    return visit


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives all vertices that the pairs connect, with what they are connected to already, the least label."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := label[label], label):
            label[:] = further


def linked(v: np.ndarray, m: np.ndarray, raw_v, raw_m) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of rows of two tiles of turned unit vectors with a cosine of THRESHOLD or more.

    raw_v and raw_m give the vectors as they came, for pairs that are nearer to the threshold than rounding."""
    d = v.shape[1]
    lead = min(LEAD, d)
    bound = np.hstack([v[:, :lead], rest(v, lead)[:, None]]) @ np.hstack([m[:, :lead], rest(m, lead)[:, None]]).T
    i, j = np.nonzero(bound >= THRESHOLD - EPS)
    if 8 * len(i) > bound.size:
        cosine = (v @ m.T)[i, j]
    else:
        if d > MORE and len(i):
            held = np.einsum("ij,ij->i", v[i, :MORE], m[j, :MORE]) + rest(v, MORE)[i] * rest(m, MORE)[j] >= THRESHOLD - EPS
            i, j = i[held], j[held]
        cosine = np.einsum("ij,ij->i", v[i], m[j])
    close = np.nonzero(np.abs(cosine - THRESHOLD) < EPS)[0]
    if len(close):
        x, y = raw_v(i[close]), raw_m(j[close])
        cosine[close] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
    held = cosine >= THRESHOLD
    return i[held], j[held]


def _compared(space):
    """Counts of links of the members and visitors of an item, and its links' spanning forest."""

    def compare(members: pa.Table, visitors: pa.Table) -> pa.Table:
        s = space.value
        names, weights, both, sides = [], [], [], []
        for t in (members, visitors):
            packed = t.column("payload").to_pylist()
            x = s.turned(packed) if packed else np.zeros((0, s.dim))
            order = np.argsort(x[:, 0], kind="stable")
            names.append(np.array(t.column("node").to_pylist(), dtype="S16")[order] if packed else np.zeros(0, "S16"))
            weights.append(np.asarray(t.column("n"))[order])
            sides.append((x[order], [packed[i] for i in order], np.asarray(t.column("own"))[order]))
        (m, packed_m, _), (v, packed_v, own) = sides
        nm, counts = len(m), [np.zeros(len(m), np.int64), np.zeros(len(v), np.int64)]
        label = np.arange(len(m) + len(v))
        for a in range(0, len(v), TILE):
            for b in range(0, nm, TILE):
                i, j = linked(v[a : a + TILE], m[b : b + TILE], lambda k, a=a: s.raw([packed_v[a + q] for q in k]), lambda k, b=b: s.raw([packed_m[b + q] for q in k]))
                if not len(i):
                    continue
                i, j = i + a, j + b
                once = ~own[i] | (names[1][i] > names[0][j])  # in one cell, a pair meets twice
                i, j = i[once], j[once]
                np.add.at(counts[0], j, weights[1][i])
                np.add.at(counts[1], i, weights[0][j])
                unite(label, j, i + nm)
        every = np.concatenate(names)
        both = np.nonzero(np.concatenate(counts))[0]
        tied = np.nonzero(label != np.arange(len(label)))[0]
        node = lambda k: [x.ljust(16, b"\0") for x in every[k].tolist()]  # noqa: E731  numpy drops zeros at the end
        rows = [node(both) + node(tied), [None] * len(both) + node(label[tied]), np.concatenate(counts)[both].tolist() + [0] * len(tied)]
        return pa.table([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.int64())], ["a", "b", "links"])

    return compare


def near_vectors(rows: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of a table with a long id and an array of numbers.

    n_links: how many other rows link directly; component_id: the least id that links reach, the row's own included;
    kept: whether it is the row's own. Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing. Shorter vectors count as filled up with zeros. Rows are vectors of their own, whatever their id:
    repeated rows link with each other. Rows without id count as links, but their id isn't the least of anything; such
    a row is kept only if it reaches no id. Other columns don't matter; an empty table gives no rows.
    """
    spark = rows.sparkSession
    single = dict(rows.dtypes)[vector] == "array<float>"
    kind, width = ("<f4", 4) if single else ("<f8", 8)
    picked = rows.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{'float' if single else 'double'}>").alias("vector"))
    packed = picked.mapInArrow(_packed(kind), "vec_id long, payload binary")
    packed = save(packed.withColumn("node", F.substring(F.unhex(F.sha2("payload", 256)), 1, 16)), "tiles-vectors")
    nodes = save(packed.filter("payload is not null").groupBy("node", "payload").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")), "tiles-nodes")
    count, longest = nodes.agg(F.count(F.lit(1)), F.max(F.octet_length("payload"))).first()
    if not count:
        return packed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    size = max(1, min(SAMPLE, SAMPLE_BYTES // longest))
    sample = [bytes(r[0]) for r in nodes.orderBy("node").select("payload").limit(size).collect()]
    levels = max(0, min(CELLS.bit_length() - 1, ((count - 1) // PER_CELL).bit_length()))
    space = spark.sparkContext.broadcast(Space(kind, longest // width, sample, levels))
    kept = "node binary, payload binary, n long, least long, cell int"
    placed = save(nodes.mapInArrow(_placed(space), kept), "tiles-placed")

    box = placed.select("payload", "cell").mapInArrow(_boxes(space), "cell int, axis int, low double, high double")
    found = box.groupBy("cell", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("cell", "axis").collect()  # at most CELLS * (LEAD + 1) rows
    axes = 1 + max(r["axis"] for r in found)
    low, high = (np.array([r[k] for r in found]).reshape(-1, axes) for k in ("low", "high"))
    boxes = spark.sparkContext.broadcast((np.array([r["cell"] for r in found[::axes]], np.int32), low, high))
    visits = save(placed.select("node", "payload", "n", "cell").mapInArrow(_visits(space, boxes), "node binary, payload binary, n long, cell int, visits array<int>"), "tiles-visits")

    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias(name))
    guests = visits.select(*[F.col(c).alias(c) for c in ("node", "payload", "n")], F.col("cell").alias("home"), F.explode("visits").alias("cell"))
    sizes = F.broadcast(save(blocks(visits, "n_members").join(blocks(guests, "n_guests"), "cell"), "tiles-sizes"))  # at most CELLS rows
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = visits.join(sizes, "cell").select("cell", dealt("n_members").alias("i"), upto("n_guests").alias("j"), "node", "payload", "n", F.lit(True).alias("own"))
    guests = guests.join(sizes, "cell").select("cell", upto("n_members").alias("i"), dealt("n_guests").alias("j"), "node", "payload", "n", (F.col("home") == F.col("cell")).alias("own"))
    key = ("cell", "i", "j")
    work = members.groupBy(*key).cogroup(guests.groupBy(*key)).applyInArrow(_compared(space), "a binary, b binary, links long")
    work = save(work, "tiles-links")

    links = work.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    groups = components(work.filter("b is not null and a <> b").select("a", "b")).withColumnsRenamed({"id": "node", "component": "top"})
    facts = nodes.select("node", "n", "least").join(links, "node", "left").join(groups, "node", "left").withColumn("top", F.coalesce("top", "node"))
    facts = save(facts, "tiles-facts")
    least = facts.groupBy("top").agg(F.min("least").alias("component_id"))
    facts = facts.join(least, "top").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    lone = packed.filter("payload is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    done = packed.filter("payload is not null").select("vec_id", "node").join(facts, "node").select("vec_id", "n_links", "component_id").unionByName(lone)
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12(spark, sf_dir: str) -> DataFrame:
    """Query: links and groups of all embeddings, whatever their labels."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS x,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0, false) AS sound
  FROM embeddings
), l AS (
  SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON a.k <> b.k AND a.sound AND b.sound AND list_cosine_similarity(a.x, b.x) >= 0.9
), r AS (
  SELECT k, k AS other FROM v
  UNION
  SELECT r.k, l.b FROM r JOIN l ON l.a = r.other
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.k) AS n_links, c.component_id, v.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM v JOIN (SELECT r.k, min(o.vec_id) AS component_id FROM r JOIN v o ON o.k = r.other GROUP BY 1) c ON c.k = v.k
"""

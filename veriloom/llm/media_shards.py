"""Media columns: content-addressed payloads in tar shards.

Each text becomes a payload of bytes, stored without loss as a grey picture of 8-bit samples. A map task appends the
pictures of its rows to one tar shard in the folder that all executors share, each distinct picture once, and rows
carry only digest, shard, offset and length. A digest that several tasks met keeps one place, the first by name, so
that equal payloads have equal columns and are read once. Metadata columns come from range reads of the pictures'
headers; payload features come from a range read of the picture. A shard is named by what it holds and moved into
place when whole, so that a task that runs again, after an executor is lost, writes the same file again.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import save, shared_dir, small_batches

#: Payloads fill whole rows of so many samples.
WIDTH = 192
#: Fixed values of the picture format: first bytes, and the size of signature and header together.
SIGNATURE, HEADER = b"\x89PNG\r\n\x1a\n", 33
SHARD_BYTES, PART_BYTES = 64 << 20, 16 << 20


def payload(text: str | None) -> bytes:
    """UTF-8 bytes of a text, null being empty, with blanks up to a positive multiple of WIDTH."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % WIDTH or WIDTH * (not raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(data: bytes) -> bytes:
    """A grey 8-bit picture, WIDTH samples a row."""
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), dtype=np.uint8), rows], axis=1).tobytes()
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, 3)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits per sample and colour type, from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a picture of this store")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return width, height, depth, colour


def decode(media: bytes) -> bytes:
    """The samples of a picture."""
    width, height, _, _ = read_header(media[:HEADER])
    at, body = 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        part = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged picture")
        body += [part] * (kind == b"IDAT")
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not written by this store")
    return rows[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """Mean, spread and a 64-bit gradient hash of the samples, in whole numbers."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    mean = int(x.sum()) * 1000 // len(x)
    spread = int((x * x).sum()) * 1000 // len(x) - mean * mean // 1000
    edges = np.linspace(0, len(x), 66).astype(np.int64)
    sums = np.add.reduceat(x, edges[:-1])
    bits = "".join("1" if a * m < b * n else "0" for a, b, n, m in zip(sums[:-1].tolist(), sums[1:].tolist(), np.diff(edges)[:-1].tolist(), np.diff(edges)[1:].tolist(), strict=True))
    return f"m{mean}:v{spread}:g{int(bits, 2):016x}"


def _files(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class _Shard:
    """A tar file in the making; bounded by SHARD_BYTES and one picture more."""

    def __init__(self, root: str):
        self.root, self.out, self.places = root, io.BytesIO(), {}
        self.tar = tarfile.open(fileobj=self.out, mode="w", format=tarfile.USTAR_FORMAT)

    def add(self, digest: str, media: bytes) -> tuple[int, int]:
        if digest not in self.places:
            info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
            info.size = len(media)
            self.places[digest] = (self.tar.offset + 512, len(media))
            self.tar.addfile(info, io.BytesIO(media))
        return self.places[digest]

    def close(self) -> str:
        self.tar.close()
        name = hashlib.sha256("".join(self.places).encode()).hexdigest()[:32] + ".tar"
        files, root = _files(self.root)
        files.create_dir(root, recursive=True)
        part = f"{root}/.{name}.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as f:
            f.write(self.out.getbuffer())
        files.move(part, f"{root}/{name}")
        return name


def _store(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, rows = _Shard(root), []

        def flush() -> pd.DataFrame:
            name = shard.close() if shard.places else ""
            return pd.DataFrame([(*r[:2], name, *r[2:]) for r in rows], columns=["row", "digest", "shard", "offset", "length", "n_bytes"])

        for batch in batches:
            for key, text in zip(batch["row"], batch["text"], strict=True):
                media = encode(payload(text))
                digest = hashlib.sha256(media).hexdigest()
                rows.append((key, digest, *shard.add(digest, media), len((text or "").encode())))
                if shard.out.tell() > SHARD_BYTES:
                    yield flush()
                    shard, rows = _Shard(root), []
        if rows:
            yield flush()

    return run


def _read(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _files(root)
        name, f = None, None
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(batch["digest"], batch["shard"], batch["offset"], batch["length"], strict=True):
                if shard != name:
                    if f is not None:
                        f.close()
                    name, f = shard, files.open_input_file(f"{base}/{shard}")
                width, height, depth, colour = read_header(f.read_at(HEADER, offset))
                media = f.read_at(length, offset)
                data = decode(media)
                rows.append((digest, shard, offset, length, width, height, depth, colour, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), hashlib.sha256(media).hexdigest(), feature(data)))
            yield pd.DataFrame(rows, columns=["digest", "shard", "offset", "length", "width", "height", "depth", "colour", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"])
        if f is not None:
            f.close()

    return run


def media_columns(docs: DataFrame, root: str | None = None) -> DataFrame:
    """Stores the payload of every row under root and returns doc_id, n_bytes and the media columns.

    Null and empty texts have one payload of blanks. Repeated rows repeat; they share one stored payload. root
    defaults to a new folder under the shared one; what earlier calls stored under the same root stays valid.
    """
    small_batches(docs.sparkSession)
    root = root or f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").alias("row"), "text").mapInPandas(_store(root), f"row {docs.schema['doc_id'].dataType.simpleString()}, digest string, shard string, offset bigint, length bigint, n_bytes bigint")
    rows = save(rows, "media-rows")
    place = F.min(F.struct("shard", "offset", "length")).alias("at")
    places = rows.groupBy("digest").agg(place).select("digest", "at.*")
    # as many parts as there are PART_BYTES of pictures: rows are small, so that sizes of rows say nothing
    parts = max(1, -(-(rows.agg(F.sum("length")).first()[0] or 0) // PART_BYTES))
    read = places.repartition(int(parts), "shard").sortWithinPartitions("shard", "offset").mapInPandas(_read(root), "digest string, shard string, offset bigint, length bigint, width int, height int, depth int, colour int, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_sha256 string, feature string")
    return rows.select(F.col("row").alias("doc_id"), "digest", "n_bytes").join(read, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "digest", "shard", "offset", "width", "height", "depth", "colour")


def op7(spark, sf_dir: str) -> DataFrame:
    """Query: media columns of every document."""
    from veriloom.llm.common import table

    return media_columns(table(spark, sf_dir, "documents"))

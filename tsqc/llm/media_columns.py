"""Media columns: content-addressed payloads in tar shards.

Each text's bytes, padded with bytes 255 to a positive multiple of UNIT, are the 8-bit samples of a grey PNG image UNIT
samples wide. Each map task writes one tar shard in the shared folder with the images it meets, each digest once; rows
carry digest, shard, offset and length. Where several tasks wrote one digest, the first shard by name counts for all
rows. Images are read back by ranges: the header alone fills width and height, the whole range the features; without
features nothing but headers is read. Shards are opened by their URI, so the shared folder may be any store that pyarrow reads.

Defined results: a null text is empty, that is UNIT bytes 255; equal texts give equal values; an empty table gives an
empty table; only the id and the text are read from other columns. A lost executor's tasks write new shards: names are
never reused, and rows name the shard of the attempt that succeeded.
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
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsqc.llm.common import mapped, new_path, stored

UNIT = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # signature and IHDR chunk


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT or (UNIT if not data else 0))


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """8-bit grey, UNIT wide, no filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    raw = np.zeros((len(rows), UNIT + 1), np.uint8)
    raw[:, 1:] = rows
    return SIGNATURE + _part(b"IHDR", struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)) + _part(b"IDAT", zlib.compress(raw.tobytes(), level)) + _part(b"IEND", b"")


def header(data: bytes) -> tuple[int, int]:
    """Width and height from the first HEADER bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">II", data[16:24])


def from_png(data: bytes) -> bytes:
    width, height = header(data)
    at, parts = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += size + 12
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, and shares in per mille of 16 equal ranges of samples."""
    x = np.frombuffer(payload, np.uint8)
    shares = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"{x.mean():.4f}:" + ",".join(map(str, shares.tolist()))


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_shards(df: DataFrame, root: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, payload digest, and shard, offset and length of the image that its task wrote."""

    def put(batches):
        store, base = open_store(root)
        shard, out, known, at = f"{uuid.uuid4().hex}.tar", None, {}, 0
        try:
            for b in batches:
                rows: list[list] = [[], [], [], [], [], []]
                values = b.column(1).cast(pa.large_binary())
                for key, v in zip(b.column(0).to_pylist(), values):
                    data = v.as_py() or b""
                    payload = padded(data)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in known:
                        image = to_png(payload)
                        if out is None:
                            store.create_dir(base, recursive=True)
                            out = store.open_output_stream(f"{base}/{shard}")
                        info = tarfile.TarInfo(digest.hex() + ".png")
                        info.size = len(image)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head)
                        out.write(image)
                        out.write(b"\0" * (-len(image) % 512))
                        known[digest] = (at + len(head), len(image))
                        at += len(head) + len(image) + -len(image) % 512
                    for column, x in zip(rows, (key, len(data), digest, shard, *known[digest])):
                        column.append(x)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], ["doc_id", "n_bytes", "digest", "shard", "at", "length"])
            if out is not None:
                out.write(b"\0" * 1024)
        finally:
            if out is not None:
                out.close()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).transform(
        mapped, put, "doc_id long, n_bytes long, digest binary, shard string, at long, length long"
    )


class Shards:
    """Reads ranges of shards; one shard stays open."""

    def __init__(self, root: str):
        self.store, self.base = open_store(root)
        self.name, self.file = None, None

    def read(self, shard: str, at: int, length: int) -> bytes:
        if shard != self.name:
            self.close()
            self.name, self.file = shard, self.store.open_input_file(f"{self.base}/{shard}")
        return self.file.read_at(length, at)

    def close(self):
        if self.file is not None:
            self.file.close()
        self.name = self.file = None


def metadata(index: DataFrame, root: str) -> DataFrame:
    """Per row (digest, shard, at, length) of index: its place, width and height. HEADER bytes of each image are all that is read."""

    def get(batches: Iterator[pa.RecordBatch]):
        shards = Shards(root)
        for b in batches:
            sizes = [header(shards.read(shard, at, HEADER)) for shard, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            width, height = (pa.array([x[i] for x in sizes], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, width, height], ["digest", "shard", "offset", "length", "width", "height"])
        shards.close()

    return index.select("digest", "shard", "at", "length").transform(mapped, get, "digest binary, shard string, offset long, length long, width long, height long")


def read_back(index: DataFrame, root: str) -> DataFrame:
    """Per row (digest, shard, at, length) of index, put in the order of the shards: its place, the metadata from the image's
    header, and what its bytes give. Digests stay binary; digest is that of the bytes read."""

    def get(batches: Iterator[pa.RecordBatch]):
        shards = Shards(root)
        names = ["digest", "shard", "offset", "length", "width", "height", "payload_bytes", "tail_crc32", "media_bytes", "media_digest", "feature"]
        kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for digest, shard, at, length in zip(*(c.to_pylist() for c in b.columns)):
                width, height = header(shards.read(shard, at, HEADER))
                image = shards.read(shard, at, length)
                payload = from_png(image)
                sha = hashlib.sha256(payload).digest()
                if sha != digest:
                    raise ValueError(f"{shard} at {at} doesn't hold {digest.hex()}")
                row = (sha, shard, at, length, width, height, len(payload), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).digest(), feature(payload))
                for column, x in zip(rows, row):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names)
        shards.close()

    return index.select("digest", "shard", "at", "length").transform(
        mapped, get,
        "digest binary, shard string, offset long, length long, width long, height long, payload_bytes long, tail_crc32 long, media_bytes long, media_digest binary, feature string",
    )


def media_columns(df: DataFrame, root: str | None = None, doc_id: str = "doc_id", text: str = "text", features: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, payload_sha256, digest, shard, offset, length, width, height; with features also what read_back gives."""
    spark = df.sparkSession
    root = root or new_path(spark, "media")
    rows = stored(write_shards(df, root, doc_id, text), "media_rows")
    first = rows.groupBy("digest").agg(F.min(F.struct("shard", "at", "length")).alias("x")).select("digest", "x.*")
    # Ranges in order within each task: a shard is read through, not sought through.
    read = read_back if features else metadata
    found = stored(read(first.repartitionByRange("shard", "at").sortWithinPartitions("shard", "at"), root), "media_found")
    hexed = {"payload_sha256": "digest", "media_sha256": "media_digest"} if features else {"payload_sha256": "digest"}
    out = rows.select("doc_id", "n_bytes", "digest").join(found, "digest")
    return out.withColumns({name: F.lower(F.hex(c)) for name, c in hexed.items()}).drop("media_digest")

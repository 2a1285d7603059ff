"""Shared helpers: tables on the shared folder, and text hashing in numpy."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text bytes handled at once in a Python worker; only a longer document exceeds it.
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch, for sessions that set none; only a longer document exceeds it.
BATCH_BYTES = "8m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MAP_BITS = 27
_OWN: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, as in tests, a temporary one, which only
    a local session may use: other machines could not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="tsqc-"))
    return _OWN[0]


def remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tsqc/{name}-{uuid.uuid4().hex}"

    def end():
        try:
            remove(spark, path)
        except Exception:  # the session has ended
            pass

    atexit.register(end)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage; the shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


class Bitmap:
    """Which leading bits of hashes there are: none is missed, few others are taken."""

    def __init__(self, bits: int, at: np.ndarray, word: np.ndarray):
        self.shift = U64(64 - bits)
        self.words = np.zeros(max(1, (1 << bits) >> 6), U64)
        self.words[at] = word.view(U64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(U64) >> self.shift
        return (self.words[at >> U64(6)] >> (at & U64(63))) & U64(1) > 0


def bitmap(df: DataFrame, name: str) -> Broadcast:
    """A broadcast Bitmap of a column of hashes, of at most 1 << MAP_BITS bits: 16 MB on the driver and each executor. What it
    lets through must be joined exactly."""
    bits = min(MAP_BITS, max(10, (16 * df.count()).bit_length()))
    at = df.selectExpr(f"shiftrightunsigned(`{name}`, {64 - bits}) AS at")
    found = at.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")).toArrow()
    return df.sparkSession.sparkContext.broadcast(Bitmap(bits, found.column(0).to_numpy(), found.column(1).to_numpy()))


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over batches bounded by bytes; a worker gives its free memory back after each task, as it is used again."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) is None:
        conf.set(_BATCH_SETTING, BATCH_BYTES)

    names = df.columns
    odd = any(x in c for c in names for x in ".`")  # mapInArrow would look for a field of a column
    if odd:
        df = df.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches):
        yield from f((b.rename_columns(names) for b in batches) if odd else batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return df.mapInArrow(run, schema)


def partitions(df: DataFrame) -> int:
    """Shuffle partitions that follow the size of the input files."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores put before it until no column has it."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name = "_" + name
    return name


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_codes(seed: int) -> np.ndarray:
    """A pseudo-random 64-bit code for each byte value."""
    return splitmix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            step = np.full(size, U64(b))
            step[0] = 1
            both.append(np.multiply.accumulate(step))
        have = (both[0], both[1])
        if n <= CHUNK_BYTES + (1 << 16):
            _POWERS[base] = have
    return have


class Rolling:
    """Polynomial hashes modulo 2**64, over random byte codes, of any stretch of a byte array."""

    BASE = 0x9E3779B97F4A7C55 | 1

    def __init__(self, data: np.ndarray, seed: int = 1, base: int = BASE):
        power, self.inverse = powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(byte_codes(seed)[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return splitmix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64))

    def windows(self, size: int) -> np.ndarray:
        """Of data[i:i + size] for each i."""
        n = len(self.sums) - size
        return splitmix((self.sums[size:] - self.sums[:-size]) * self.inverse[:n]) if n > 0 else np.zeros(0, U64)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) in runs of about limit bytes; a null text is empty."""
    values = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    run: list[bytes] = []
    first = size = 0
    for i, v in enumerate(values.to_pylist()):
        v = v or b""
        if run and size + len(v) > limit:
            yield first, run
            run, first, size = [], i, 0
        run.append(v)
        size += len(v)
    if run:
        yield first, run


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with a line end after each text; start and end of each word [^\\x20\\x09-\\x0D]+; and the number of its text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = LOWER[data]
    edge = np.diff(~SPACE[data], prepend=False)
    at = np.flatnonzero(edge)
    start, end = at[::2], at[1::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return data, start, end, np.searchsorted(ends, start, "right")

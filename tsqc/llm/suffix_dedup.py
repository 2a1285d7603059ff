"""Suffix-array dedup: removes each byte that a LENGTH-byte string covers which also starts earlier in the corpus.

The index holds suffixes at content-defined anchors only: of every LENGTH-byte window the k-mer with the least code (the
leftmost of equals) is its anchor, so equal windows have equal anchors at equal distances. All windows that share an
anchor make one entry: the fingerprint of the anchor's k-mer, then the fingerprint of the whole block around it. A batch's entries
in the order of these two are its sparse suffix array. Arrays form a logarithmic family: a new one is level 0, two levels
of about one size are merge-scanned and become one of twice the size. The scan of two orders finds, side by side,

* entries equal in both fingerprints: all windows of the later one start earlier too;
* entries equal in the first only: their blocks part somewhere within reach of the anchor. If one side of the anchor is
  still equal as far as some common window needs, their windows are entered one by one, by the fingerprint of the window, into a second family, where equal neighbours again tell the later ones.

Entries travel packed, to the task that owns their first fingerprint; what a batch finds within itself is settled before
anything is sent, so a passage sends one entry per batch and different block, however often it repeats. Every decision rests on two fingerprints, of 128
bits together, or 96 for single windows. Earlier means a smaller id, or an earlier start in the same text.

Defined results: a null text is empty; a text shorter than LENGTH loses nothing; rows of one id and text are one document, so
a repeated row is no copy of itself; different texts under one id, or without an id, are documents of their own, in the order
of a hash of the text; a null id comes before all others; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsqc.llm.common import Rolling, bitmap, column, mapped, partitions, splitmix, stored

U64 = np.uint64
LENGTH = 100
K = 40
#: A longer text is cut into parts of so many bytes, which overlap by LENGTH - 1.
PART = 4 << 20
#: Bits of a position among the bytes that blocks() is given at once: LOOK + PART + LENGTH at most.
PLACE = 24
#: Entries that a task gathers before it sends them, and bytes it looks at together.
FLUSH = 1_000_000
LOOK = 1 << 20
ENTRY = np.dtype([("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "<u4"), ("left", "<u2"), ("right", "<u2")])
NOTE = np.dtype([("doc", "<i8"), ("at", "<u4"), ("n", "<u4"), ("ask", "u1")])  # windows at, at + 1, ... of doc; ask: to be entered one by one
OUT = "kind int, bucket int, blob binary"


def blocks(parts: list[tuple[int, int, bytes]], length: int, k: int) -> np.ndarray:
    """Entries of (doc, offset, bytes) parts, each with its block's first window and number of windows."""
    parts = [p for p in parts if len(p[2]) >= length]
    if not parts:
        return np.zeros(0, ENTRY)
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    if len(data) > 1 << PLACE:
        raise ValueError(f"{len(data)} bytes at once, of which only {1 << PLACE} have positions")
    size = np.array([len(p[2]) for p in parts])
    begin = np.cumsum(size) - size
    rolling = Rolling(data, seed=3)
    code = rolling.windows(k)
    low = U64((1 << PLACE) - 1)
    least = (code & ~low) | np.arange(len(code), dtype=U64)
    span, want = 1, length - k + 1
    while span * 2 <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
    live = size - length + 1
    first = np.cumsum(live) - live
    window = np.arange(int(live.sum())) + np.repeat(begin - first, live)
    anchor = (least[window] & low).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[first] = True
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(window)))
    start, mid = window[at], anchor[at]
    out = np.zeros(len(at), ENTRY)
    # A window holds the k-mer and half the rest on one side at least. Codes of these halves, where a window of the block has them.
    half = (length - k) // 2
    side = Rolling(data, seed=8)
    has = mid - start >= half
    out["left"][has] = side.of(mid[has] - half, mid[has]) % U64(65535) + U64(1)
    has = start + n - 1 + length - mid - k >= half
    out["right"][has] = side.of(mid[has] + k, mid[has] + k + half) % U64(65535) + U64(1)
    owner = np.repeat(np.arange(len(parts)), live)[at]
    out["one"] = code[mid]
    out["two"] = splitmix(Rolling(data, seed=4).of(start, start + n + (length - 1)) + (mid - start).astype(U64) * U64(0x9E3779B97F4A7C15))
    out["doc"] = np.array([p[0] for p in parts])[owner]
    out["at"] = start - begin[owner] + np.array([p[1] for p in parts])[owner]
    out["n"] = n
    return out


def ordered(e: np.ndarray) -> np.ndarray:
    return e[np.lexsort((e["at"], e["doc"], e["two"], e["one"]))]


def note(e: np.ndarray, ask: bool) -> np.ndarray:
    out = np.zeros(len(e), NOTE)
    for x in ("doc", "at", "n"):
        out[x] = e[x]
    out["ask"] = ask
    return out


class Levels:
    """The logarithmic family. add() returns notes of entries that are found later than equal ones; those leave the index."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    @staticmethod
    def scan(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of equal entries in the order, and notes of the others. The same window entered twice is no copy."""
        same = np.zeros(len(e), bool)
        same[1:] = (e["one"][1:] == e["one"][:-1]) & (e["two"][1:] == e["two"][:-1])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(e)))) if len(e) else np.zeros(0, np.int64)
        again = (e["doc"] == e["doc"][lead]) & (e["at"] == e["at"][lead])
        return e[~same], note(e[same & ~again], False)

    def add(self, batch: np.ndarray) -> np.ndarray:
        new, found = self.scan(ordered(batch))
        notes = [found]
        while self.levels and len(self.levels[-1]) <= 2 * len(new):
            new, found = self.scan(ordered(np.concatenate((self.levels.pop(), new))))
            notes.append(found)
        self.levels.append(new)
        return np.concatenate(notes)

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """One array of all levels, and the notes of its last scan."""
        new, found = self.scan(ordered(np.concatenate([np.zeros(0, ENTRY), *self.levels])))
        self.levels = [new]
        return new, found


def parted(e: np.ndarray) -> np.ndarray:
    """Entries of an array without equals that have the k-mer and one of the halves beside it in common with another; only
    these can have a window in common."""
    more = np.zeros(len(e), bool)
    for side in ("left", "right"):
        order = np.lexsort((e[side], e["one"]))
        same = (e["one"][order][1:] == e["one"][order][:-1]) & (e[side][order][1:] == e[side][order][:-1]) & (e[side][order][1:] > 0)
        more[order[1:][same]] = True
        more[order[:-1][same]] = True
    return e[more]


def _batch(kind: int, to: np.ndarray, rows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """rows, packed by the bucket that each goes to."""
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    cut = np.searchsorted(to, np.arange(buckets + 1))
    live = np.flatnonzero(np.diff(cut))
    if len(live):
        blobs = [rows[cut[i] : cut[i + 1]].tobytes() for i in live]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(live), kind, np.int32)), pa.array(live.astype(np.int32)), pa.array(blobs, pa.binary())], ["kind", "bucket", "blob"])


def _home(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (splitmix(doc.astype(np.int64).view(U64) + U64(9)) % U64(buckets)).astype(np.int64)


def _post(notes: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: notes on their way to their documents. Neighbouring windows become one note."""
    if len(notes):
        notes = notes[np.lexsort((notes["at"], notes["doc"], notes["ask"]))]
        join = np.zeros(len(notes), bool)
        join[1:] = (notes["ask"][1:] == notes["ask"][:-1]) & (notes["doc"][1:] == notes["doc"][:-1]) & (notes["at"][1:].astype(np.int64) == notes["at"][:-1].astype(np.int64) + notes["n"][:-1])
        at = np.flatnonzero(~join)
        total = np.add.reduceat(notes["n"], at)
        notes = notes[at]
        notes["n"] = total
        yield from _batch(0, _home(notes["doc"], buckets), notes, buckets)


def _send(found: Iterator[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Kind 1: entries on their way to the owner of their first fingerprint."""
    held, n = [], 0

    def flush():
        levels = Levels()
        for e in held:
            yield from _post(levels.add(e), buckets)
        e, notes = levels.finish()
        yield from _post(notes, buckets)
        yield from _batch(1, (e["one"] % U64(buckets)).astype(np.int64), e, buckets)

    for e in found:
        held.append(e)
        n += len(e)
        if n >= FLUSH:
            yield from flush()
            held, n = [], 0
    if held:
        yield from flush()


def _meet(batches: Iterator[pa.RecordBatch], buckets: int, ask: bool) -> Iterator[pa.RecordBatch]:
    """The families of the fingerprints that this task owns. Notes go through."""
    levels, small, n = Levels(), [], 0

    def take():
        yield from _post(levels.add(np.concatenate(small)), buckets)

    for b in batches:
        kind = b.column(0).to_numpy()
        if (kind == 0).any():
            yield b.filter(pa.array(kind == 0))
        for blob in b.column(2).filter(pa.array(kind == 1)).to_pylist():
            small.append(np.frombuffer(blob, ENTRY))
            n += len(small[-1])
            if n >= 1 << 16:
                yield from take()
                small, n = [], 0
    if small:
        yield from take()
    e, notes = levels.finish()
    yield from _post(notes, buckets)
    if ask:
        yield from _post(note(parted(e), True), buckets)


def _with_notes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[int, np.ndarray]]]:
    """Batches of documents with the notes of their bucket; in each bucket notes come first."""
    bucket, blobs, notes = None, [], None
    for b in batches:
        kind, at = b.column(0).to_numpy(), b.column(1).to_numpy()
        cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(kind)]):
            if lo == hi:
                continue
            if at[lo] != bucket:
                bucket, blobs, notes = at[lo], [], None
            part = b.slice(lo, hi - lo)
            if kind[lo] == 0:
                blobs += part.column(2).to_pylist()
                continue
            if notes is None:
                every = np.frombuffer(b"".join(blobs), NOTE)
                every = every[np.argsort(every["doc"], kind="stable")]
                names, first = np.unique(every["doc"], return_index=True)
                notes = dict(zip(names.tolist(), np.split(every, first[1:]))) if len(names) else {}
            yield part, notes


def _windows(batches: Iterator[pa.RecordBatch], buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    def found():
        for b, notes in _with_notes(batches):
            for doc, text in zip(b.column(3).to_pylist(), b.column(4).cast(pa.large_binary())):
                mine = notes.get(doc)
                if mine is None:
                    continue
                mine = mine[mine["ask"] == 1]
                if not len(mine):
                    continue
                data = np.frombuffer(text.as_py() or b"", np.uint8)
                at = np.concatenate([np.arange(a, a + n) for a, n in zip(mine["at"].tolist(), mine["n"].tolist())])
                at = at[at + length <= len(data)]
                e = np.zeros(len(at), ENTRY)
                e["one"] = Rolling(data, seed=5).of(at, at + length)
                e["two"] = Rolling(data, seed=6, base=0xD1342543DE82EF95).of(at, at + length) & U64(0xFFFFFFFF)  # 96 bits in all
                e["doc"], e["at"], e["n"] = doc, at, 1
                yield e

    return _send(_gathered(found()), buckets)


def _gathered(found: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    held, n = [], 0
    for e in found:
        held.append(e)
        n += len(e)
        if n >= 1 << 16:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _results(ids: list[int], texts: pa.Array, notes: dict[int, np.ndarray], length: int) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
    rows: list[list] = [[] for _ in kinds]
    for doc, text in zip(ids, texts.cast(pa.large_binary())):
        data = text.as_py() or b""
        mine = notes.get(doc)
        spans: list[tuple[int, int]] = []
        if mine is not None:
            mine = mine[mine["ask"] == 0]
            step = np.zeros(len(data) + 1, np.int32)
            start = mine["at"].astype(np.int64)
            end = start + mine["n"].astype(np.int64) + (length - 1)
            inside = end <= len(data)
            np.add.at(step, start[inside], 1)
            np.add.at(step, end[inside], -1)
            covered = np.cumsum(step[:-1]) > 0
            edge = np.flatnonzero(np.diff(covered, prepend=False, append=False))
            spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        kept, at = [], 0
        for s, e in spans:
            kept.append(data[at:s])
            at = e
        kept.append(data[at:])
        row = (doc, len(data), sum(e - s for s, e in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": s, "end": e} for s, e in spans])
        for column, x in zip(rows, row):
            column.append(x)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b, notes in _with_notes(batches):
        yield _results(b.column(3).to_pylist(), b.column(4), notes, length)


def _noted(notes: DataFrame, ask: bool, name: str) -> Broadcast:
    """Which documents have notes (with ask, such notes): a Bitmap of hashes of their ids, which lets a few others through."""

    def run(batches):
        for b in batches:
            n = np.frombuffer(b"".join(b.column(0).to_pylist()), NOTE)
            yield pa.RecordBatch.from_arrays([pa.array(splitmix(np.unique(n["doc"][n["ask"] == 1] if ask else n["doc"]).view(U64)).view(np.int64))], ["id"])

    return bitmap(stored(notes.filter("kind = 0").select("blob").transform(mapped, run, "id long").distinct(), name), "id")


def _named(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows (id, text) whose ids are in the documents' order and differ where documents do. Where ids alone don't, also the
    table (id, own) of what stands for them."""
    own = df.select(column(doc_id).cast("long").alias("own"), column(text).cast("string").alias("text"))
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    ids = own.groupBy("own").agg(F.min(mark).alias("a"), F.max(mark).alias("b"))
    if ids.filter("own IS NULL OR a != b").isEmpty():
        return own.withColumnRenamed("own", "id"), None
    ranks = own.select("own", mark.alias("mark")).distinct().orderBy(F.asc_nulls_first("own"), "mark").withColumn("id", F.monotonically_increasing_id())
    ranks = stored(ranks, "ranks")
    rows = own.withColumn("mark", mark).alias("r").join(ranks.alias("k"), F.expr("r.own <=> k.own AND r.mark = k.mark"))
    return stored(rows.select("k.id", "r.text"), "named"), ranks.select("id", "own")


def dedup(df: DataFrame, length: int = LENGTH, k: int = K, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the spans removed."""
    documents, names = _named(df, doc_id, text)
    buckets = partitions(df)

    def index(batches):
        def found():
            for b in batches:
                held, n = [], 0
                for doc, value in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())):
                    data = value.as_py() or b""
                    for at in range(0, max(1, len(data) - length + 1), PART):
                        part = data[at : at + PART + length - 1]
                        held.append((doc, at, part))
                        n += len(part)
                        if n >= LOOK:
                            yield blocks(held, length, k)
                            held, n = [], 0
                if held:
                    yield blocks(held, length, k)

        return _send(found(), buckets)

    joined = "kind int, bucket int, blob binary, id long, text string"

    def meeting(notes: DataFrame, wanted: Broadcast) -> DataFrame:
        """Documents that have such notes, after the notes on them."""

        def addressed(batches):
            for b in batches:
                b = b.filter(pa.array(wanted.value.holds(splitmix(b.column(0).to_numpy().view(U64)))))
                n = len(b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(n, np.int32)), pa.array(_home(b.column(0).to_numpy(), buckets).astype(np.int32)), pa.nulls(n, pa.binary()), b.column(0), b.column(1)], ["kind", "bucket", "blob", "id", "text"]
                )

        both = notes.filter("kind = 0").unionByName(documents.transform(mapped, addressed, joined), allowMissingColumns=True)
        return both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")

    notes = stored(documents.transform(mapped, index, OUT).repartition(buckets, "bucket").transform(mapped, lambda it: _meet(it, buckets, True), OUT), "notes")
    entered = meeting(notes, _noted(notes, True, "asked")).transform(mapped, lambda it: _windows(it, buckets, length), OUT)
    single = stored(entered.repartition(buckets, "bucket").transform(mapped, lambda it: _meet(it, buckets, False), OUT), "single")
    every = notes.unionByName(single)
    noted = _noted(every, False, "noted")
    out = meeting(every, noted).transform(mapped, lambda it: _cut(it, length), RESULT)

    def quiet(batches):
        for b in batches:
            b = b.filter(pa.array(~noted.value.holds(splitmix(b.column(0).to_numpy().view(U64)))))
            yield _results(b.column(0).to_pylist(), b.column(1), {}, length)

    out = out.unionByName(documents.transform(mapped, quiet, RESULT))
    if names is None:
        return out
    return out.withColumnRenamed("doc_id", "id").join(names, "id").select(F.col("own").alias("doc_id"), *(c for c in out.columns if c != "doc_id"))


#: dedup() in DuckDB's SQL, for ids that differ.
ORACLE = """
WITH d AS (SELECT doc_id, octet_length(encode(coalesce("text", ''))) AS n, lower(hex(encode(coalesce("text", '')))) AS h FROM documents
), w AS (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM d
), k AS (SELECT doc_id, s, md5_number(substr(h, CAST(2 * s + 1 AS BIGINT), 200)) AS x FROM w
), later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS r FROM k) WHERE r > 1
), starts AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM later
), runs AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM starts
), spans AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM runs GROUP BY doc_id, run
), ends AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, n, n FROM d
), pieces AS (SELECT e.doc_id, e.a, e.b, substr(d.h, CAST(2 * coalesce(lag(e.b) OVER p, 0) + 1 AS BIGINT), CAST(2 * (e.a - coalesce(lag(e.b) OVER p, 0)) AS BIGINT)) AS piece
  FROM ends e JOIN d ON d.doc_id = e.doc_id WINDOW p AS (PARTITION BY e.doc_id ORDER BY e.a, e.b)
)
SELECT p.doc_id, CAST(any_value(d.n) AS BIGINT) AS n_bytes, CAST(sum(p.b - p.a) AS BIGINT) AS n_removed, CAST(count(*) FILTER (WHERE p.b > p.a) AS BIGINT) AS n_spans,
  sha256(unhex(string_agg(piece, '' ORDER BY p.a, p.b))) AS kept_sha256
FROM pieces p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id"""

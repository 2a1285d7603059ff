"""Packing: minimum bin slack over a histogram of remaining lengths.

Each document's ids, ended by id 0, are cut into full windows and one rest shorter than a window. Only the histogram of
rests (at most `capacity` counts) comes to the driver. There each pattern takes the longest length left and the multiset
of others that fills the window best, found by subset sums in a bitset and traced back to counts, and is applied as often
as the counts allow. A rest finds its place by its rank within its length; ranks come from counts by (length, bucket), and
each task deals its pieces to the buckets in turn, so no length is ever ranked in one task, nor are rows alike in all columns.

Defined results: a null or empty text is the single id 0; repeated rows are packed each for itself; an empty table gives
no rows; other columns do not matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsqc.llm.common import mapped, partitions, stored
from tsqc.llm.tokens import encoder

#: Parts into which each length is dealt for ranking, at least; with more partitions of input there are as many parts.
RANK_BUCKETS = 256


def best_fill(counts: dict[int, int], target: int, top: int) -> dict[int, int]:
    """The multiset within counts, with at least one of top, whose sum is as close below target as can be."""
    room = target - top
    left = dict(counts)
    left[top] -= 1
    mask = (1 << (room + 1)) - 1
    items, states, reach = [], [], 1
    for length in sorted(left, reverse=True):
        n, k = min(left[length], room // length) if length <= room else 0, 1
        while n > 0:
            k_now = min(k, n)
            items.append((length, k_now))
            states.append(reach)
            reach |= (reach << (length * k_now)) & mask
            n, k = n - k_now, k * 2
        if reach >> room & 1:
            break
    want = reach.bit_length() - 1
    used = {top: 1}
    for (length, k), before in zip(reversed(items), reversed(states)):
        if not before >> want & 1:
            want -= length * k
            used[length] = used.get(length, 0) + k
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(multiset, times) until all counts are used."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        top = max(left)
        used = best_fill(left, capacity, top)
        times = min(left[k] // n for k, n in used.items())
        out.append((used, times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def placement(patterns: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, runs (first rank, first sequence, offset of the first in its window, how many in a window)."""
    taken: dict[int, int] = {}
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for used, times in patterns:
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            places.setdefault(length, []).append((taken.get(length, 0), sequence, offset, n))
            taken[length] = taken.get(length, 0) + n * times
            offset += length * n
        sequence += times
    return places


def cut(df: DataFrame, json_path: str, rank_path: str, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, and bucket, in which it is ranked."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket long"
    buckets = max(RANK_BUCKETS, partitions(df))

    def pieces(batches):
        enc = encoder(json_path, rank_path)
        turn = TaskContext.get().partitionId() * 7919  # short tasks begin at different buckets
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(texts), 512):
                rows: list[list[int]] = [[], [], [], [], []]
                for key, ids in zip(keys[lo : lo + 512], enc.encode([t or "" for t in texts[lo : lo + 512]])):
                    ids = np.append(ids, np.uint32(0)).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        part = ids[start : start + capacity]
                        for column, v in zip(rows, (key, start, len(part), zlib.crc32(part), len(ids))):
                            column.append(v)
                n = len(rows[0])
                bucket = pa.array((turn + np.arange(n)) % buckets)
                turn += n
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in rows), bucket], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).transform(mapped, pieces, schema)


def pack(df: DataFrame, json_path: str, rank_path: str, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = stored(cut(df, json_path, rank_path, capacity, doc_id, text), "pieces")
    whole = pieces.filter(F.col("length") == capacity)
    rest = pieces.filter(F.col("length") < capacity)
    counts = rest.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns = plan(histogram, capacity)
    places = placement(patterns)
    sequences = sum(times for _, times in patterns)
    shared = df.sparkSession.sparkContext.broadcast(places)
    ranked = rest.join(before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["length", "bucket"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "ids_crc32", "start")) - 1
    )
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches):
        runs = shared.value
        firsts = {k: [r[0] for r in v] for k, v in runs.items()}
        for b in batches:
            sequence, offset = [], []
            for length, rank in zip(b.column(2).to_pylist(), b.column(5).to_pylist()):
                first, seq, at, n = runs[length][bisect_right(firsts[length], rank) - 1]
                sequence.append(seq + (rank - first) // n)
                offset.append(at + (rank - first) % n * length)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    placed = ranked.select(*names, "rank").transform(mapped, place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    full = whole.select(*names, (F.monotonically_increasing_id() + F.lit(sequences)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)

"""N-gram Jaccard join with a count-vector R-tree.

Shingles are 64-bit hashes, and a set of shingles goes by the 64-bit sum of its hashed shingles, so equal sets are one from
the start. Then, in this order:

* Routing. Two linked sets differ in at most d shingles, so of more than d groups of shingles some are equal in both. Each
  different set sends one signature per group (and size class) to the task of that signature. Sets under one signature become
  pairs (hub, member), the hub being the least set among them: linear in the members, and few, as crowds have few hubs.
* Index. Group counts of the sets are points, of more groups for larger sets. The points of a hub's members meet in one task,
  as R-trees whose boxes, then points, bound the overlap by summed coordinate minima. Members that surviving pairs hold together
  make a crowd, called by its least set, whichever hubs it was found under; all others are done with.
* Verification. The sets of a crowd meet in one task and surviving pairs are verified, the likeliest partner first, and none
  within a component already joined. A task gives one row per member that it joined, not one per pair.

Hubs and crowds of over BLOCK shingles are split into blocks that meet two at a time, so a task's memory is bounded.
Every two linked sets share a signature, so a hub, so a crowd; all links between components are found. Similarities are
of 50 percent or more.

Defined results: a text with fewer words than a shingle is one shingle, the whole sequence; a null text or one without words
has no shingle and no links; equal sets are linked; every row is a document of its own, also under a repeated or null id; a
component's id is the least id in it that isn't null (null if there is none); an empty table gives no rows; other columns do
not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsqc.llm.common import Rolling, bitmap, chunks, column, mapped, partitions, splitmix, stored, words
from tsqc.llm.graph import components

U64 = np.uint64
MOST = 0xFF
#: Groups of a point: the least power of two, of LEAST_DIMS to MOST_DIMS, that leaves up to 4 shingles for each.
LEAST_DIMS = 64
MOST_DIMS = 1 << 16
LEAF = 64  # points of a leaf of the R-tree
FAN = 16
#: Signatures that a task gathers before it sends them.
FLUSH = 1_000_000
#: Shingles of the sets that meet in one task under one hub or crowd; with more, blocks of them meet two at a time.
BLOCK = 1 << 19


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each different shingle, ordered by both."""
    data, start, end, doc = words(texts, lower=True)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    word = Rolling(data, seed=10).of(start, end)
    n = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    m = len(word) - k + 1
    h = np.zeros(max(m, 0), U64)
    for j in range(k) if m > 0 else ():
        h = h * U64(0x9E3779B97F4A7C15) + word[j : j + m]
    inside = doc[: max(m, 0)] == doc[k - 1 :][: max(m, 0)]
    d, s = doc[: max(m, 0)][inside], splitmix(h[inside] + U64(k))
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        short = np.zeros(len(few), U64)
        for j in range(k - 1):
            has = n[few] > j
            short[has] = short[has] * U64(0x9E3779B97F4A7C15) + word[first[few[has]] + j]
        d, s = np.concatenate((d, few)), np.concatenate((s, splitmix(short + n[few].astype(U64) * U64(0xC2B2AE3D27D4EB4F))))
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return d[keep], s[keep]


class Classes:
    """Size classes for a similarity of pct percent: a set can only be linked within its class or a neighbouring one."""

    def __init__(self, pct: int):
        self.pct = pct
        low = [1]
        while low[-1] < 1 << 40:
            low.append(low[-1] * 100 // pct + 1)
        self.low = np.array(low)
        top = self.low[1:] - 1
        both = top + top * 100 // pct
        self.differ = both * (100 - pct) // (100 + pct)  # shingles in one of the two sets only, at most
        self.groups = self.differ + 1 + (self.differ * 12 + 99) // 100

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, pct: int) -> np.ndarray:
    return 100 * common >= pct * (a + b - common)


def signatures(doc: np.ndarray, shingle: np.ndarray, n: np.ndarray, cls: Classes) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) for both spaces of each set."""
    sigs, docs = [], []
    own = cls.of(np.maximum(n, 1))
    for back in (0, 1):
        space = own - back
        live = (n > 0) & (space >= 0)
        groups = np.where(live, cls.groups[np.maximum(space, 0)], 0)
        base = np.cumsum(groups) - groups
        use = live[doc]
        d, s = doc[use], shingle[use]
        seed = splitmix(space[d].astype(U64) + U64(77))
        g = (splitmix(s ^ seed) % groups[d].astype(U64)).astype(np.int64)
        cell = base[d] + g
        total = int(groups.sum())
        order = np.argsort(cell, kind="stable")
        cell, value = cell[order], splitmix(s[order] + U64(0x51ED27))
        at = np.flatnonzero(np.diff(cell, prepend=-1))
        if not len(at):
            continue
        full, sums = cell[at], np.add.reduceat(value, at)
        of = d[order][at]
        # A set with so many empty groups that only these might be equal in a linked pair sends them too.
        empty = groups - np.bincount(of, minlength=len(n))
        odd = np.flatnonzero(live & (empty >= groups - cls.differ[np.maximum(space, 0)]))
        if len(odd):
            hole = np.ones(total, bool)
            hole[full] = False
            more = np.concatenate([base[i] + np.flatnonzero(hole[base[i] : base[i] + groups[i]]) for i in odd])
            full, sums = np.concatenate((full, more)), np.concatenate((sums, np.zeros(len(more), U64)))
            of = np.concatenate((of, np.repeat(odd, empty[odd])))
        g = (full - base[of]).astype(U64)
        sigs.append(splitmix(sums + splitmix(g * U64(0x9E3779B97F4A7C15) + space[of].astype(U64) * U64(0xD6E8FEB86659FD93))))
        docs.append(of)
    if not sigs:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(docs)


def identities(doc: np.ndarray, shingle: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64 bits for each set, whatever the order of its shingles."""
    sums = np.zeros(len(n) + 1, U64)
    np.add.at(sums, doc, splitmix(shingle + U64(0x2545F4914F6CDD1D))) if len(doc) else None
    return splitmix(sums[:-1] + n.astype(U64) * U64(0x9E3779B97F4A7C15))


def points(doc: np.ndarray, shingle: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Group counts of each set, cut off at MOST."""
    dims = np.minimum(MOST_DIMS, np.maximum(LEAST_DIMS, 1 << np.ceil(np.log2(np.maximum(n, 1) / 4)).clip(0).astype(np.int64)))
    end = np.cumsum(dims)
    cell = (end - dims)[doc] + (splitmix(shingle + U64(5)) & (dims[doc] - 1).astype(U64)).astype(np.int64)
    return np.split(np.minimum(np.bincount(cell, minlength=int(dims.sum())), MOST).astype(np.uint8), end[:-1])


def hubs(sig: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs (least set under a signature, another set under it)."""
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    hub = own[np.flatnonzero(first)][np.cumsum(first) - 1]
    rest = own != hub
    pair = np.unique(np.stack((hub[rest], own[rest]), 1), axis=0)
    return pair[:, 0], pair[:, 1]


SENT = "kind int, bucket int, id long, row long, n long, set long, blob binary"
MET = "kind int, id long, row long, n long, set long, hub long, point binary"


def _batch(schema: str, rows: int, **columns) -> pa.RecordBatch:
    """A batch of the columns given; the others are null."""
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    made = [pa.array(columns[x], types[t]) if x in columns else pa.nulls(rows, types[t]) for x, t in names]
    return pa.RecordBatch.from_arrays(made, [x for x, _ in names])


def _send(batches: Iterator[pa.RecordBatch], k: int, pct: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: a document with its set. Kind 1: a set with its point. Kind 2: packed signatures and their sets, for a bucket."""
    cls = Classes(pct)
    sigs: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    sent: set[int] = set()

    def flush():
        sig, own = np.concatenate(sigs), np.concatenate(owners)
        sigs.clear()
        owners.clear()
        sent.clear()
        to = (sig % U64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        sig, own, to = sig[order], own[order], to[order]
        cut = np.searchsorted(to, np.arange(buckets + 1))
        live = np.flatnonzero(np.diff(cut))
        packed = [np.concatenate((sig[cut[i] : cut[i + 1]], own[cut[i] : cut[i + 1]])).tobytes() for i in live]
        if len(live):
            yield _batch(SENT, len(live), kind=np.full(len(live), 2), bucket=live, blob=packed)

    for batch in batches:
        for first, texts in chunks(batch, "text"):
            doc, shingle = shingle_sets(texts, k)
            n = np.bincount(doc, minlength=len(texts))
            own = identities(doc, shingle, n)
            row = batch.column(1).slice(first, len(texts))
            where = (splitmix(row.to_numpy().view(U64)) % U64(buckets)).astype(np.int32)
            yield _batch(SENT, len(texts), kind=np.zeros(len(texts), np.int32), bucket=where, id=batch.column(0).slice(first, len(texts)), row=row, n=n, set=own.view(np.int64))
            new = (n > 0) & np.array([x not in sent and not sent.add(x) for x in own.tolist()], bool)
            made = [x.tobytes() for x, y in zip(points(doc, shingle, n), new) if y]
            yield _batch(SENT, len(made), kind=np.ones(len(made), np.int32), bucket=where[new], n=n[new], set=own[new].view(np.int64), blob=made)
            sig, of = signatures(doc, shingle, np.where(new, n, 0), cls)
            sigs.append(sig)
            owners.append(own[of])
            if sum(map(len, sigs)) >= FLUSH:
                yield from flush()
    if sigs:
        yield from flush()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds 0 and 1 go through. Kind 2: a hub and another set under one of its signatures."""
    sigs, sets = [], []
    for b in batches:
        kind = b.column(0).to_numpy()
        if (kind < 2).any():
            docs = b.filter(pa.array(kind < 2))
            yield _batch(MET, len(docs), point=docs.column("blob"), **{x: docs.column(x) for x in ("kind", "id", "row", "n", "set")})
        for blob in b.column(6).filter(pa.array(kind == 2)).to_pylist():
            x = np.frombuffer(blob, U64)
            sigs.append(x[: len(x) // 2])
            sets.append(x[len(x) // 2 :])
    if sigs:
        hub, other = hubs(np.concatenate(sigs), np.concatenate(sets))
        for i in range(0, len(hub), 100_000):
            part = slice(i, i + 100_000)
            yield _batch(MET, len(hub[part]), kind=np.full(len(hub[part]), 2, np.int32), set=other[part].view(np.int64), hub=hub[part].view(np.int64))


def _bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most shingles in common; no bound where both counts of a group are cut off at MOST."""
    least = np.minimum(a, b)
    return np.where((least == MOST).any(-1), np.int64(1 << 40), least.sum(-1, dtype=np.int64))


class RTree:
    """Bulk-loaded over points in the order of their size: boxes keep coordinate maxima and the range of sizes."""

    def __init__(self, point: np.ndarray, n: np.ndarray, pct: int):
        self.pct = pct
        self.order = np.argsort(n, kind="stable")
        self.point, self.n = point[self.order], n[self.order]
        self.levels = []
        top, low, high, size = self.point, self.n, self.n, LEAF
        while True:
            at = np.arange(0, len(low), size)
            top, low, high = np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))
            if len(at) == 1:
                break
            size = FAN

    def search(self, p: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the points whose bound reaches the similarity with the point p of a set of n, and the bounds."""
        live = np.array([0])
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            # Overlap needed with a set of low shingles or more, never more than n.
            need = np.ceil(self.pct * (n + np.maximum(low[live], n * self.pct // 100)) / (100 + self.pct))
            good = (low[live] * self.pct <= 100 * n) & (high[live] * 100 >= self.pct * n) & (_bound(top[live], p) >= np.floor(need))
            live = live[good]
            step = FAN if depth else LEAF
            size = len(self.levels[depth - 1][1]) if depth else len(self.n)
            live = (live[:, None] * step + np.arange(step)).ravel()
            live = live[live < size]
        most = np.minimum(_bound(self.point[live], p), np.minimum(self.n[live], n))
        good = linked(most, self.n[live], np.int64(n), self.pct)
        return self.order[live[good]], most[good]


class Index:
    """R-trees of points, one for each number of groups; points of twice as many groups are in it folded."""

    def __init__(self, point: list[np.ndarray], n: np.ndarray, block: np.ndarray, across: bool, pct: int):
        self.point, self.n, self.block, self.across = point, n, block, across
        self.dims = np.array([len(p) for p in point])
        self.trees = {}
        for d in np.unique(self.dims).tolist():
            at = np.flatnonzero((self.dims == d) | (self.dims == 2 * d))
            folded = [point[i] if len(point[i]) == d else np.minimum(point[i][:d].astype(np.uint16) + point[i][d:], MOST).astype(np.uint8) for i in at]
            self.trees[d] = at, RTree(np.stack(folded), n[at], pct)

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Members that may be linked with i, and the most shingles in common: of each pair from one end only, and in a meeting of
        two blocks from the other block only."""
        at, tree = self.trees[int(self.dims[i])]
        found, most = tree.search(self.point[i], int(self.n[i]))
        found = at[found]
        good = (self.dims[found] > self.dims[i]) | (found < i)
        if self.across:
            good &= self.block[found] != self.block[i]
        return found[good], most[good]


class Members:
    """Sets that meet in a crowd, and the components that their links make."""

    def __init__(self, sets: list[np.ndarray], block: np.ndarray, across: bool, pct: int):
        self.n, self.pct = np.array([len(s) for s in sets]), pct
        self.end = np.cumsum(self.n)
        every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        names, self.cell = np.unique(every, return_inverse=True)
        self.mark = np.zeros(len(names), bool)
        self.index = Index(points(of, every, self.n), self.n, block, across, pct)

    def cells(self, i: int) -> np.ndarray:
        return self.cell[self.end[i] - self.n[i] : self.end[i]]

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """Shingles in common with each of the others."""
        self.mark[self.cells(i)] = True
        found = np.add.reduceat(self.mark[np.concatenate([self.cells(j) for j in others])], np.cumsum(self.n[others]) - self.n[others], dtype=np.int64)
        self.mark[self.cells(i)] = False
        return found

    def link(self) -> np.ndarray:
        """The first member of each member's component."""
        component = np.arange(len(self.n))
        for i in range(len(self.n)):
            near, most = self.index.near(i)
            near = near[np.argsort(-most / (self.n[near] + self.n[i]), kind="stable")]
            size = 1
            while True:
                near = near[component[near] != component[i]]
                if not len(near):
                    break
                some, near = near[:size], near[size:]
                size = min(2 * size, 64)
                for j in some[linked(self.common(i, some), self.n[some], self.n[i], self.pct)]:
                    a, b = sorted((component[i], component[j]))
                    component[component == b] = a
        return component


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one hub (or crowd) and pair of blocks, in their order."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        key = np.stack([t.column(i).to_numpy() for i in range(3)], 1)
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1)]
        for lo, hi in zip(cut[:-1], cut[1:]):
            yield t.slice(lo, hi - lo)
        held = t.slice(cut[-1])
    if held is not None and len(held):
        yield held


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)


def _crowds(batches: Iterator[pa.RecordBatch], pct: int) -> Iterator[pa.RecordBatch]:
    """Members that the bound on their overlap holds together, with the least of them."""

    def found():
        for t in _groups(batches):
            if len(t) < 2:
                continue
            names = t.column(4).to_numpy()
            point = [np.frombuffer(x.as_buffer(), np.uint8) for x in t.column(6)]
            index = Index(point, t.column(5).to_numpy(), t.column(3).to_numpy(), t.column(1)[0] != t.column(2)[0], pct)
            component = np.arange(len(names))
            for i in range(len(names)):
                near = component[index.near(i)[0]]
                if (near != component[i]).any():
                    every = np.union1d(near, component[i])
                    component[np.isin(component, every)] = every[0]
            crowd = (np.bincount(component, minlength=len(names)) > 1)[component]
            yield names[component[crowd]], names[crowd]

    return _gathered(found(), ["hub", "set"])


def _links(batches: Iterator[pa.RecordBatch], pct: int) -> Iterator[pa.RecordBatch]:
    """Per member joined to another: the first of its component, and itself."""

    def found():
        for t in _groups(batches):
            if len(t) < 2:
                continue
            names = t.column(4).to_numpy()
            component = Members([np.frombuffer(s.as_buffer(), U64) for s in t.column(5)], t.column(3).to_numpy(), t.column(1)[0] != t.column(2)[0], pct).link()
            joined = component != np.arange(len(component))
            yield names[component[joined]], names[joined]

    return _gathered(found(), ["a", "b"])


def _dealt(members: DataFrame) -> DataFrame:
    """hub, i, j and block before the other columns: members of a hub go to so many blocks as its shingles need, of which any two
    meet."""
    blocks = members.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks")).filter("blocks > 1")
    zero = F.lit(0).cast("long")
    dealt = members.join(blocks, "hub", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("set"), "blocks"), zero))
    dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.coalesce(F.col("blocks") - 1, zero))))
    return dealt.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *(c for c in members.columns if c != "hub"))


def _with_sets(documents: DataFrame, dealt: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """dealt with s, the shingles of its sets. wanted has the sets, each with the row of one document."""
    have = bitmap(wanted, "row")

    def sets(batches):
        for batch in batches:
            batch = batch.filter(pa.array(have.value.holds(batch.column(0).to_numpy())))
            for _, texts in chunks(batch, "text"):
                doc, shingle = shingle_sets(texts, k)
                n = np.bincount(doc, minlength=len(texts))
                own, first = np.unique(identities(doc, shingle, n), return_index=True)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array([shingle[cut[i] : cut[i + 1]].tobytes() for i in first], pa.binary())], ["set", "s"])

    found = documents.select("row", "text").transform(mapped, sets, "set long, s binary").groupBy("set").agg(F.first("s").alias("s"))
    return dealt.join(found.hint("merge"), "set")


def classes(df: DataFrame, k: int = 5, pct: int = 80, doc_id: str = "doc_id", text: str = "text", row: Column | None = None) -> DataFrame:
    """Per row: doc_id, row (64 bits of row, else of id and text), n_shingles, class (of the component; null without shingles)
    and component_id."""
    own = F.xxhash64(column(doc_id), column(text)) if row is None else row
    documents = df.select(column(doc_id).cast("long").alias("id"), own.alias("row"), column(text).cast("string").alias("text"))
    buckets = partitions(df)
    sent = documents.transform(mapped, lambda it: _send(it, k, pct, buckets), SENT)
    met = stored(sent.repartition(buckets, "bucket").transform(mapped, _meet, MET), "met")
    docs = met.filter("kind = 0").select("id", "row", "n", "set")
    reps = docs.filter("n > 0").groupBy("set").agg(F.min("row").alias("row"), F.max("n").alias("n"), F.min("id").alias("id"))
    point = met.filter("kind = 1").groupBy("set").agg(F.first("n").alias("n"), F.first("point").alias("point"))
    near = stored(met.filter("kind = 2").select("hub", "set").distinct(), "near")
    members = stored(near.union(near.select("hub", F.col("hub").alias("set")).distinct()).join(point, "set").select("hub", "set", "n", "point"), "members")
    met_by = lambda df, f, schema: df.repartition(buckets, "hub", "i", "j").sortWithinPartitions("hub", "i", "j", "set").transform(mapped, f, schema)
    crowds = met_by(_dealt(members), lambda it: _crowds(it, pct), "hub long, set long").distinct()
    crowds = stored(crowds.join(reps.select("set", "row", "n"), "set").select("hub", "set", "n", "row"), "crowds")
    # Sets, being large, join when it is known where they go.
    dealt = _with_sets(documents, _dealt(crowds).select("hub", "i", "j", "block", "set"), crowds.select("set", "row").distinct(), k)
    links = met_by(dealt.select("hub", "i", "j", "block", "set", "s"), lambda it: _links(it, pct), "a long, b long")
    label = components(stored(links, "links"))
    own = reps.join(label.withColumnRenamed("id", "set"), "set", "left").select("set", F.coalesce("component", "set").alias("class"), "id")
    own = stored(own, "classes")
    named = own.join(own.groupBy("class").agg(F.min("id").alias("component_id")), "class").select("set", "class", "component_id")
    out = docs.join(named, "set", "left")
    return out.select(F.col("id").alias("doc_id"), "row", F.col("n").alias("n_shingles"), "class", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def join(df: DataFrame, k: int = 5, pct: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least id that links reach)."""
    return classes(df, k, pct, doc_id, text).select("doc_id", "n_shingles", "component_id")


#: join() with k = 4 and pct = 85 in DuckDB's SQL.
ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), sets AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM docs
), shingles AS (SELECT rid, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.rid AS a, b.rid AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.rid < b.rid
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT rid, rid AS other FROM sets
  UNION
  SELECT r.rid, l.b FROM reached r JOIN both_ways l ON l.a = r.other
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM sets s JOIN reached r ON r.rid = s.rid JOIN sets o ON o.rid = r.other
GROUP BY s.rid, s.doc_id, s.s"""

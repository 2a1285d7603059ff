"""Mixing sources to target weights by soft membership.

A classifier trained on a labelled table (naive Bayes over the presence and absence of all hashed words that tell domains apart within a
language, summed over languages and calibrated on labelled rows that its counts did not see) gives each document posteriors p over domains. Rates r >= 0 per document are fitted by projected gradient so that the expected
domain totals, the sums of r * tokens * p, match targets: each step moves a document by its posteriors times the residuals (scaled by
the small matrix of sums of tokens * p * p over documents above 0) and cuts at 0. A step is one pass over the table of documents, tokens and
posteriors that returns one row of sums per batch; only those sums and K x K numbers reach the driver, and a document's rate is replayed from the
steps' K-vectors, so no state is kept per document.

Defined results: a null or empty text has 0 tokens and the posteriors of a text without telling words; repeated rows have rates each; a label
counts once per id; without labels there is one domain, `unknown`, and all rates are 1; an empty table gives no rows; null ids have no label.
Targets of domains that no document belongs to cannot be met and are left out. Where the steps end with a total further from its
target than a share CLOSE of all tokens, the best rates so far count and a warning says how far off they are. Where a kept column has the name of one of
the operator's, that one gets a leading underscore.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsqc.llm.common import Rolling, chunks, column, fresh, mapped, stored, words

BUCKETS = 1 << 16
#: A bucket tells domains apart in a language if some domain's count has this evidence (a chi-square term). Where fewer texts than this share
#: of the language have a telling bucket, each domain has its own probability; otherwise only domains with the evidence have.
EVIDENCE = 6.0
RARE = 0.05
#: Languages with fewer labelled rows are learned together.
LANGUAGE_ROWS = 200
FLOOR = -60.0  # of log posteriors before calibration
#: Labelled documents used for training: those with the smallest hashes of their ids, about so many.
TRAIN_BOUND = 20_000
STEPS = 40
CLOSE = 1e-6
TARGETS = {"clean": 0.9, "low": 0.07, "toxic": 0.03}


def domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 0, "low").when(F.col(quality) == 1, "clean")


def _buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word, in lower case."""
    data, start, end, doc = words(texts, lower=True)
    # A stop after a word is not part of it.
    stop = np.isin(data[end - 1], np.frombuffer(b".,;:!?", np.uint8)) & (end - start > 1) if len(end) else np.zeros(0, bool)
    return doc, (Rolling(data, seed=20).of(start, end - stop) % np.uint64(BUCKETS)).astype(np.int64)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(-1, keepdims=True)
    return top + np.log(np.exp(x - top).sum(-1, keepdims=True))


@dataclass
class Classifier:
    domains: list[str]
    row: np.ndarray  # of each bucket in weight; -1 if it tells nothing
    weight: np.ndarray  # telling bucket x (language, domain)
    prior: np.ndarray
    scale: np.ndarray  # calibration of log posteriors: x @ scale + shift
    shift: np.ndarray

    def raw(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words and log posteriors before calibration of each text. A telling bucket counts once per text."""
        doc, bucket = _buckets(texts)
        n = np.bincount(doc, minlength=len(texts))
        telling = self.row[bucket] >= 0
        pair = np.unique(doc[telling] * BUCKETS + bucket[telling])
        own, row = pair // BUCKETS, self.row[pair % BUCKETS]
        score = np.tile(self.prior, (len(texts), 1))
        at = np.flatnonzero(np.diff(own, prepend=-1))
        for c in range(0, len(self.prior) if len(at) else 0, 16):
            score[own[at], c : c + 16] += np.add.reduceat(self.weight[row, c : c + 16], at, axis=0, dtype=np.float64)
        score = _log_sum(score.reshape(len(texts), -1, len(self.domains)).transpose(0, 2, 1))[..., 0]
        return n, np.maximum(score - _log_sum(score), FLOOR)

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words and posteriors of each text."""
        n, score = self.raw(texts)
        score = score @ self.scale + self.shift
        return n, np.exp(score - _log_sum(score))


def _learn(domains: list[str], tables: list[np.ndarray]) -> Classifier:
    """From a table (bucket x domain, with the numbers of texts below) for each language."""
    k = len(domains)

    def shares(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts, table = table[BUCKETS].astype(float), table[:BUCKETS].astype(float)
        overall = ((table.sum(1) + 0.5) / (texts.sum() + 1))[:, None]
        expected = overall * texts
        evidence = (table - expected) ** 2 / (expected * (1 - overall) + 1)
        own = (evidence >= EVIDENCE) | ((overall < RARE) & (evidence.max(1, keepdims=True) >= EVIDENCE))
        return np.where(own, (table + overall) / (texts + 1), overall), own.any(1)

    live = np.zeros(BUCKETS, bool)
    for t in tables:
        live |= shares(t)[1]
    share = np.concatenate([shares(t)[0][live] for t in tables], 1)
    texts = np.concatenate([t[BUCKETS] for t in tables]) + 1.0
    row = np.full(BUCKETS, -1, np.int32)
    row[live] = np.arange(live.sum())
    weight = np.log(share / (1 - share)).astype(np.float32)
    return Classifier(domains, row, weight, np.log(texts / texts.sum()) + np.log(1 - share).sum(0), np.eye(k), np.zeros(k))


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """scale and shift of the most likely softmax(x @ scale + shift) for the domains y, drawn a little to (1, 0), by damped Newton steps."""
    k = x.shape[1]
    start = np.concatenate((np.eye(k), np.zeros((1, k))))
    if k < 2 or not len(x):
        return start[:k], start[k]
    x, hot = np.concatenate((x, np.ones((len(x), 1))), 1), np.eye(k)[y]

    def loss(w: np.ndarray) -> float:
        s = x @ w
        return float((_log_sum(s)[:, 0] - (s * hot).sum(1)).sum() + ((w - start) ** 2).sum() / 2)

    w, have = start, loss(start)
    for _ in range(50):
        p = np.exp(x @ w - _log_sum(x @ w))
        slope = (x.T @ (p - hot) + w - start).T.ravel()
        curve = np.block([[(x * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x for j in range(k)] for i in range(k)]) + np.eye(len(slope))
        step = np.linalg.solve(curve, slope).reshape(k, k + 1).T
        damp = 1.0
        while damp > 1e-4 and loss(w - damp * step) > have:
            damp /= 2
        new = loss(w - damp * step)
        if new > have - 1e-6:
            break
        w, have = w - damp * step, new
    return w[:k], w[k]


def train(docs: DataFrame, labels: DataFrame, label: Column, bound: int = TRAIN_BOUND, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Classifier:
    """The column lang is used if docs has it."""
    named = labels.select(F.col(doc_id).alias("k"), label.alias("domain")).filter("k IS NOT NULL AND domain IS NOT NULL").groupBy("k").agg(F.min("domain").alias("domain"))
    n = named.count()
    part = 1_000_000
    used = named.filter(F.pmod(F.xxhash64("k"), F.lit(part)) < int(part * min(1.0, bound / max(1, n))))
    tongue = F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang in docs.columns else F.lit("")
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).cast("string").alias("text"), tongue.alias("lang")).join(used, "k")
    rows = rows.select("text", "domain", "lang", F.pmod(F.xxhash64("k", F.lit("fold")), F.lit(2)).alias("fold"))

    def count(batches):
        found: dict[str, np.ndarray] = {}

        def send():
            for name, have in found.items():
                at = np.flatnonzero(have)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(have[at])], ["name", "bucket", "n"])
            found.clear()

        for b in batches:
            names = np.array([json.dumps(x) for x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))], object)
            for first, texts in chunks(b, "text"):
                doc, bucket = _buckets(texts)
                pair = np.unique(doc * BUCKETS + bucket)
                own = names[first : first + len(texts)]
                for name in set(own.tolist()):
                    have = found.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    mine = own == name
                    have[:BUCKETS] += np.bincount(pair[mine[pair // BUCKETS]] % BUCKETS, minlength=BUCKETS)
                    have[BUCKETS] += int(mine.sum())
                    if len(found) > 64:
                        yield from send()
        yield from send()

    sums = rows.transform(mapped, count, "name string, bucket long, n long").groupBy("name", "bucket").agg(F.sum("n").alias("n")).toArrow()
    named_sums = sums.column("name").combine_chunks().dictionary_encode()
    keys = [json.loads(x) for x in named_sums.dictionary.to_pylist()]
    code, bucket, number = named_sums.indices.to_numpy(), sums.column("bucket").to_numpy(), sums.column("n").to_numpy()
    domains = sorted({d for d, _, _ in keys}) or ["unknown"]
    texts = dict.fromkeys((x[1] for x in keys), 0)
    for c, m in zip(code[bucket == BUCKETS].tolist(), number[bucket == BUCKETS].tolist()):
        texts[keys[c][1]] += m
    languages = sorted(x for x in texts if texts[x] >= LANGUAGE_ROWS)
    place = {x: i for i, x in enumerate(languages)}
    others = len(languages) < len(texts) or not languages
    folds = np.zeros((2, len(languages) + others, BUCKETS + 1, len(domains)), np.int32)
    for c, (d, x, fold) in enumerate(keys):
        at = code == c
        folds[fold, place.get(x, len(languages)), bucket[at], domains.index(d)] += number[at].astype(np.int32)
    model = _learn(domains, list(folds.sum(0, dtype=np.int32)))
    if len(domains) < 2:
        return model
    # Each fold is scored by what the other one taught.
    halves = docs.sparkSession.sparkContext.broadcast([_learn(domains, list(folds[1])), _learn(domains, list(folds[0]))])

    def seen(batches):
        for b in batches:
            fold, at = b.column(3).to_numpy(), pa.array([domains.index(x) for x in b.column(1).to_pylist()], pa.int64())
            x = np.zeros((b.num_rows, len(domains)))
            for first, run in chunks(b, "text"):
                for i in (0, 1):
                    mine = np.flatnonzero(fold[first : first + len(run)] == i)
                    if len(mine):
                        x[first + mine] = halves.value[i].raw([run[j] for j in mine])[1]
            yield pa.RecordBatch.from_arrays([at, pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(domains), pa.int32()), pa.array(x.ravel()))], ["y", "x"])

    found = rows.transform(mapped, seen, "y long, x array<double>").toArrow()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(domains))
    model.scale, model.shift = _calibrated(x, found.column("y").to_numpy())
    return model


def _rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - p @ g)
    return r


def fit(members: DataFrame, k: int, target: np.ndarray, steps: int = STEPS) -> list[np.ndarray]:
    """K-vectors of the steps, for rows (n long, p array<double>)."""

    def sums(history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Totals at the rates so far, and sums of n * p * p over documents that have a rate above 0."""

        def run(batches):
            for b in batches:
                n = b.column(0).to_numpy().astype(float)
                p = np.array(b.column(1).flatten()).reshape(-1, k)
                r = _rates(p, history)
                got = np.concatenate(((r * n) @ p, ((p * (n * (r > 0))[:, None]).T @ p).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(got.size)), pa.array(got)], ["i", "x"])

        found = members.select("n", "p").transform(mapped, run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(k + k * k)
        for r in found:
            out[r["i"]] = r["x"]
        return out[:k], out[k:].reshape(k, k)

    history: list[np.ndarray] = []
    best = (np.inf, 0)
    damp = 1.0
    for _ in range(steps):
        totals, matrix = sums(history)
        live = matrix.sum(0) > 0
        off = np.where(live, totals - target, 0.0)
        worst = float(np.abs(off).max())
        if worst >= best[0]:
            damp /= 2  # the last step went too far
        else:
            best = (worst, len(history))
        if worst <= CLOSE * target.sum():
            break
        history.append(damp * np.linalg.pinv(matrix, rcond=1e-9) @ off)
    if best[0] > CLOSE * target.sum():
        warnings.warn(f"after {steps} steps a total is {best[0]:.6g} tokens off its target, of {target.sum():.6g} in all", stacklevel=2)
    return history[: best[1]]


def mix(docs: DataFrame, labels: DataFrame, label: Column | None = None, targets: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per document: doc_id (and the columns in keep), n_tokens, domain (the likeliest), p_<domain>, rate, and copies: the rate rounded up or down by a hash of the id."""
    label = domain() if label is None else label
    targets = targets or TARGETS
    model = train(docs, labels, label, doc_id=doc_id, text=text)
    k = len(model.domains)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [F.col(doc_id).cast("long").alias("doc_id"), *(column(c).alias(f"keep_{i}") for i, c in enumerate(keep or []))]
    source = docs.select(*kept, F.col(text).cast("string").alias("text_"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])
    m = len(source.columns) - 1

    def member(batches):
        for b in batches:
            n, p = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, k))
            for first, texts in chunks(b, "text_"):
                n[first : first + len(texts)], p[first : first + len(texts)] = shared.value.posteriors(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * k, pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:m], pa.array(n), lists], [*b.schema.names[:m], "n", "p"])

    members = stored(source.transform(mapped, member, schema), "members")
    total = members.agg(F.sum("n")).first()[0] or 0
    shares = np.array([targets.get(d, 0.0) for d in model.domains])
    shares = shares / shares.sum() if shares.sum() else np.full(k, 1 / k)
    history = fit(members, k, shares * total)

    def rate(batches):
        for b in batches:
            p = np.array(b.column(m + 1).flatten()).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_rates(p, history))], [*b.schema.names, "rate"])

    rated = members.transform(mapped, rate, T.StructType([*members.schema.fields, T.StructField("rate", T.DoubleType())]))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("rate") + chance).cast("int")
    best = F.get(F.array(*map(F.lit, model.domains)), F.array_position("p", F.array_max("p")).cast("int") - 1)
    own = {"n_tokens": F.col("n"), "domain": best, **{f"p_{d}": F.get("p", F.lit(i)) for i, d in enumerate(model.domains)}, "rate": F.col("rate"), "copies": copies}
    taken = ["doc_id", *(keep or [])]
    return rated.select("doc_id", *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep or [])), *(x.alias(fresh(taken, name)) for name, x in own.items()))

"""Language ID: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (languages x BUCKETS float32, bounded by MATRIX_BYTES) is broadcast; texts are scored whole in
Arrow batches, in numpy. Defined results: a null text, or one without a letter, is `und` with score 0.0; so is every
text if nothing could be learned. Rows repeat and other columns pass through unchanged; a clashing name gets a leading
underscore on the operator's column. Ties go to the language first in alphabetical order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsqc.llm.common import fresh, mapped, splitmix

ORDERS = 3
BUCKETS = 1 << 16
MATRIX_BYTES = 128 << 20
#: Characters scored at once; only a longer text exceeds it.
RUN_CHARS = 1 << 18
#: Labelled documents that training may use: of each language those with the smallest hashes of their ids, about an equal share of so many; a
#: language with fewer is used whole.
TRAIN_BOUND = 20_000

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _grams(texts: list[str], buckets: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket of the n-gram ending at each character, for each order; first character of each text; letters in each text.

    Every character that is not a letter counts as one space; n-grams that hold no letter go to bucket 0.
    """
    low = [t.lower() + " " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in low])[:-1])).astype(np.int64)
    code = np.where(letter, code, np.uint32(32)).astype(np.uint64)
    first = np.zeros(len(code), bool)
    first[starts] = True
    out, before, any_letter, h = [], code, letter, np.zeros(len(code), np.uint64)
    for n in range(ORDERS):
        if n:
            before = np.concatenate((np.array([32], np.uint64), before[:-1]))
            before[first] = 32
            any_letter = any_letter | (before != 32)
        h = h + before * np.uint64(0x9E3779B97F4A7C15 * (2 * n + 3) % (1 << 64) | 1)
        out.append(np.where(any_letter, splitmix(h + np.uint64(n)) % np.uint64(buckets - 1) + np.uint64(1), np.uint64(0)).astype(np.int64))
    return out, starts, np.add.reduceat(letter.astype(np.int64), starts)


def _runs(values: list[str | None]):
    run, first, size = [], 0, 0
    for i, v in enumerate(values):
        v = v or ""
        if run and size + len(v) > RUN_CHARS:
            yield first, run
            run, first, size = [], i, 0
        run.append(v)
        size += len(v)
    if run:
        yield first, run


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # bucket x language
    prior: np.ndarray

    def fit(self, best: np.ndarray, like: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How near texts of n n-grams and these log-likelihoods may be to the usual mean of their best language: 1 there, 0 at
        that of n-grams at random. Two standard errors count for the text, so a short one is hardly ever far off."""
        p = np.exp(self.log_prob[1:].astype(np.float64))
        usual, random = (p * self.log_prob[1:]).sum(0), self.log_prob[1:].mean(0, dtype=np.float64)
        spread = np.sqrt((p * (self.log_prob[1:] - usual) ** 2).sum(0))
        n = np.maximum(n, 1)
        return (like / n + 2 * spread[best] / np.sqrt(n) - random[best]) / np.maximum(usual - random, 1e-9)[best]


def train(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", bound: int = TRAIN_BOUND) -> Model:
    """Learns from rows with a text and a language, of which a sample of about bound rows is used, by id hash within each language.
    How often languages are is learned from all rows."""
    rows = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id)).alias("h")
    )
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((2, 0), np.float32), np.zeros(0))
    buckets = max(2, min(BUCKETS, MATRIX_BYTES // (4 * len(languages))))
    if sum(sizes.values()) > bound:
        part = 1 << 30
        # A row for each language, as many as the matrix has columns.
        limits = df.sparkSession.createDataFrame([(x, int(part * min(1.0, bound / len(sizes) / n))) for x, n in sizes.items()], "lang string, upto long")
        rows = rows.join(F.broadcast(limits), "lang").filter(F.pmod("h", F.lit(part)) < F.col("upto"))

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for b in batches:
            texts, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
            for label in set(labels):
                for _, run in _runs([t for t, x in zip(texts, labels) if x == label]):
                    have = found.setdefault(label, np.zeros(buckets, np.int64))
                    for g in _grams(run, buckets)[0]:
                        have += np.bincount(g, minlength=buckets)
        for label, have in found.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at), pa.array(have[at])], ["lang", "bucket", "n"])

    counts = rows.select("text", "lang").transform(mapped, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    at = {x: i for i, x in enumerate(languages)}
    table = np.zeros((buckets, len(languages)))
    where = np.array([at[x] for x in counts["lang"].to_pylist()], np.int64)
    table[counts["bucket"].to_numpy(), where] = counts["n"].to_numpy()
    docs, table = np.array([sizes[x] for x in languages]) + 1, table + 0.5
    table[0] = 1  # n-grams without a letter say nothing
    log_prob = np.log(table / table[1:].sum(0))
    log_prob[0] = 0
    return Model(languages, log_prob.astype(np.float32), np.log(docs / docs.sum()))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of df, with lang_pred, score (the posterior of the language predicted) and fit (see Model; 0.0 for `und`)."""
    names = [fresh(df.columns, x) for x in ("lang_pred", "score", "fit")]
    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def score(batches):
        m = shared.value
        languages = np.array([*m.languages, "und"], object)
        for b in batches:
            best, post, fit = np.full(b.num_rows, len(languages) - 1), np.zeros(b.num_rows), np.zeros(b.num_rows)
            for first, run in _runs(b.column(at).to_pylist()) if m.languages else ():
                grams, starts, letters = _grams(run, len(m.log_prob))
                like = m.prior + sum(np.add.reduceat(m.log_prob[g], starts, axis=0, dtype=np.float64) for g in grams)
                good, rows = letters > 0, np.arange(len(run))
                top = like.argmax(1)
                n = sum(np.add.reduceat(g > 0, starts, dtype=np.int64) for g in grams)
                fit[first : first + len(run)] = np.where(good, m.fit(top, like[rows, top] - m.prior[top], n), 0.0)
                like = np.exp(like - like.max(1, keepdims=True))
                best[first : first + len(run)] = np.where(good, top, len(languages) - 1)
                post[first : first + len(run)] = np.where(good, like[rows, top] / like.sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(languages[best].tolist(), pa.string()), pa.array(post), pa.array(fit)], [*b.schema.names, *names])

    return df.transform(mapped, score, schema)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text is 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(doc_id: str = "doc_id"):
    """True where the id is not held out; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(False))

"""Token counts: rollups by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes holds inserts (+1), deletes (-1) and revisions (the old count at -1 and the new one at +1). Its sums by
key are written in one batch folder, which counts once Spark has put its _SUCCESS mark there. A batch id that is
committed is not written again, and a retry of one that is not overwrites it, so commits are idempotent. Totals add up
the committed folders; compact() folds them into one, with a list of the batches in it, which are not written again either. Only sums by key are stored or shuffled, pre-aggregated in the map
tasks, so a hot source costs no more than another.

Counts are ids of a public tokenizer (with_ids) or matches of a pattern (counter), each under its version.

Defined results: a null text has 0 tokens; null sources and languages are keys of their own; repeated rows count each;
keys whose documents and tokens are both 0 are left out of totals; no batch gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsqc.llm.common import column, fresh, mapped, stored
from tsqc.llm.tokens import encoder

KEYS = ["source", "lang", "tokenizer", "version"]
SCHEMA = "source string, lang string, tokenizer string, version int, docs long, tokens long"

#: Native counters by (tokenizer, version); words are [^\x20\x09-\x0D]+, pieces also part letters and digits from the rest.
PATTERNS = {("words", 1): "[^\\x20\\x09-\\x0D]+", ("words", 2): "[A-Za-z0-9]+|[^\\x20\\x09-\\x0DA-Za-z0-9]"}


def counter(tokenizer: str, version: int, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(PATTERNS[tokenizer, version])), F.lit(0)).cast("long")


def with_ids(df: DataFrame, json_path: str, rank_path: str, name: str, text: str = "text") -> DataFrame:
    """All columns of df but the text, with the number of ids (name, or _name if that is taken) of the tokenizer at these paths."""
    kept = [c for c in df.columns if c != text]
    name = fresh(kept, name)
    source = df.select(*(column(c) for c in kept), column(text).cast("string").alias(text))

    def run(batches):
        enc = encoder(json_path, rank_path)
        for b in batches:
            texts = b.column(len(kept)).to_pylist()
            count = [len(ids) for at in range(0, len(texts), 512) for ids in enc.encode([t or "" for t in texts[at : at + 512]])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(count, pa.int64())], [*b.schema.names[:-1], name])

    return source.transform(mapped, run, T.StructType([*source.schema.fields[:-1], T.StructField(name, T.LongType())]))


def changes(df: DataFrame, *signed: tuple[str, int, int, str]) -> DataFrame:
    """Signed changes of rows with source and lang, in one scan: per row one change for each (tokenizer, version, sign, column of the count)."""
    each = [F.struct(F.lit(t).alias("tokenizer"), F.lit(v).alias("version"), F.lit(sign).cast("long").alias("docs"), (F.col(c) * sign).cast("long").alias("tokens")) for t, v, sign, c in signed]
    return df.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.inline(F.array(*each)))


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def _marked(self) -> list[str]:
        fs, root = self._fs(self.path)
        if not fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def folded(self) -> set[str]:
        """Folders, here or in the rollups that this one comes from, whose sums compacted folders hold."""
        names = self._marked()
        lists = [f"{self.path}/{n}" for n in names if n.startswith("folded=") and "batch=" + n.removeprefix("folded=") in names]
        return {r["name"] for r in self.spark.read.schema("name string").parquet(*lists).collect()} if lists else set()

    def committed(self) -> list[str]:
        """Batch folders with a mark, but for those that a compacted folder holds."""
        held = self.folded()
        return [n for n in self._marked() if n.startswith("batch=") and n not in held]

    def commit(self, batch_id: str, batch: DataFrame) -> bool:
        """Whether the batch was new."""
        name = f"batch={batch_id}"
        if name in self.committed() or name in self.folded():
            return False
        sums = batch.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        return True

    def totals(self) -> DataFrame:
        folders = [f"{self.path}/{n}" for n in self.committed()]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        every = self.spark.read.schema(SCHEMA).parquet(*folders)
        return every.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs != 0 OR tokens != 0")

    def compact(self, into: str) -> Rollup:
        """A rollup of its own under another path, with all totals so far as one batch named after the last one in it."""
        new = Rollup(self.spark, into)
        names = self.committed()
        if names:
            name = "upto-" + names[-1].removeprefix("batch=")
            if f"batch={name}" not in new._marked():
                # Counts only once the batch has its mark, so it is written first.
                held = self.spark.createDataFrame([(n,) for n in sorted({*names, *self.folded()})], "name string")
                held.coalesce(1).write.mode("overwrite").parquet(f"{into.rstrip('/')}/folded={name}")
            new.commit(name, self.totals())
        return new


#: Totals of rollup_of() over patterns: all documents counted by version 1, then revised to version 2, toxic ones deleted.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS v1, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]')) AS v2 FROM documents),
k AS (SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS gone FROM d)
SELECT source, lang, 'words' AS tokenizer, 1::INTEGER AS version, count(*)::BIGINT AS docs, sum(v1)::BIGINT AS tokens FROM k WHERE NOT coalesce(gone, false) GROUP BY ALL
UNION ALL SELECT source, lang, 'words', 2::INTEGER, count(*)::BIGINT, sum(v2)::BIGINT FROM k WHERE NOT coalesce(gone, false) GROUP BY ALL
"""


def rollup_of(counted: DataFrame, labels: DataFrame, path: str, first: tuple[str, int, str], second: tuple[str, int, str]) -> Rollup:
    """Batches over a whole table of counts, the (tokenizer, version, column) first and second: inserts with the column guess
    for the first; their revision to true counts, with inserts by the second; deletes of toxic documents."""
    (t1, v1, c1), (t2, v2, c2) = first, second
    store = Rollup(counted.sparkSession, path)
    store.commit("0001", changes(counted, (t1, v1, 1, "guess")))
    revised = changes(counted, (t1, v1, -1, "guess"), (t1, v1, 1, c1), (t2, v2, 1, c2))
    store.commit("0002", revised)
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    store.commit("0003", changes(counted.join(toxic, "doc_id", "left_semi"), (t1, v1, -1, c1), (t2, v2, -1, c2)))
    store.commit("0002", revised)  # a replay changes nothing
    return store


def by_patterns(docs: DataFrame, labels: DataFrame, path: str) -> Rollup:
    guess = F.coalesce(F.length("text"), F.lit(0)).alias("guess")
    counted = docs.select("doc_id", "source", "lang", guess, counter("words", 1).alias("v1"), counter("words", 2).alias("v2"))
    return rollup_of(counted, labels, path, ("words", 1, "v1"), ("words", 2, "v2"))


def by_ids(docs: DataFrame, labels: DataFrame, path: str, json_path: str, rank_path: str, tokenizer: str = "byte_bpe_50k") -> Rollup:
    """Ids are version 1 of the tokenizer; version 2 counts the id that ends a document as well."""
    guess = F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).alias("guess")
    counted = with_ids(docs.select("doc_id", "source", "lang", guess, "text"), json_path, rank_path, "v1").withColumn("v2", F.col("v1") + 1)
    counted = stored(counted, "counted")  # each text is encoded once
    return rollup_of(counted, labels, path, (tokenizer, 1, "v1"), (tokenizer, 2, "v2"))

"""The corpus pipeline: five stages, each over all that the one before it kept.

Language ID drops documents of no language; the n-gram Jaccard join keeps one document of each group of near copies (five
words, similarity 0.8); secret scans redact; mixing repeats or drops documents by their fitted rates; packing returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsqc.llm import jaccard_join, language_id, mixing, packing, secret_scans
from tsqc.llm.common import column, fresh, new_path, read_table, remove, stored
from tsqc.llm.queries import _tokenizer

#: A text whose n-grams are nearer to random ones than to those usual in its likeliest language is in none of them.
MIN_FIT = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where no document has a language to learn from, all stay."""
    model = language_id.train(docs)
    if not model.languages:
        return docs
    pred, _, fit = (fresh(docs.columns, x) for x in ("lang_pred", "score", "fit"))
    found = language_id.predict(docs, model)
    return found.filter((F.col(pred) != "und") & (F.col(fit) >= MIN_FIT)).select(*map(column, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of the least id, null ids last, then of the least hash of its columns; of rows alike in
    all columns, one. Rows are compared each for itself, whatever their ids. A text without words is no one's copy."""
    key = fresh(docs.columns, "row_key")
    keyed = docs.withColumn(key, F.xxhash64(*(column(c) for c in docs.columns)))
    found = stored(jaccard_join.classes(keyed, k=5, pct=80, row=F.col(key)).filter("n_shingles > 0").select("doc_id", "row", "class"), "classes")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row")
    first = found.groupBy("class").agg(F.min(rank)["row"].alias(key)).select(key)
    whole = F.struct(*(column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    one = keyed.join(first, key, "left_semi").groupBy(key).agg(F.first(whole).alias("whole"))
    one = one.select(*(F.col("whole")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)))
    return one.union(docs.filter(~F.coalesce(column("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars, if it is a number, follows the text of the rows that are redacted; it stays as it is in all others."""
    before = fresh(docs.columns, "before")
    kind = dict(docs.dtypes).get("n_chars")
    if kind not in ("int", "bigint"):
        return secret_scans.redact(docs, secret_scans.train())
    out = secret_scans.redact(docs.withColumn(before, F.length("text")), secret_scans.train())
    changed = F.col("n_chars") + F.length("text") - F.col(before)
    return out.withColumn("n_chars", F.coalesce(changed, "n_chars").cast(kind)).drop(before)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document with rate 2.3 is there two or three times."""
    labels = read_table(spark, sf_dir, "labels")
    kept = [c for c in docs.columns if c != "doc_id"]
    rated = mixing.mix(docs, labels, keep=kept)
    copies = fresh(["doc_id", *kept], "copies")
    each = F.explode(F.sequence(F.lit(1), copies)).alias(fresh(docs.columns, "copy"))
    return rated.filter(F.col(copies) > 0).select(*map(column, docs.columns), each).drop(fresh(docs.columns, "copy"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, *_tokenizer(), capacity=1024)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("secret scans", secrets), ("mixing", mixed), ("packing", packed)]
#: Not expressible in SQL: trained models and tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage has read goes when its own rows are written; only the last one's stays, for the caller."""
    docs, read = read_table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = new_path(spark, f"stage{i}")
        out.write.parquet(path)
        if read:
            remove(spark, read)
        docs, read = spark.read.schema(out.schema).parquet(path), path

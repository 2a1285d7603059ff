"""The thin queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsqc.llm import jaccard_join, quality_rules, suffix_dedup, token_counts
from tsqc.llm.common import new_path, read_table


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_quality_rules(spark, sf_dir):
    found = quality_rules.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_chars", "base_failed", "kept")


def op2_token_counts(spark, sf_dir):
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return token_counts.by_ids(docs, labels, new_path(spark, "token_rollup"), *_tokenizer()).totals()


def token_counts_by_pattern(spark, sf_dir):
    """The rollup of op2 over counts that SQL has too."""
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return token_counts.by_patterns(docs, labels, new_path(spark, "token_rollup")).totals()


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(read_table(spark, sf_dir, "documents")).drop("spans")


def op4_secret_scans(spark, sf_dir):
    from tsqc.llm import secret_scans

    return secret_scans.scan(read_table(spark, sf_dir, "documents"), secret_scans.train())


def op5_packing(spark, sf_dir):
    from tsqc.llm import packing

    return packing.pack(read_table(spark, sf_dir, "documents"), *_tokenizer(), capacity=1024)


def op6_language_id(spark, sf_dir):
    from tsqc.llm import language_id as L

    docs = read_table(spark, sf_dir, "documents")
    model = L.train(docs.filter(L.learnable()))
    return L.predict(docs.select("doc_id", L.held_out().alias("held_out"), "text"), model).drop("text", "fit")


def op7_media_columns(spark, sf_dir):
    from tsqc.llm import media_columns

    found = media_columns.media_columns(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length", "width", "height")


def op8_html_extraction(spark, sf_dir):
    from tsqc.llm import html_extract

    return html_extract.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_mixing(spark, sf_dir):
    from tsqc.llm import mixing

    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.join(read_table(spark, sf_dir, "documents"), k=4, pct=85)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_suffix_dedup, op4_secret_scans, op5_packing, op6_language_id, op7_media_columns, op8_html_extraction, op9_mixing, op10_ngram_jaccard_join, token_counts_by_pattern)}
ORACLES = {"op1_quality_rules": quality_rules.ORACLE, "token_counts_by_pattern": token_counts.ORACLE, "op3_suffix_dedup": suffix_dedup.ORACLE, "op10_ngram_jaccard_join": jaccard_join.ORACLE}

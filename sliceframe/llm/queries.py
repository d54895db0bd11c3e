"""The opN_ queries and their DuckDB oracles."""

from __future__ import annotations

from sliceframe.llm import chat, cotraining, decontaminate, lexical_search, license_rules, mixing, ngram_join, pii, quality_rules, substring_dedup, suffix_dedup, tokens, whitening
from sliceframe.llm.common import table


def op1_pii(spark, sf_dir):
    return pii.query(table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    return license_rules.query(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.query(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark, sf_dir):
    return chat.query(table(spark, sf_dir, "conversations"))


def op5_token_counts(spark, sf_dir):
    import public_tokenizers

    return tokens.query(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality_rules(spark, sf_dir):
    return quality_rules.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_classifier(spark, sf_dir):
    return cotraining.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_benchmark_decontamination(spark, sf_dir):
    return decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mixing(spark, sf_dir):
    return mixing.query(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.query(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.query(table(spark, sf_dir, "embeddings"))


def op12_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.query(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    return lexical_search.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries():
    return {f.__name__: f for f in (op1_pii, op2_license_scan, op3_substring_dedup, op4_chat_formatting, op5_token_counts, op6_quality_rules, op7_quality_classifier, op8_benchmark_decontamination, op9_mixing, op10_ngram_jaccard_join, op11_embedding_whitening, op12_suffix_array_dedup, op13_lexical_search)}


def oracle_sql():
    return {
        "op3_substring_dedup": substring_dedup.ORACLE,
        "op4_chat_formatting": chat.ORACLE,
        "op8_benchmark_decontamination": decontaminate.ORACLE,
        "op9_mixing": mixing.ORACLE,
        "op10_ngram_jaccard_join": ngram_join.ORACLE,
        "op12_suffix_array_dedup": suffix_dedup.ORACLE,
        "op13_lexical_search": lexical_search.ORACLE,
    }

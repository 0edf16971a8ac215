"""The queries of this subpackage: one per operator, over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from diglot.session import table


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from diglot.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"), end_id=1, length=2048)


def op4_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from diglot.llm.decontaminate import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), recall=0.99)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from diglot.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), end_id=2)


def op2_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from diglot.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"), most_blocked=0.5)


def op3_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from diglot.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), alpha=0.05, delta=0.05)


def op6_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from diglot.llm.line_dedup import by_document

    return by_document(table(spark, sf_dir, "documents"), least_chars=10, every=True, least_words=10)


def op7_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from diglot.llm.lm import score

    return score(table(spark, sf_dir, "documents"), folds=10)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from diglot.llm.quality_model import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, most_rows=20_000, threshold=0.3)


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from diglot.llm.near_dups import classes

    return classes(table(spark, sf_dir, "documents"), least=0.8)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files <source>/<doc_id>: a source is a directory."""
    from pyspark.sql import functions as F

    from diglot.llm.licences import scan

    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")).alias("path"), "text")
    return scan(files, least=0.8)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hilbert_packing, op2_path_templates, op3_risk_controlled_rules, op4_cgk_decontamination, op5_token_files, op6_deletion_neighbourhood, op7_backoff_automaton, op8_quality_classifier, op9_bagminhash, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return {}

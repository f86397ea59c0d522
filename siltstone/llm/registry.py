"""The corpus operators' queries, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import documents, shipped


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.langid import digests

    return digests(documents(shipped(spark), sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.mixing import digests

    return digests(documents(shipped(spark), sf_dir))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.neardup import digests

    return digests(documents(shipped(spark), sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.toxicity import digests

    return digests(documents(shipped(spark), sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.linededup import digests

    return digests(documents(shipped(spark), sf_dir))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.ppm import scores

    return scores(documents(shipped(spark), sf_dir))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.fingerprint import compare_next

    return compare_next(documents(shipped(spark), sf_dir))


def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.quotes import linked

    return linked(shipped(spark).read.parquet(f"{sf_dir}/conversations.parquet"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.quality import verdicts

    return verdicts(documents(shipped(spark), sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.bpe import digests

    return digests(documents(shipped(spark), sf_dir), _vocabulary())


def quotes_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking over messages that do quote each other."""
    from siltstone.llm.quotes import linked, replies

    return linked(replies(documents(shipped(spark), sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()} | {"quotes_of_documents": quotes_of_documents}


def oracle_sql() -> dict[str, str]:
    from siltstone.llm import linededup, quotes

    return {"op5_line_dedup": linededup.ORACLE_SQL, "op8_quotes": quotes.ORACLE_SQL, "quotes_of_documents": quotes.REPLIES_SQL}

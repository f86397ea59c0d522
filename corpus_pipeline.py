"""Corpus pipeline over `documents`: language, lines, copies, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, langid, linededup, mixing, neardup
from siltstone.llm.common import fold, shared_folder, shipped
from siltstone.llm.registry import _vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; texts without a letter go.  `lang` becomes the
    predicted one."""
    model = langid.train(docs.where(fold("doc_id", 4) != 2).select("doc_id", "lang", "text"))
    out = langid.classify(docs, model).where(F.col("__lang") != langid.UND)
    return out.withColumn("lang", F.col("__lang")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents repeat; `n_chars` follows.  A
    document that loses all its lines goes."""
    out = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    left = out.where((F.col("__n_dropped") == 0) | (F.length(F.btrim("text", F.lit(linededup.BLANKS))) > 0))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the least id."""
    return neardup.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the text that they decode to."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), _vocabulary(), decoded="decoded").drop("text")


STAGES = [("language", language), ("lines", lines), ("copies", copies), ("mix", mix), ("tokens", tokens)]

#: Language, mix and tokens have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shipped(spark).read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{where}/{k}-{name}")
        docs = spark.read.parquet(f"{where}/{k}-{name}")
    return docs

"""A corpus pipeline of five stages, each applying one of the training-data operators.

Every stage takes what its predecessor kept; all but the last return the columns of
``documents``. A stage that drops documents names the rows by id and a hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaframe.llm import decontaminate, langid, line_dedup, minhash, packing
from areaframe.llm.common import documents, sized, text_key, write_table
from areaframe.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose (doc_id, _t) is not among ``dropped``, written once and counted."""
    dropped = write_table(dropped.select("doc_id", "_t").distinct(), "dropped")
    d, x = docs.withColumn("_t", text_key(F.coalesce("text", F.lit("")))).alias("d"), sized(dropped, 32).alias("x")
    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d._t") == F.col("x._t"))
    return d.join(x, same, "left_anti").select(*COLUMNS)


def _columns(docs: DataFrame) -> DataFrame:
    return documents(docs, "lang", "source", "n_chars").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the models accept go."""
    docs = _columns(docs)
    judged = langid.identify(docs.withColumn("_t", text_key(F.coalesce("text", F.lit("")))), "_t")
    return _without(docs, judged.where("rejected"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks of lines go; so do documents that consist of nothing else."""
    out = line_dedup.dedup(_columns(docs), "lang", "source")
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    docs = _columns(docs)
    return _without(docs, minhash.near_duplicates(docs).where(~F.col("kept")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    docs = _columns(docs)
    judged = decontaminate.digest(docs.withColumn("text", F.coalesce("text", F.lit(""))), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, judged.where("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the remaining documents in training sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: SQL cannot express the language models, the signatures or the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

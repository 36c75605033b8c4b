"""A training corpus from `documents`: quality rules, line and near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; `run` writes every
stage's rows as a table in the shared folder. Stages carry all columns of `documents` through; a
null doc_id or text is a row like others and goes where its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import bpe, decontaminate, line_dedup, near_dup, quality
from locusframe.llm.common import small
from locusframe.llm.queries import TOKENIZER
from locusframe.session import materialise, tune

#: Ids of rejected documents that may travel to every task; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def packed(docs: DataFrame) -> DataFrame:
    """What stages read, and the whole row in one column, so that no name of it meets a stage's own."""
    return docs.select("doc_id", "text", "source", F.struct("*").alias("_row"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = tune(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality(packed(docs).drop("source"), labels, carry=["_row"]).where("kept").select("_row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat over their source."""
    cleaned = line_dedup.drop_boilerplate(packed(docs), F.col("source"))
    row = F.col("_row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("text").cast("long"))
    return cleaned.select(row.alias("_row")).select("_row.*")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id; rows that repeat it stay."""
    own = packed(docs)
    dropped = materialise(near_dup.near_duplicates(own.select("doc_id", "text")).where("NOT kept").select("doc_id").distinct())
    return own.join(small(dropped, BROADCAST_ROWS), "doc_id", "left_anti").select("_row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    own = packed(docs)
    items = tune(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.occurrences(own.select("doc_id", "text"), items).select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h")).distinct()
    found = small(materialise(found), BROADCAST_ROWS)
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text", F.lit(2)) == F.col("_h"))
    return own.join(found, same, "left_anti").select("_row.*")


def encode_words(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as digests, and their count."""
    return bpe.digests(bpe.encode(docs, TOKENIZER))


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_copy),
    ("decontamination", drop_benchmark),
    ("bpe", encode_words),
]

#: The forest and the encoder are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialise(docs)
    return docs

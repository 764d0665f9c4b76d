"""A training corpus in five stages: quality, repeated lines, near-duplicates, benchmark leaks, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.durable import durable
from riskloom.llm import bpe, bradley_terry, decontaminate, linededup, simhash
from riskloom.llm.queries import id_bucket, table, tokenizer


#: Rows of text that pass between Spark and Python at a time: texts may be long, and two tasks share an executor.
ARROW_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(min(ARROW_ROWS, int(spark.conf.get(name)))))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the given table, so it does not depend on earlier stages."""
    _small_batches(spark)
    ranker = bradley_terry.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(id_bucket() != 0))
    return bradley_terry.with_scores(docs, ranker, out="__score").where(F.col("__score") >= bradley_terry.CUT).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated multi-line chunks and repeated passages of more than 50 words; n_chars follows the text."""
    _small_batches(spark)
    done = linededup.dedup_passages(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else done.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies (five words, similarity 0.8 or more)."""
    _small_batches(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    _small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether decoding the ids gives the text back."""
    _small_batches(spark)
    path, pattern = tokenizer()
    return bpe.encode_and_check(docs, path, pattern)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("byte-level BPE", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is kept before the next, which reads it more than once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

"""A training-corpus pipeline of five stages; each works on all that the one before kept.

Null and empty texts leave with the first stage; null ids and sources stay and are treated like any other value; rows that repeat are near-duplicates of each
other, so one of them stays.  An empty table gives an empty result.  Extra columns pass through the first four stages unchanged, whatever their names.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratolog.llm import language, mixing, pieces, secrets, simhash
from stratolog.llm.common import documents, quoted, shared_folder


#: Bytes of a batch between Spark and Python, which executors hold several times over.
BATCH = 8 << 20


def in_small_batches(spark: SparkSession) -> None:
    """Batches of the session are of ``BATCH`` bytes at most from now on; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size, unit = re.match(r"(\d+)\s*([kmgtp]?)", spark.conf.get(name).lower()).groups()
    if not 0 < int(size) * 1024 ** " kmgtp".index(unit or " ") <= BATCH:
        spark.conf.set(name, BATCH)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (null texts and texts without a letter).  The prediction takes the place of ``lang``."""
    in_small_batches(spark)
    rows = language.annotate(docs).where("lang_pred <> 'und'")
    return rows.select(*[F.col("lang_pred" if c == "lang" else f"row.{quoted(c)}").alias(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: shingles of five words, similarity of 0.8 or more; the one of the least id (null ids last)."""
    in_small_batches(spark)
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts secrets; every document stays, and ``n_chars`` is that of the redacted text."""
    rows = secrets.redact(docs)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; texts without a word are not taken."""
    return mixing.expand(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    in_small_batches(spark)
    return pieces.tokenize(docs, carry=("doc_id", "lang", "source"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_dedup),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("SentencePiece", sentencepiece),
]

#: Codes, fingerprints, forests and samples have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages, each over all that the one before kept.

All stages but the last return the columns COLUMNS; others, whatever their names, are
left out. Repeated rows are handled each, a text of any length whole, and an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, decontaminate, line_dedup, quality, queries, simhash
from marginalia.llm.common import discard, table, written

#: Fixed: the columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated chance of quality 1 is under 0.3 go; null and empty texts are judged as no text, and rows of a null id stay."""
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"))
    bad = scored.where("predicted = 0 and doc_id is not null").select(F.col("doc_id").alias("bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["bad"], "left_anti").select(COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go; n_chars follows the text, and a null text becomes an empty one."""
    return line_dedup.drop_common_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, texts linked by sharing 0.8 or more of their shingles of five words, the one of the smallest id stays. Fingerprints and sketches give the candidates. Texts without words are copies of each other; rows of a null id stay."""
    return simhash.keep_one(docs, words=5).select(COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go; null and empty texts hold none."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and digests of them and of what they decode to; a null text has those of an empty one."""
    ranks = queries.default_ranks()
    encoded = bpe.encode(docs, ranks)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", reject_low_quality),
    ("line_dedup", drop_common_lines),
    ("simhash", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]
#: SQL can't express the classifier, the sketches or the merges: tests/llm compares each stage's rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        discard(before)
    return docs

"""From raw documents to token digests: one training-data operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, crf_language, decontaminate, jaccard, pii
from sparkloom.llm.common import cut, table

#: A text of whose trigrams the training texts have less than this share is in no learned language, whichever fits best.
LEAST_KNOWN = 0.5
#: Columns that stages read; others are set aside under other names while an operator adds its own.
READ = ("doc_id", "text", "lang", "n_chars")


def set_aside(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({c: f"__kept_{c}" for c in docs.columns if c not in READ})


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c if c in READ else f"__kept_{c}").alias(c) for c in columns))


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters (null and empty ones too), and those in no learned language: junk, or a language that
    no labelled document has. Without labelled documents all stay. Texts are read whole; repeated rows are judged alike."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = crf_language.train(docs.where(~held_out))
    if not model.languages:  # nothing to learn from, so nothing to reject by
        return docs
    labelled = crf_language.detect(set_aside(docs), model)
    return restored(labelled.where((F.col("lang_pred") != "und") & (F.col("known") >= LEAST_KNOWN)), docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that links of similarity 0.8 or more connect: the one with the least id, of repeated
    rows one. Documents without words (null and empty ones too) stay."""
    return jaccard.deduplicate(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item. Null and empty texts hold none and stay, as all do without
    items; repeated rows are judged alike."""
    judged = decontaminate.decontaminate(set_aside(docs), table(spark, sf_dir, "benchmark"))
    return restored(judged.where(~F.col("contaminated")), docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data and the terms that disclose it; n_chars follows the text. All rows stay, null texts too."""
    safe = pii.sanitise(set_aside(docs))
    if "n_chars" in docs.columns:
        safe = safe.withColumn("n_chars", F.length("text").cast("long"))
    return restored(safe, docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row a document; null text is empty."""
    return bpe.encode_decode(docs, bpe.vocabulary())


STAGES = [
    ("language", in_a_language),
    ("near_copies", without_near_copies),
    ("benchmarks", without_benchmarks),
    ("personal_data", without_personal_data),
    ("bpe", encoded),
]
#: A conditional random field and a BPE encoder can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs

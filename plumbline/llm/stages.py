"""The corpus pipeline's stages: quality rules, near-duplicates, personal data, mixing, byte-level BPE.

Each stage takes all that the one before it kept, is written as Parquet in the
shared checkpoint folder, and is read again for the next. The first four
return the columns of the documents, further columns passed on; the last
returns token ids. An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, mixing, pii, quality_rules, simhash
from plumbline.session import read_table, remove_folder, shared_folder


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose posterior by the weighed rules says good.

    A null, empty or blank text shows no sign of a good one and goes; long
    texts are judged whole; a text of few words is judged like any other.
    Equal texts stay or go together, and repeated rows all stay. Nulls in
    other columns mean nothing here.
    """
    return quality_rules.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each class of near-duplicates (five-word shingles, 0.8 or more alike).

    Null and empty texts are one class. Texts of fewer than five words are
    compared as one shingle, long ones whole. Of rows that repeat id and text
    one stays; of rows that share the least id, that of the least text hash;
    rows without an id all stay, as nothing tells them apart.
    """
    return simhash.keep_one(docs, words=5, similarity=0.8)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates in the place of personal data and secrets; n_chars follows.

    Null and empty texts stay as they are, n_chars of a null text is null;
    long texts are searched whole; equal texts get equal surrogates, and every
    row stays.
    """
    out = pii.replace(docs)
    if "n_chars" in out.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: none, once or more.

    A null source is a source of its own. Null, empty and blank texts have no
    words and are never taken. Rows that share id, source and length share out
    what the mix takes of them; a text of any length counts whole.
    """
    return mixing.take(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each taken document as digests, one row for each of its rows.

    A null text counts as empty: no ids. Long texts are encoded whole, equal
    texts to equal ids; ids of documents are passed on, null ones too.
    """
    encoded = bpe.encode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), split_pattern())
    return bpe.digests(encoded)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("pii_surrogates", pii_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]

#: EM, BK-trees and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents table; what a stage wrote is deleted once the next one is written."""
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before is not None:
            remove_folder(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)

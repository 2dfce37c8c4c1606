"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

1. quality: documents that the co-trained classifier rejects go.
2. exact_dedup: one document of each group of equal texts stays.
3. near_dedup: one document of each component of near copies (fingerprints within two bits, or five-word shingles with a Jaccard similarity of 0.8 or more) stays.
4. mixing: sources are mixed to target weights; documents repeat or are cut as the mix takes them.
5. tokens: what is left is encoded with a public SentencePiece vocabulary, and decoded.

All but the last return the columns of ``documents``, whatever further ones it has.

Near dedup links what the SimHash operator links (op1's index of positional
bytes, tally of hits and bits that differ), whole. Copies of a similarity of
0.8 that differ in more bits are out of the reach of positional bytes, so an
exact join of the whole sets links them too (``near_dedup``).

Defined results, for every stage: null and empty texts are documents like any
other; repeated rows are judged alike, and dedup keeps one of them; ties go to
the smaller id; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import exact_dedup, mixing, near_dedup, quality, sentencepiece, simhash
from foliospark.llm.common import drop_at_end, shared_dir, table

MODEL = "piece_bpe_32k.model"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the stage's own documents, finds good."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: those that fingerprints link, and those that whole sets do."""
    return near_dedup.near_dedup(docs, linked=simhash.row_groups(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and digests of ids and decoded texts."""
    return sentencepiece.encode_decode(docs, public_tokenizers.path(MODEL), keep_ids=True).drop("decoded")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: The classifier, the components, the seeded draw and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them tables in the shared folder, which go when the application ends."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/foliospark/pipeline-{uuid.uuid4().hex}"
    drop_at_end(spark, base)
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

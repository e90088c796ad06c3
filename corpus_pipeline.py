"""The corpus pipeline: toxic and poor documents go, one of each group of near copies stays, sources are mixed, ids come out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; between stages docs are written as
Parquet to the shared folder and read again.  Near copies: word shingles of five, similarity 0.8 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm.common import stored, table, tokenizer_path
from tracewright.llm.mixture import mixed
from tracewright.llm.ngram_join import one_of_each
from tracewright.llm.quality_rules import without_rejected
from tracewright.llm.sentencepiece_bpe import encode_documents
from tracewright.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_rejected(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, size=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_join),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Classifier votes, divergences and tokenizer ids are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs

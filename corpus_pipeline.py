"""The corpus pipeline: from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  Columns of any
other name pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.llm import language, mixing, packing, simhash, suffixes
from splicelake.llm._runtime import load, materialize
from splicelake.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language of their own go: no letters, or no language with two fifths of the words.

    Null and empty texts go; repeated rows are judged alike; texts are judged whole.
    """
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one of smallest doc_id, of ties the least text.

    Texts without words count as one component; rows without doc_id stay.
    """
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under a string of 100 bytes that also starts earlier are cut out of the text.

    Null texts stay null and short ones whole; of equal texts the first by doc_id stays.
    """
    cut = suffixes.mark(docs, keep_text=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, so that sources reach their target weights.

    A null source is a source; a document of no words takes nothing but may repeat; reruns agree.
    """
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in packed sequences; a null text is a piece of one id."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language identification", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages count n-grams, hash and encode: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i + 1}")
    return docs

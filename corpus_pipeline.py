"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``sf_dir``
is read for labels and for the texts they label.  Between stages rows are written and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from octavilla.llm.common import stored, table
from octavilla.llm.mixing import mix
from octavilla.llm.near_copies import keep_one
from octavilla.llm.packing import pack_documents
from octavilla.llm.quality import keep_selected
from octavilla.llm.suffixes import remove_repeats

#: Tokens of a packed sequence; the id that ends a document.
CAPACITY, END = 4096, 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the ordinal classifier rejects."""
    return keep_selected(spark, docs, sf_dir)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return keep_one(spark, docs, sf_dir)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 400 bytes and passages of over 50 words that occur more than once; every document stays with what is left."""
    return remove_repeats(spark, docs, sf_dir, passages=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of scarce domains up to the target weights; none is left out."""
    return mix(spark, docs, sf_dir)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences: one row per piece."""
    import public_tokenizers
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END, CAPACITY)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]

#: Learnt models, sampled hashes and induced sorting have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality rules, near-duplicates, repeated passages, private data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to the shared folder
and reads it again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidline.llm.neardup import one_of_each_likeness_group
from braidline.llm.packing import pack
from braidline.llm.pii import pseudonymized
from braidline.llm.quality import only_kept
from braidline.llm.queries import PII_KEY
from braidline.llm.substrings import without_repeats
from braidline.runtime import cut, table


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs with the columns of like; n_chars, where it is one of them, follows the text."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*(f"`{c}`" for c in like.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others, of null ids and repeated ones too, stay as they are. Null and empty texts have no words, and are rejected."""
    return only_kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, with its columns: of five-word shingles with a likeness of 0.8 or more. Texts without words are one group; rows without ids stay."""
    return one_of_each_likeness_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier in the corpus are cut out; all documents stay, also those that lose all words. Null texts stay null."""
    return _counted(without_repeats(docs), docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private strings are replaced by surrogates; all documents stay. Null texts stay null."""
    return _counted(pseudonymized(docs, PII_KEY), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences: a row for each piece of a document, with its ids. Null and empty texts are their end id alone."""
    return pack(docs, path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("private_data", private_data), ("packing", packing)]

#: Tokens and XXH64 have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""From documents to packed training sequences: quality, near duplicates, personal data, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwick.llm.jaccard import JoinRules, one_of_each
from tarnwick.llm.mixing import mixed
from tarnwick.llm.packing import pack
from tarnwick.llm.pii import mask_pii
from tarnwick.llm.quality import keep_clean
from tarnwick.runtime import materialize, ship, table

#: SQL cannot express suffix arrays, the random field or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep. Null, empty and short texts go, repeated rows and null keys are judged each, an empty table stays empty."""
    ship(spark)
    return keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least key, of each group linked by 0.8 of their five-word shingles. Texts without words link to none and stay, null keys come last, rows of one key are told apart, an empty table stays empty."""
    ship(spark)
    return one_of_each(docs, JoinRules(words=5, percent=80))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked in their texts. Null and empty texts, null keys and repeated rows stay as they are, an empty table stays empty."""
    ship(spark)
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. Texts without words are not taken, a null source is one, rows of one key count each, an empty table stays empty."""
    ship(spark)
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences. Null and empty texts are documents of the end id, null keys stay null, rows are packed each, an empty table gives no pieces."""
    ship(spark)
    return pack(docs)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("pii", personal_data), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

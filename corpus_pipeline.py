"""A corpus made ready for training, in five stages: language, exact copies, near copies, repeated passages, packing.

Every stage is `(spark, docs, sf_dir) -> DataFrame`. Its result is written as Parquet in the shared folder and read
again as the next stage's `docs`. All stages but the last return the columns of `documents` (any extra columns pass).

| stage | operator | what goes |
| --- | --- | --- |
| language | family first, pairwise SVMs (2) | documents without a language: no text or no letter in it |
| exact | Golomb-coded fingerprints (6) | all but one of equal texts, white space aside |
| near | weighted MinHash of TF-IDF shingles (8) | all but one document of each class |
| passages | fixed-block anchors (9) | every word of a passage of 20 words that occurred before; documents left empty |
| packing | grouping genetic algorithm (7) | nothing: the pieces of all documents and their places |

`docs` may be empty, rows may repeat, any column may be null: the operators define each case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmine.llm import exact_dedup, language, near_dedup, packing, substring_dedup
from clipmine.llm.tables import stored
from clipmine.session import configure

#: The stages name a language, compare texts by sampling and pack by a search: SQL can't express them.
ORACLE_SQL = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language. The models are fitted on the labelled ones among them that aren't held out."""
    labelled = docs.where(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    found = language.predicted(docs, language.fit(labelled), docs.columns, ("_lang_pred", "_lang_score"))
    return found.where(F.col("_lang_pred") != language.UNDETERMINED).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.kept(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts: the one with the smallest doc_id."""
    return near_dedup.kept(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that occurred before; n_chars follows the text, a document left empty goes."""
    changed = F.col("_n_removed") > 0
    out = substring_dedup.deduplicated(docs, "_n_removed").where(~changed | (F.col("text") != ""))
    length = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all documents in sequences of 1024 tokens."""
    return packing.placements(docs)


STAGES = [
    ("language", identified),
    ("exact", without_copies),
    ("near", without_near_copies),
    ("passages", without_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`; the rows of the last."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs

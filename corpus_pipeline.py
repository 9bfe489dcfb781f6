"""The corpus pipeline: language ID, quality rules, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; what it returns is written as Parquet and
read again as the next stage's input. All stages but the last return the columns of ``docs``, whatever their names.

Defined cases: null and empty texts, and those without a letter, are rejected by ``language``, and by ``rules``, whose
least number of words they miss; ``near_duplicates`` takes all texts without words for one class, and ``pack`` gives
them one word. Very long texts are read whole and packed in pieces. Of equal languages the first by name wins, of equal
ids the least digest stays, and equally large items are packed by id. Repeated rows are judged alike by ``language`` and
``rules``, one of them stays after ``near_duplicates``, and ``pack`` deals each of them. Null ids are kept as they are.
Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simstrata.llm import langid, neardup, packing, quality
from simstrata.llm.common import drop_written, written

#: Texts whose best language gets less than this share are rejected (with four languages a guess gets 0.25).
MIN_SCORE = 0.3

#: Trained models and similarity verification have no counterpart in SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts whose language isn't clear."""
    judged = langid.predict(docs, langid.fit(docs), lang_pred="__lang", score="__score")
    return judged.where((F.col("__lang") != "und") & (F.col("__score") >= MIN_SCORE)).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that fail the base counts or are depleted; the frequent lines of the others are removed."""
    cleaned = quality.clean(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the text with the least id of each class."""
    return neardup.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack(packing.items_of(docs))


STAGES = [("language", language), ("rules", rules), ("near_duplicates", near_duplicates), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        after = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_written(before)
        docs = before = after
    return docs

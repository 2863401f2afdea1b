"""A corpus pipeline of five stages over `documents`; counted as part of tilewright.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, packing, pii, quality, shingle_join
from tilewright.llm.common import discard, table, written
from tilewright.llm.queries import TOKENIZER


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null or empty text: judged as the empty text; null ids, sites and languages: kept or not like any. Very long texts:
    whole. Ties at the threshold stay. Repeated rows: judged alike. An empty table: empty. Columns named like the scores
    keep their values.
    """
    own = {c: f"__own_{c}" for c in docs.columns if c in quality.ADDED}
    kept = quality.score_quality(docs.withColumnsRenamed(own), table(spark, sf_dir, "labels")).where("keep")
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of the n-gram Jaccard join, at five words and a similarity of 0.8: the one of the lowest id.

    Null or empty text: linked with nothing, stays. Null ids: stay. Very long texts: whole sets. Repeated rows of an id:
    one stays. An empty table: empty. Other columns, of whatever name, are those of the row that stays.
    """
    return shingle_join.keep_first(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item.

    Null or empty text, null ids: stay. Very long texts: all their windows. All rows of an id go if one of them repeats
    an item. An empty table, or no items: nothing changes. Other columns, of whatever name, stay as they are.
    """
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; all stay.

    Null text: null. Empty text: empty. Very long texts: whole. Spans that touch or overlap: masked as one by the
    operator's rule. Repeated rows: each for itself. An empty table: empty. n_chars follows the text; other columns stay.
    """
    return pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; every document is in them whole.

    Null or empty text: one piece with the end token. Null ids: kept. Very long texts: cut over many sequences. Equal
    costs: the earlier cut. Repeated rows: packed one by one. An empty table: empty. Other columns are left out.
    """
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]
#: The stages aren't SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)

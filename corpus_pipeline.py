"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes what its predecessor kept. All but the last return the columns of documents, in their order; other columns
that are given with them, whatever their names, aren't read.

Results for odd input, of every stage: an empty table gives an empty table (an empty ``labels`` rejects nothing, an empty
``benchmark`` finds nothing); a null text is the empty text where it is scored, compared or packed, and stays null; a null
``doc_id`` is a document of its own; nulls in lang, source and n_chars stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm import decontaminate, line_dedup, near_dedup, packing, quality
from loglake.llm.common import Scratch, load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of 0.5 or more). Rows that repeat are scored alike, so all or none
    stay; null and empty texts, and any tie at 0.5, are decided by the bias alone; with no label to learn from all stay."""
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    return quality.keep_good(docs.select(*COLUMNS), model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; n_chars is the length of what is left, null for a null text. Every row stays, rows that
    repeat alike; a tie between copies goes to the smallest (doc_id, place), null ids first."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the smallest doc_id: five-word shingles, similarity 0.8. Of rows that
    repeat one doc_id, one stays; rows without a doc_id, and texts without a word unless their doc_id repeats, all stay."""
    return near_dedup.drop_near_duplicates(docs.select(*COLUMNS))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all rows of that doc_id; rows without a doc_id stay."""
    return decontaminate.remove_contaminated(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, without padding; a null or empty text is packed as its terminator alone; rows that repeat are
    packed once each."""
    return packing.pack(docs, with_ids=False).drop("ids")


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("packing", packing_stage)]
#: SQL can't express the classifier, the tokenizer or the packer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

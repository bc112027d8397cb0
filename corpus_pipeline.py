"""Corpus pipeline: quality rules, line dedup, near duplicates, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each result to the shared folder and reads it again as the
next stage's documents. All but the last return the columns of ``documents``; the last returns the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.llm.decontaminate import contamination
from hearthline.llm.frames import NO_ID, merged, stored, table, without
from hearthline.llm.jaccard import near_duplicates
from hearthline.llm.line_dedup import dedup_lines
from hearthline.llm.mixing import mix_sources
from hearthline.llm.quality import fit_lines, line_quality
from hearthline.plans.catalog import query


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go. Rows equal in id and text share their verdict."""
    verdict = line_quality(docs, fit_lines(docs, table(spark, sf_dir, "labels")))
    return without(docs, verdict.where("not kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents stay in one; texts lose the others and n_chars follows. A document may become empty."""
    out = dedup_lines(docs)
    new = {"text": F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*docs.columns)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, the one with the smallest id stays; documents without words stay all.

    Repeated rows of one id are copies as well: the row with the smallest text key stays, and of equal rows one.
    """
    found = stored(near_duplicates(docs), "groups")
    stay = found.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct("id", "key")).alias("first"))
    first = stay.select("group", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key"))
    gone = found.where("n_shingles > 0").join(merged(first), "group").where((F.col("id") != F.col("first_id")) | (F.col("key") != F.col("first_key")))
    left = without(docs, gone)
    # Equal rows have one id and key; only ids that occur more than once need a look.
    again = found.where((F.col("n_shingles") > 0) & (F.col("id") != NO_ID)).groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return left
    rest = without(left, again)
    return rest.unionByName(left.exceptAll(rest).dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each remaining document."""
    out = mix_sources(docs)
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "size", "source_size", "target", "taken")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicate_groups),
    ("decontamination", decontamination),
    ("source_mixing", source_mix),
]

#: The labels of the first stage and the knapsack of the last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


query("pipeline", ORACLE_SQL)(run)

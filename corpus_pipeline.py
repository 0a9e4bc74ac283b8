"""Corpus preparation: five stages over `documents`, each written and read again before the next.

Every stage works on all rows its predecessor kept. All but the last return the columns of `documents`; the last adds
the mix: size, source_size, target, repeats, taken. No SQL is given, since the toxicity model isn't expressible in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import crc_mod, stored, table
from plumbline.llm.decontaminate import flag_contaminated
from plumbline.llm.jaccard import drop_near_copies
from plumbline.llm.mixing import mix_sources
from plumbline.llm.substrings import remove_repeats
from plumbline.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3 by a model fitted on the labelled ones among them."""
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)
    scored = score_toxicity(docs, fit_toxicity(docs, labels), score_col="__toxicity")
    return scored.where("__toxicity < 0.3").drop("__toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a smaller doc_id has; n_chars follows the text."""
    out = remove_repeats(docs)
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without template windows of the benchmark."""
    flagged = flag_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return flagged.where("not contaminated").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the number of times the mix takes it."""
    return mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("jaccard", drop_copies), ("substrings", drop_passages), ("decontamination", drop_leaks), ("mixing", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

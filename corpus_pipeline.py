"""Corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again for the next one. All but the last keep the columns of ``documents``. Repeated rows are
handled as the operators define; null ids never match a decision by id and are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, linededup, mixing, quality, simhash
from corpusloom.llm.common import Scratch, stored, without_ids
from corpusloom.session import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are rejected, as they have no perplexity. Repeated rows share their fate;
    null ids are scored like others; an empty table stays empty; added columns are carried.
    """
    scored, (_, _, keep) = quality.classify(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return scored.where(F.col(keep)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line stands for; n_chars follows the text.

    No document goes, even if its text becomes empty. Null texts stay null and their n_chars null;
    rows equal in id and text keep the same lines; null ids order last; an empty table stays empty.
    """
    out = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest id.

    Texts without words are one class. Rows that repeat the kept id stay, all of them; null ids stay;
    an empty table stays empty; added columns are carried whatever their names.
    """
    classes = simhash.near_duplicates(docs)
    gone = stored(classes.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "copies")
    return without_ids(docs, gone)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; every row of an id that holds one goes; null ids stay;
    an empty table or benchmark leaves the rest as it is; added columns are carried.
    """
    found = decontam.contaminated(docs, decontam.split_items(table(spark, sf_dir, "benchmark")))
    gone = stored(found.select("doc_id").distinct(), "leaks")
    return without_ids(docs, gone)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes.

    Null texts have size 0 and taken 0; null sources are one source, last in order; repeated rows each
    count; an empty table gives no rows.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Not expressible in SQL (trained model, MinHash, SimHash, BM25): tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; what a stage wrote is deleted when the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = scratch.stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before:
            before.drop()
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)

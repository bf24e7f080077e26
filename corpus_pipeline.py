"""A training-corpus pipeline of five operators, each working on what the one before it kept.

language ID (documents without a language, or unlike all of them, go), line dedup (lines shared by three documents or
more stay in one), SimHash near-dedup (links of fingerprints, each verified, and an exact pass for pairs beyond their reach:
of documents with a Jaccard similarity of 0.8 or more over five-word shingles, one stays), benchmark decontamination (documents that hold a benchmark item go), packing into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm import decontam, langid, linededup, packing, simhash
from arrears.llm._common import Scratch, fresh, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Models are learned from the labelled documents, then every text is scored."""
    model, own = langid.fit(docs), fresh(docs, "_langid")
    return langid.identify(docs, model, prefix=own).where(~F.col(own)["rejected"]).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = fresh(docs, "_kept")
    out = linededup.drop_lines(docs, kept=kept, n_lines=fresh(docs, "_n_lines"), n_dropped=fresh(docs, "_n_dropped"))
    new = {"text": F.col(kept), "n_chars": F.char_length(kept).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]
ORACLE_SQL = None  # language models, fingerprints and tokens have no SQL; tests hold the stages to brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, scratch, docs = list(Scratch.alive), Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = scratch.save(stage(spark, docs, sf_dir), name), docs
        Scratch.release([*held, scratch])  # what the stage wrote for itself
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

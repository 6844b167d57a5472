"""Corpus preparation in five stages, each written as Parquet and read again by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the
documents it keeps. All but the last return the columns of ``documents``; texts that a stage
changes get their new length in n_chars.

Cases, for every stage: an empty table gives an empty table; extra columns pass through,
also those named like a stage's own columns (case aside, such a name would clash); a null
text is a document without a language and goes in the first stage, and the later ones, called by
themselves, keep it; rows with a null doc_id are documents of their own; very long texts are read whole.
Repeated rows are kept by all stages but near_dedup, which keeps one row of a doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common, decontaminate, langid, mixing, neardup, pii


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    out = docs.select(like.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in like.columns else out


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language can be told; lang becomes the predicted one. With no label to learn from, none can."""
    model = langid.fit(docs)
    found = langid.identify(docs, model).filter("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by five-word shingles at a similarity of 0.8.

    Of rows that share a doc_id, which act as one document, the least text stays.
    """
    groups = common.stage(neardup.near_duplicates(docs, shingle=5, percent=80).select("doc_id", "kept"), "groups")
    gone = common.stage(groups.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    once = common.without_keys(docs, gone, "doc_id")
    repeated = common.stage(groups.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return once
    least = once.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row"))
    return once.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(least.select("row.*"))


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out; drops documents that are mostly benchmark text."""
    hits = decontaminate.find_hits(docs, common.table(spark, sf_dir, "benchmark"))
    return _columns(decontaminate.remove_hits(hits), docs)


def personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the kind in brackets."""
    return _columns(pii.redact(pii.find_spans(docs, pii.fit(docs))), docs)


def source_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds rates fitted to the target shares, and repeats each document copies times (not at all for 0)."""
    labels = mixing.label_domains(common.table(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs, labels, mixing.SHARES)
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
]

#: Trained models decide in three stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = common.stage(function(spark, docs, sf_dir), name)
    return docs

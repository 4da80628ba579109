"""Corpus cleaning pipeline over ``documents``: five stages, each on all that the stage before kept.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of docs. ``run`` writes each result as Parquet in the shared
folder and reads it again as the next stage's docs; a stage's own tables, and the input
that it has read, are removed as soon as its result is written.

In every stage an empty table gives no rows, whole texts are read however long they are,
and further columns keep their values whatever their names; what a stage does with nulls,
empty texts, ties and repeated rows is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import jaccard_join, line_dedup, packing, quality_rules, secret_scan
from tessella.llm.common import Scratch, owned, table

#: Share of its text (code points without line ends) that a document may lose to line dedup; one that
#: loses as much or more is a near copy of earlier ones, by the similarity of near duplicates, and goes.
REPEATED = 0.8

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the decision list learned from ``labels`` rejects go, and repetitive ones of 50 words or more.

    Of the base rule of the op7 query its repetition half judges, with or without labels;
    the other half (fewer than 50 words) would take short clean documents.
    Null, empty and blank texts have no words and stay, unless a learned rule takes them;
    repeated rows are judged alike; without labels of both classes there is no list.
    """
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("text", F.struct("*").alias("row"))  # columns of docs keep their names whatever the operator adds
    repetitive = F.col("base_failed") & (F.col("stats.n_words") >= 50)
    return quality_rules.judge(rows, rules).where((F.col("rule") == 0) & ~repetitive).select("row.*")


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line of the corpus go; so do documents that lose all their words, or REPEATED of their text, by it.

    A near copy of an earlier document would else go on as the scraps that differ, which the
    next stage can't know again. Null, empty and blank texts and rows with null doc_id stay as
    they are; rows of one doc_id are one document; of equal lines the first by doc_id and place stays.
    """
    out = line_dedup.dedup(docs).where((F.col("n_removed") == 0) | F.col("row.text").rlike(r"[^\x20\x09-\x0D]") & (F.col("share_removed") < REPEATED))
    return _measured(out.select("row.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays.

    Null, empty and blank texts are no copies of one another and stay; rows with null doc_id stay;
    of rows with one doc_id the least by their other columns stays.
    """
    return jaccard_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials, whole or linked from parts, are replaced by a mark. Null and empty texts stay; equal texts are changed alike."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents packed into sequences of at most 1024 tokens. Null and empty texts are one end id; repeated rows are packed one by one."""
    return packing.pack(docs)


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is one, following the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(docs.columns)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_repeats),
    ("jaccard_join", near_duplicates),
    ("secret_scans", secrets),
    ("best_fit_packing", packed),
]
#: Learned lists, components, linked credentials and bin packing have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir; they are lazy, so their tables stay until the process ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = Scratch(spark)
        with owned():
            docs = kept.save(stage(spark, docs, sf_dir), name)
        if before:
            before.close()
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)

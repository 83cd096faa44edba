"""From raw documents to token ids, in stages; each takes what its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, all but the last with the columns of docs.  Each leaves
the rows of an empty table empty, takes null and empty texts as texts without words, keeps rows without doc_id
apart from all others, and passes columns that it doesn't know on as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, decontamination, line_dedup, ngram_join, quality_rules
from rasterloom.llm.common import forget, keep, kept_now, release, table, unused
from rasterloom.llm.pieces import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_earlier: set[str] = set()


def after_the_last(stage: Stage) -> Stage:
    """stage, which first deletes what the stage before it has kept: its result is written by then, or docs reads it still."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_earlier, docs)
        before = kept_now()
        out = stage(spark, docs, sf_dir)
        _earlier.clear()
        _earlier.update(kept_now() - before)
        return out

    return run


@after_the_last
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects, or that fail the base rules, go."""
    whole = docs.select(F.struct(*docs.columns).alias("whole"), "text")
    return quality_rules.judged(whole, drop_text=True).filter("q_kept").select("whole.*")


@after_the_last
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines, and of lines of five words or with ten copies, are deleted; a document of which nothing else is left goes."""
    deleted = unused(docs, "n_deleted")
    left = line_dedup.without_lines(docs, line_dedup.repeated_lines(docs, **line_dedup.SHORT), deleted)
    some = F.length(F.translate("text", quality_rules.BLANKS, "")) > 0
    left = left.filter((F.col(deleted) == 0) | some)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(deleted) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


@after_the_last
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words and a similarity of 0.8 or more, the one with the smallest id stays."""
    grouped = ngram_join.groups(docs.select("doc_id", "text"), n=5, threshold=0.8)
    gone = grouped.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@after_the_last
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak_id")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["leak_id"]), "left_anti").select(*docs.columns)


@after_the_last
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (32-bit numbers in a row), and digests of the ids and of what they decode to."""
    return bpe.digests(docs, vocabulary("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE", tokens),
]

#: The quality model is fitted by iteration and the last stage encodes, which SQL can't express; tests hold every
#: stage against a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        written = keep(docs) if i else docs
        if i > 1:
            forget(before)
        docs, before = stage(spark, written, sf_dir), written
    return docs

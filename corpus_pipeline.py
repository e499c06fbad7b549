"""Corpus preparation in five stages, each one operator of ``concordia.llm``.

Every stage is written as Parquet in the shared folder and read again by the next one, so a
lost executor costs at most the stage it worked on.  A stage begins by deleting the scratch
tables of the stage before it, whose result is written by then.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.common import drop_table, owned, release, written
from concordia.llm.decontaminate import decontaminate
from concordia.llm.lines import dedup_lines
from concordia.llm.mixing import take
from concordia.llm.neardup import keep_one
from concordia.llm.quality import keep_clean

#: Of each thread: the scratch tables of the stage it called last.
_last = threading.local()


def stage(f: Callable) -> Callable:
    """A stage that first deletes the scratch tables of the one before it."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if f.__name__ != "quality":  # the first stage leaves a former run's last result alone
            release(spark, getattr(_last, "tables", []))
        with owned([]) as _last.tables:
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, with the evidence of their source and language, doesn't reject."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, but for two characters at most, earlier; those left blank by that go."""
    rows = dedup_lines(docs, counts=True, edits=2).where((F.col("n_dropped") == 0) | (F.trim(F.translate("text", "\n", " ")) != ""))
    rows = rows.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8 or more)."""
    return keep_one(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words in a row of a benchmark item, nor a whole shorter one."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return take(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
]

#: Logistic regression, MinHash and entropy balancing have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; a stage's table is deleted once the next one's is written, so that the last input alone stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
            if i:
                drop_table(before)
    return docs

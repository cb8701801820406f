"""A training-data pipeline over the documents table: five stages, each written and reread as the next one's input."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, neardup, pii, quality
from tidemark.llm.common import ROW, numbered, recorded, swept, table, written

#: Paths of the tables that earlier stages wrote for themselves.
LEFT: list[str] = []


def cleared(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage; as its input is written by then, what earlier stages left on the disk goes first, but for tables that the input reads."""

    @functools.wraps(stage)
    def after_sweep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        swept(docs, LEFT)
        with recorded(LEFT):
            return stage(spark, docs, sf_dir)

    return after_sweep


@cleared
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go; the verdict is the row's own, whatever identifier it has."""
    rows = numbered(docs)
    steps: list[str] = []
    with recorded(steps):
        gone = written(quality.quality(rows, carry=(ROW,)).where(~F.col("kept")).select(ROW))
    swept(gone, steps)
    return rows.join(gone, ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@cleared
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of near duplicates stays."""
    return neardup.keep_one(docs)


@cleared
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text."""
    return pii.masked(docs)


@cleared
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources come more than once, none is lost."""
    return mixing.mix(docs)


@cleared
def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and of the decoded text."""
    return bpe.encode_decode(docs, carry=("doc_id", "lang", "source"), ids=True)


STAGES = [("quality rules", quality_rules), ("n-gram jaccard join", jaccard_join), ("pii", personal_data), ("mixing", source_mixing), ("bpe", bpe_encoding)]

#: Byte-pair encoding has no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        with recorded(LEFT):
            docs = written(kept)
    out = STAGES[-1][1](spark, docs, sf_dir)
    LEFT.clear()  # the result reads the last table
    return out

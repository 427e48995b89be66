"""A corpus pipeline: documents in, packed token sequences out.

Each stage works on all that its predecessor kept; its result is written as
Parquet and read again as the next stage's documents.  The tables that a stage
has written for itself are deleted when the same application's next stage
begins, whose input is then complete: a stage's result is to be written before.

Defined results: an empty table gives an empty one; null and empty texts are
rejected by the quality rules; texts of any length go through whole, and are cut
into pieces by the last stage only; of repeated rows with one id, and of equal
or near texts, one of each class stays, that of the smallest id; documents whose
language is null are neither learned from nor dropped; extra columns, whatever
their names, are kept up to the last stage, which returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tetrad.llm import jaccard, mixing, packing, quality, repeats, shared
from tetrad.llm.queries import TARGETS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: By application, the paths of tables whose stage is done when the next one begins.
_done: dict[str, list[str]] = {}


def _stage(work: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        done = _done.setdefault(spark.sparkContext.applicationId, [])
        shared.delete(spark, done)
        first = shared.written_since()
        out = work(spark, docs, sf_dir)
        done.extend(shared.written_since(first))
        return out

    run_stage.__name__, run_stage.__doc__ = work.__name__, work.__doc__
    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents stays, that of the smallest id."""
    return jaccard.one_of_each(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes inside repeated strings of 200 bytes go."""
    return repeats.remove(docs)


@_stage
def language_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of scarce languages are repeated until tokens match the target weights; none is dropped."""
    return mixing.mixed(docs, docs, TARGETS, floor=1.0)


@_stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, packed into as few sequences as the packer finds."""
    return packing.pack(docs, "word_bpe_49k.json", end_id=1, capacity=4096)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("language_mix", language_mix),
    ("packed_sequences", packed_sequences),
]

#: SQL cannot express the tokenizer or the fit; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; the last one's rows."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        first = shared.written_since()
        docs = shared.written(stage(spark, docs, sf_dir), name)
        shared.delete(spark, before)
        before = shared.written_since(first)
    return STAGES[-1][1](spark, docs, sf_dir)

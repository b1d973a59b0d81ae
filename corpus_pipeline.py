"""The corpus pipeline: documents -> quality rules -> SimHash near-dedup -> substring dedup -> packing.

Each stage takes what its predecessor kept, from Parquet in the shared folder, and
decides on that input alone. All but the last return the columns of `documents`, in
their order; further columns of any name are carried along. An empty table gives an
empty one in every stage.

A stage is called when its predecessor's result is written: it begins by dropping what
the predecessor has written on its way, so that the shared folder holds one stage's
intermediates at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from examlens.llm import packing, quality, simhash, substring
from examlens.llm.common import drop, read_table, recorded, written
from examlens.llm.queries import END_ID


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# What the last call of each stage has written, by application and place.
_written: dict[tuple[str, int], list[str]] = {}


def _stage(place: int) -> Callable[[Stage], Stage]:
    """The stage at a place of the pipeline, which drops what the one before has left behind."""

    def made(function: Stage) -> Stage:
        @functools.wraps(function)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            application = spark.sparkContext.applicationId
            read = docs.inputFiles()
            left = _written.pop((application, place - 1), [])
            # A result that was not written still reads them.
            drop(spark, [p for p in left if not any(p.rpartition("/")[2] in f for f in read)])
            with recorded() as paths:
                found = function(spark, docs, sf_dir)
            _written[application, place] = paths
            return found

        return run_stage

    return made


@_stage(0)
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null or empty text fails the base rules and goes; a null language is a stratum of
    its own; repeated rows are judged alike; a document without id counts as not labelled.
    """
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    judged = quality.quality_rules(docs, labels, carried=tuple(docs.columns), risk=quality.JOINT)
    return judged.where("kept").select(f"{quality.CARRIED}.*")


@_stage(1)
def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Null and empty texts are one group; a null id comes last; of rows that are equal one
    stays, of different ones under one id that with the smallest hash.
    """
    return simhash.one_per_group(docs)


@_stage(2)
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too go, and documents of which nothing is left.

    Null and empty texts have no passages and stay as they are; a row without id comes
    after all others; rows of one id take nothing from each other. `n_chars` follows
    the new text.
    """
    return substring.without_repeats(docs)


@_stage(3)
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids' checksum.

    A null or empty text gives its end id alone; null and repeated ids are documents
    like any other; ties cannot arise, as documents follow in the order of their files.
    """
    return packing.with_crc32(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", simhash_stage),
    ("repeated_passages", substring_stage),
    ("packing", packing_stage),
]

# Tokenizers, SimHash and its components are beyond SQL; the tests hold a brute force against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left; of the stages' results only the last is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        with recorded() as paths:
            docs = written(found, f"pipeline_{name}")
        drop(spark, before)
        before = paths
    return STAGES[-1][1](spark, docs, sf_dir)

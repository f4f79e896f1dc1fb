"""The corpus pipeline: documents through quality rules, language ID, near-duplicate removal, decontamination and encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents. Each
handles nulls in any column, empty texts, repeated rows, extra columns and empty tables as its operator's docstring says.

A stage's result is to be written before the next stage is called: the tables that stand behind it are then dropped, and the
shuffle files of its jobs go, so that the pipeline never holds more disk than its largest stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import bpe_encode
from quarry.llm.common import fold, unpack
from quarry.llm.decontaminate import leaks
from quarry.llm.langid import identify
from quarry.llm.quality import quality_rules
from quarry.llm.queries import tokenizer_file
from quarry.llm.simhash import similar_groups
from quarry.plans.shared import drop_shared, recorded, release, shared_table, table

#: Least posterior of a predicted language.
LEAST_LANGUAGE = 0.4


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_behind: list[DataFrame] = []  # tables of the stage called last


def stage(made: Stage) -> Stage:
    """Drops what the stage before left when this one is called, and keeps note of its own tables."""

    @wraps(made)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_shared(*_behind)
        _behind.clear()
        release(spark)
        with recorded() as tables:
            out = made(spark, docs, sf_dir)
        _behind.extend(tables)
        return out

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go."""
    return unpack(quality_rules(docs).where("kept"))


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with an unsure one, go."""
    found = identify(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), fold(F.col("doc_id"), 4) != 2, keep_text=True)
    return unpack(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id."""
    return unpack(similar_groups(docs).where("stays"))


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return unpack(leaks(docs, table(spark, sf_dir, "benchmark"), keep_text=True).where("size(leaks) = 0"))


@stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, number of tokens, ids (four bytes each, the least first) and the digest of the decoded text."""
    out = bpe_encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_file(), as_bytes=True)
    return out.select(
        "_row.doc_id", "_row.lang", "_row.source", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: SQL can't express the language, similarity and encoding stages; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for _, one in STAGES[:-1]:
        docs, before = shared_table(one(spark, docs, sf_dir)), docs
        drop_shared(before)  # the input itself is left alone
    return STAGES[-1][1](spark, docs, sf_dir)

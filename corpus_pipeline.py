"""The corpus pipeline: language, exact copies, near copies, benchmark leaks, tokens.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns the documents that stay, with the
columns of documents, the last one the tokens. run() writes each stage's rows to the shared folder and reads them again.

Defined cases: documents whose text is null or has no letter are rejected by the first stage, all others with a letter
stay (also where no language could be learned, or a prediction is ambiguous). What stays is decided row by row: a row is
named by its doc_id and its text, so rows that share their doc_id only, null ones included, are documents of their own.
Of rows with equal id and text one stays; of a group of copies the row with the smallest doc_id, null ones last. Empty
tables give no rows at any stage.

Whole texts and sets of shingles meet Python at every stage. Where the session has no limit of its own for the bytes of an
Arrow batch, the stages set one of BATCH_BYTES, which stays set: by default a batch may take 64 MB, several times over in
the executor and in its workers. Batches don't change a result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailstone.llm.bpe import bpe_round_trip
from trailstone.llm.common import bucket_of, staged
from trailstone.llm.decontaminate import find_leaks
from trailstone.llm.exact_dedup import exact_dedup
from trailstone.llm.langid import fit_language_model, identify_language
from trailstone.llm.near_dedup import near_dedup

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(f: Stage) -> Stage:
    """The stage, with Arrow batches of BATCH_BYTES unless the session says otherwise."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_LIMIT, None) is None:
            spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
        return f(spark, docs, sf_dir)

    return run


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column, of a name that none of its own has, that names each row by its doc_id (null last) and its text."""
    name = "_" + "".join(docs.columns)
    return docs.withColumn(name, F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), _digest(F.col("text")).alias("text"))), name


def _kept(docs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Of docs the rows that an operator keeps, one of each name."""
    kept = found.where("kept").select(F.col("doc_id").alias(name)).distinct()
    # rows that repeat in id and text share their partition after the join
    return docs.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)


@_bounded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the language identifier rejects: texts it calls undetermined."""
    model = fit_language_model(docs.where(bucket_of("doc_id") != 0))
    named = identify_language(docs, model, carry=tuple(docs.columns))
    accepted: Column = F.col("lang_pred") != "und"
    if not model.learned:  # nothing was learned: a letter is all that can be asked for
        accepted = F.col("row.text").rlike(r"\p{L}")
    return named.where(accepted).select("row.*")


@_bounded
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    rows, name = _named(docs)
    return _kept(rows, exact_dedup(rows, id_col=name), name)


@_bounded
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    rows, name = _named(docs)
    return _kept(rows, near_dedup(rows, k=5, share=80, id_col=name), name)


@_bounded
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item, edited or not. That depends on the text only, which names the rows."""
    name = "_" + "".join(docs.columns)
    rows = docs.withColumn(name, _digest(F.col("text")))
    found = find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=name)
    return rows.join(found.select(F.col("doc_id").alias(name)).distinct(), name, "left_anti").drop(name)


@_bounded
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed) and the digest of the text that the ids decode to."""
    path = public_tokenizers.path(VOCABULARY)
    both = bpe_round_trip(docs, path, public_tokenizers.PATTERN)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("exact copies", exact_copies), ("near copies", near_copies), ("benchmark leaks", benchmark_leaks), ("tokens", tokens)]

#: Near copies, alignment and BPE are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"stage{i + 1}")
    return docs

"""Training-data pipeline over the documents table: five stages, each written and read again.

``STAGES`` holds (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents:

1. ``quality``: documents scored below the quality threshold go;
2. ``near_duplicates``: one document of each group of near-duplicates (five-word shingles, similarity 0.8) stays;
3. ``substring_dedup``: passages of 20 words and more that occur earlier go; a document that loses nothing
   keeps its text as it is, another keeps the other words joined by one space; a document that loses all its
   words goes;
4. ``mixing``: documents are drawn by the raked weights of their source, language and topic (the form, where there is none);
5. ``bpe``: what is left is encoded and decoded.

An empty table, null texts and null ids go through as each operator states. Columns besides those of documents travel
through every stage as one struct, so their names clash with nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowprism.llm import bpe, minmax, mixing, quality_classifier, recompression
from flowprism.llm.columns import fresh
from flowprism.session import prepare, scratch_path

RANKS = "byte_bpe_multi_50k.tiktoken"
#: SQL cannot fit the classifier; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None

#: Columns that stages read; all others are carried.
OWN = ("doc_id", "text", "lang", "source", "topic", "n_chars")


def carried(stage: Callable) -> Callable:
    """A stage that sees the columns of documents only, and one more that holds the others."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        more = [c for c in docs.columns if c not in OWN]
        if not more:
            return stage(spark, docs, sf_dir)
        (held,) = fresh(docs.columns, "_carried")
        packed = docs.select(*[c for c in docs.columns if c in OWN], F.struct(*[F.col(f"`{c}`") for c in more]).alias(held))
        out = stage(spark, packed, sf_dir)
        return out.select(*[F.col(held)[c].alias(c) if c in more else F.col(f"`{c}`") for c in docs.columns])

    return run


@carried
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    return quality_classifier.score(docs, model).where(F.col("score") >= quality_classifier.THRESHOLD).select(*docs.columns)


@carried
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minmax.near_duplicates(docs, width=5, percent=80)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@carried
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = recompression.remove_repeats(docs)
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(columns).select(*docs.columns)


@carried
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(docs, {"topic": None})


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mixing", mixture),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

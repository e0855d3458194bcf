"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.llm import decontamination, jaccard_join, language_id, packing, suffix_repeats
from strayrow.llm.queries import PACK_TOKENIZER, table, tokenizer_path
from strayrow.workspace import materialize, shared_folder

#: Up to so many rows to be dropped are broadcast, 16 bytes each; more are joined by shuffling.
MAX_BROADCAST_COPIES = 1_000_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_row(docs: DataFrame) -> DataFrame:
    """(doc_id, text, all other columns in one): names of a stage's own columns can't clash with them."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*others).alias("_row"))


def _documents(df: DataFrame, like: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``like`` again; the number of characters follows the text."""
    columns = {c: F.col("_row")[c] for c in like.columns if c != "text"}
    columns["text"] = F.col(text)
    if text != "text" and "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast(like.schema["n_chars"].dataType)
    return df.select(*(columns[c].alias(c) for c in like.columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: null and empty texts and texts without any letter go, whatever the labels."""
    model = language_id.train(docs)
    found = language_id.identify(_with_row(docs), model, keep=("text", "_row"), with_letters=True)
    return _documents(found.where("has_letter"), docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, 0.8) one row of the smallest id stays.

    Rows of one id are documents of their own, told apart by their texts; of those with the smallest id of
    a group the one with the least hash of its text stays, and of equal ones any. Rows without id or
    without words stay.
    """
    columns = docs.columns
    found = jaccard_join.near_duplicates(docs, words=5, threshold=80)
    found = materialize(found.where("doc_id is not null and n_shingles > 0").drop("n_shingles"), "near-duplicates")
    keys = ["doc_id", "text_key"]
    first = F.col("component_id") == F.col("doc_id")
    repeated = found.where(first).groupBy("group_key").agg(
        F.min("doc_id").alias("doc_id"), F.min("text_key").alias("_least"), F.count("*").alias("_rows")
    )
    repeated = materialize(repeated.where("_rows > 1").drop("_rows"), "repeated-ids")
    copies = found.where(~first).select(keys)
    others = found.where(first).join(repeated.drop("doc_id"), "group_key").where("text_key <> _least").select(keys)
    copies = materialize(copies.union(others).distinct(), "copies")
    if copies.count() <= MAX_BROADCAST_COPIES:
        copies = F.broadcast(copies)
    whole = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row")
    keyed = docs.select("doc_id", jaccard_join.text_key(F.col("text")).alias("text_key"), whole)
    kept = keyed.join(copies, keys, "left_anti")
    if not repeated.isEmpty():
        twice = repeated.select("doc_id", F.col("_least").alias("text_key")).distinct()
        once = kept.join(twice, keys, "left_semi").dropDuplicates(keys)
        kept = kept.join(twice, keys, "left_anti").unionByName(once)
    return kept.select(*(F.col("_row")[c].alias(c) for c in columns))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes and more that a document with a smaller id has; all documents stay."""
    kept = suffix_repeats.remove_repeats(_with_row(docs), keep=("_row",), with_text=True)
    return _documents(kept, docs, "kept_text")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark passages."""
    judged = decontamination.contamination(
        _with_row(docs), table(spark, sf_dir, "benchmark"), keep=("text", "_row")
    )
    return _documents(judged.where(~F.col("contaminated")), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in a training sequence."""
    return packing.pack(docs, tokenizer_path(PACK_TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("suffix_array_dedup", repeats_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]
#: Training a classifier and tokenizing are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

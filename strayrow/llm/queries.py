"""The operators of this package as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.llm import (
    chat_format,
    conversation_repair,
    decontamination,
    jaccard_join,
    kdtree_search,
    language_id,
    lattice_lm,
    packing,
    quality,
    sharding,
    suffix_repeats,
    token_counts,
    tokenizer_alignment,
)
from strayrow.llm.oracles import ORACLES  # noqa: F401  (read with QUERIES)

PACK_TOKENIZER = "word_bpe_49k.json"
COUNT_TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(column: str, folds: int, fold: int) -> Column:
    """Whether a row's id falls in the given fold; a null id is in none."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == fold, F.lit(False))


def op1_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_repeats.remove_repeats(table(spark, folder, "documents"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), tokenizer_path(COUNT_TOKENIZER))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fold = held_out("doc_id", 4, 2)
    model = quality.train(docs, table(spark, folder, "labels"), held_out=fold)
    return quality.score(docs, model).select("doc_id", fold.alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_lattice_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return lattice_lm.score(docs, tokenizer_path(PIECES), held_out("doc_id", 5, 1))


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, folder, "documents"), words=4, threshold=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op8_topk(spark: SparkSession, folder: str) -> DataFrame:
    return kdtree_search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fold = held_out("doc_id", 4, 2)
    model = language_id.train(docs, held_out=fold)
    found = language_id.identify(docs, model)
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path(PACK_TOKENIZER))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, folder, "conversations"))
    mended = conversation_repair.repaired(rows, conversation_repair.audits(rows))
    return conversation_repair.digests(mended).drop("n_rows")


def op12_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat_format.digests(chat_format.windows(turns.unionByName(marked)))


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return tokenizer_alignment.align(docs, tokenizer_path(COUNT_TOKENIZER), tokenizer_path(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_repeats": op1_suffix_repeats,
    "op2_sharding": op2_sharding,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_lattice_lm": op6_lattice_lm,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_topk": op8_topk,
    "op9_language": op9_language,
    "op10_packing": op10_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_chat_format": op12_chat_format,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

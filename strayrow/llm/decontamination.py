"""Benchmark passages in documents by a prefix-filtered set join, in SQL functions only.

Every benchmark item is cut into windows of consecutive words. A document contains a window only if
it contains the window's rarest shingle of three words (the prefix of a containment join is one
token), so documents are joined with windows on that shingle alone. Rarity is counted over all
documents. Where the shingle stands in the window and in the document gives the only place the
window can be; places outside the document drop out, and the words there are compared with the
window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.workspace import materialize

#: Fixed: a word of lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed: the same words before lower-casing.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHINGLE = 3
#: Benchmark tables of more shingles than this are joined by shuffling instead of broadcasting.
BROADCAST_ROWS = 500_000
#: Up to so many documents with hits are broadcast to the table of documents.
BROADCAST_DOCUMENTS = 100_000


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case and all other letters as they are; null has none."""
    filled = F.coalesce(text, F.lit(""))
    low = F.when(filled.rlike(r"^[\x00-\x7F]*+$"), F.lower(filled)).otherwise(
        F.translate(filled, _UPPER, _UPPER.lower())
    )
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def benchmark_windows(items: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """(item_id, window): each run of ``size`` words, or all words of a shorter item that has any."""
    words = items.select(F.col(id_column).alias("item_id"), words_of(F.col(text_column)).alias("words"))
    length = F.least(F.lit(size), F.size("words"))
    return (
        words.where((F.size("words") > 0) & F.col("item_id").isNotNull())
        .withColumn("_start", F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)))
        .select("item_id", F.slice("words", F.col("_start"), length).alias("window"))
        .distinct()
    )


def _shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *(F.get(words, at + n) for n in range(size)))


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, offset, shingle): three-word shingles, or the whole of a window of fewer words."""
    last = F.greatest(F.size("window") - SHINGLE, F.lit(0))
    shingle = F.when(F.size("window") == 1, _shingle(F.col("window"), F.col("offset"), 1))
    shingle = shingle.when(F.size("window") == 2, _shingle(F.col("window"), F.col("offset"), 2))
    return (
        windows.select("window")
        .distinct()
        .withColumn("offset", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("shingle", shingle.otherwise(_shingle(F.col("window"), F.col("offset"), SHINGLE)))
    )


def document_matches(docs: DataFrame, shingles: DataFrame, sizes: list[int], reach: int, small: bool) -> DataFrame:
    """(_id, _text, place, n_words, shingle, following words) wherever a document has a benchmark shingle.

    A ``small`` table of shingles goes to the texts. Otherwise the places of all shingles are shuffled, as a
    few numbers each, and the words that follow are fetched for those that match: a text is then
    shuffled once, however many words it has.
    """
    texts = docs.select("_id", "_text", words_of(F.col("text")).alias("words"))
    texts = texts.select("_id", "_text", "words", F.size("words").alias("n_words"))
    # Outer, or Spark would cut the words a second time to leave out texts that have none.
    placed = texts.select("*", F.posexplode_outer("words").alias("place", "_word"))
    wanted = shingles.select("shingle").distinct()
    wanted = F.broadcast(wanted) if small else wanted
    narrow = ["_id", "_text", "place", "n_words", "shingle"]
    following = F.slice("words", F.col("place") + 1, F.lit(reach)).alias("words")
    matches = None
    for size in sizes:
        rest = [F.get(F.col("words"), F.col("place") + n) for n in range(1, size)]
        found = placed.where(F.col("place") <= F.col("n_words") - size).withColumn(
            "shingle", F.xxhash64(F.lit(size), "_word", *rest)
        )
        found = found if small else found.select(narrow)
        found = found.join(wanted, "shingle").select(*narrow, *([following] if small else []))
        matches = found if matches is None else matches.union(found)
    if small:
        return matches
    matches = materialize(matches, "benchmark-places")
    keys = ["_id", "_text"]
    again = docs.join(matches.select(keys).distinct(), keys, "left_semi").dropDuplicates(keys)
    again = again.select(*keys, words_of(F.col("text")).alias("words"))
    return matches.join(again, keys).select(*narrow, following)


def find_windows(docs: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """(_id, _text, start, window) of every occurrence of a window in ``docs`` (_id, _text, text)."""
    spark = docs.sparkSession
    shingles = materialize(window_shingles(windows), "window-shingles")
    found = shingles.agg(
        F.count("*").alias("n"), F.collect_set(F.least(F.size("window"), F.lit(SHINGLE))).alias("sizes")
    ).first()
    if not found["n"]:
        return spark.createDataFrame([], "_id string, _text long, start int, window array<string>")
    small = found["n"] <= BROADCAST_ROWS
    matches = materialize(
        document_matches(docs, shingles, sorted(found["sizes"]), size, small), "benchmark-matches"
    )
    frequency = matches.groupBy("shingle").agg(F.count("*").alias("frequency"))
    # A shingle no document has is rarer than any: its window has no candidates.
    prefix = (
        shingles.join(frequency, "shingle", "left")
        .groupBy("window")
        .agg(
            F.min(F.struct(F.coalesce("frequency", F.lit(0)).alias("frequency"), "shingle", "offset")).alias("rarest")
        )
        .where(F.col("rarest.frequency") > 0)
        .select("window", F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset"))
    )
    start = F.col("place") - F.col("offset")
    candidates = (
        matches.select("_id", "_text", "place", "n_words", "shingle")
        .join(F.broadcast(prefix) if small else prefix, "shingle")
        .where((start >= 0) & (start + F.size("window") <= F.col("n_words")))
        .select("_id", "_text", start.alias("start"), "window")
    )
    heads = matches.select("_id", "_text", F.col("place").alias("start"), "words").distinct()
    return (
        candidates.join(heads, ["_id", "_text", "start"])
        .where(F.slice("words", F.lit(1), F.size("window")) == F.col("window"))
        .select("_id", "_text", "start", "window")
        .distinct()
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = 13,
    share: int = 20,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, *keep, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of ``docs``.

    A word is hit if it lies in any occurrence of a window of an item; a document is contaminated if
    a word is hit and the words hit are at least one in ``share``. Null and empty texts have no words
    and are clean; items without words or id have no windows; repeated rows and null ids get rows of
    their own; an empty benchmark hits nothing.
    """
    text_key = F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))
    id_key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    texts = docs.select(id_key.alias("_id"), text_key.alias("_text"), F.col(text_column).alias("text"))
    windows = materialize(benchmark_windows(items, window, item_column, item_text_column), "benchmark-windows")
    hits = materialize(find_windows(texts, windows, window), "benchmark-hits")
    keys = ["_id", "_text"]
    covered = (
        hits.select(*keys, F.explode(F.sequence("start", F.col("start") + F.size("window") - 1)).alias("_place"))
        .distinct()
        .groupBy(keys)
        .agg(F.count("*").alias("n_hit"))
    )
    found_items = (
        hits.select(*keys, "window")
        .distinct()
        .join(windows, "window")
        .select(*keys, F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy(keys)
        .agg(F.sort_array(F.collect_list("item")).alias("_items"))
    )
    found = materialize(covered.join(found_items, keys), "benchmark-documents")
    columns = [c for c in dict.fromkeys(keep) if c != id_column]
    few = found.count() <= BROADCAST_DOCUMENTS
    n_words = F.regexp_count(F.coalesce(F.col("_said"), F.lit("")), F.lit(ANY_CASE_WORD)).cast("long")
    base = docs.select(
        F.col(id_column).alias("doc_id"),
        *(F.col(c).alias(f"_keep{n}") for n, c in enumerate(columns)),
        id_key.alias("_id"),
        text_key.alias("_text"),
        F.col(text_column).alias("_said"),
    )
    # Where texts stay in place the words are counted after the join, and only if they are asked for.
    base = base if few else base.withColumn("_said", n_words)
    n_words = n_words if few else F.col("_said")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    result = base.join(F.broadcast(found) if few else found, keys, "left")
    return result.select(
        "doc_id",
        *(F.col(f"_keep{n}").alias(c) for n, c in enumerate(columns)),
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.when(F.col("_items").isNull(), 0).otherwise(F.size("_items")).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("_items", F.array().cast("array<string>"))), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= n_words)).alias("contaminated"),
    )

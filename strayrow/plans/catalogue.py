"""Every operator as a query over the given tables: name -> (session, table folder) -> DataFrame."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.functions.expressions import message_value, parse_utc, to_message
from strayrow.operators import features as feat
from strayrow.operators.alerts import (
    anomalies,
    count_flagged,
    first_alerts_per_batch,
)
from strayrow.operators.forest import (
    ForestSettings,
    contrast_fit,
    contrast_set,
    forest_estimator,
    score,
)
from strayrow.operators.positions import dense_index, ordered_index, with_row_id
from strayrow.operators.records import dedupe, dedupe_stream, enrich, stamp_records
from strayrow.operators.sampling import bootstrap_rows, marginal_resample, poisson_sample
from strayrow.plans.replay import stamped_draws
from strayrow.plans.score import alert_records, score_sites, score_table
from strayrow.plans.train import TrainingOptions, feature_table, train_and_publish
from strayrow.sources.messages import replay_messages, replay_table
from strayrow.sources.models import current_version, load_published
from strayrow.sources.parsing import mark_json, split_marked
from strayrow.sources.schema import schema_from_text
from strayrow.sources.tables import scan_csv, scan_json, scan_records, scan_sites
from strayrow.streaming.landing import compact, land_stream, land_table, landed_files
from strayrow.streaming.scoring import ScoringOptions, await_stream, score_stream
from strayrow.streaming.sinks import as_messages
from strayrow.streaming.state import rocksdb_session, state_rows
from strayrow.workspace import fresh_folder, materialize

SEED = 7
FRACTION = 0.1
EVENT_FEATURES = ["value", "k", "user_id"]
VECTOR_WIDTH = 64
LINE_FEATURES = ["quantity", "price", "discounted", "charge"]
PAIR_FEATURES = ["digit", "triple"]
PAIR_DIGITS = 6
PAIR_SITES = 3
LANDED_FILES = 120
LANDED_BYTES = 400

LINEITEM_TEXT = """l_orderkey: continuous.
l_partkey: continuous.
l_suppkey: continuous.
l_linenumber: symbolic.
l_quantity: continuous.
l_extendedprice: continuous.
l_discount: continuous.
l_tax: continuous.
l_returnflag: string.
l_linestatus: string.
l_shipdate: string."""

EVENT_MESSAGE = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("utc", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

PAIR_MESSAGE = T.StructType(
    [
        T.StructField("line_id", T.StringType()),
        *[T.StructField(name, T.DoubleType()) for name in PAIR_FEATURES],
    ]
)

PROPS = T.StructType([T.StructField("k", T.LongType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as message records: the time as zone-free ISO text."""
    utc = F.regexp_replace(F.col("ts").cast("string"), " ", "T").alias("utc")
    return table(spark, sf_dir, "events").select("event_id", utc, "user_id", "event_type", "value")


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint").alias("k")
    return table(spark, sf_dir, "events").select("event_id", "value", k, "user_id")


def unique_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event features de-duplicated on the id, which makes the id a key to sample by."""
    return feature_table(
        event_features(spark, sf_dir), TrainingOptions(EVENT_FEATURES, ["event_id"])
    )


def line_features(spark: SparkSession, sf_dir: str, *others: str) -> DataFrame:
    """Four dependent features per order line, and other columns of it."""
    discounted = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(
        *others,
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        discounted.alias("discounted"),
        (discounted * (1 + F.col("l_tax"))).alias("charge"),
    )


def event_pairs(spark: SparkSession, sf_dir: str, shift: int = 1) -> DataFrame:
    """Two features of which one follows from the other: what a forest learns of them can be told beforehand."""
    digit = (F.col("user_id") % PAIR_DIGITS).cast("double")
    events = table(spark, sf_dir, "events").select(
        "event_id", digit.alias("digit"), (digit * 3 + shift).alias("triple")
    )
    return feature_table(events, TrainingOptions(PAIR_FEATURES, ["event_id"]))


def pair_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event pairs and, as many again, pairs of independent draws: odd wherever they don't fit together."""
    both = contrast_set(event_pairs(spark, sf_dir), PAIR_FEATURES, 1.0, SEED + 1, ["event_id"])
    return both.select(F.col("row_id").alias("line_id"), *PAIR_FEATURES)


def pair_model(spark: SparkSession, sf_dir: str):
    pairs = event_pairs(spark, sf_dir)
    return contrast_fit(pairs, forest_estimator(SEED), PAIR_FEATURES, 1.0, SEED, ["event_id"])


def flagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the hour, errors standing in for rows predicted 0."""
    prediction = F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)
    hour = F.substring(F.col("ts").cast("string"), 1, 13)
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "value", hour.alias("batch"), prediction.alias("prediction")
    )


# --- scans and parsing


def written_lines(spark: SparkSession, sf_dir: str) -> str:
    """Order lines as headerless CSV, each followed by one that does not fit the schema."""
    lines = table(spark, sf_dir, "lineitem")
    good = F.concat_ws(",", *lines.columns)
    bad = (
        F.when(F.col("l_returnflag") == "A", F.concat_ws(",", "l_orderkey", "l_partkey"))
        .when(F.col("l_returnflag") == "N", F.concat(good, F.lit(",extra")))
        .otherwise(F.concat(F.lit("x"), good))
    )
    path = fresh_folder(spark, "lineitem-csv")
    lines.select(F.explode(F.array(good, bad)).alias("value")).write.text(path)
    return path


def csv_declared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written_lines(spark, sf_dir)
    return scan_records(spark, path, "csv", schema_from_text(LINEITEM_TEXT))


def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written_lines(spark, sf_dir)
    parsed = scan_csv(spark, path, schema_from_text(LINEITEM_TEXT))
    return parsed.quarantine.select("raw", "reason")


def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "events-json")
    event_records(spark, sf_dir).write.json(path)
    records = scan_json(spark, path, EVENT_MESSAGE)
    return records.withColumn("ts", parse_utc(F.col("utc"))).drop("utc")


def multi_site_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = event_records(spark, sf_dir)
    root = fresh_folder(spark, "sites")
    land_table(
        records.select(
            to_message(records.columns).alias("value"),
            F.to_date(parse_utc(F.col("utc"))).alias("date"),
            F.concat(F.lit("site"), F.col("user_id") % 2).alias("site"),
        ),
        root,
    )
    landed = scan_sites(spark, root, EVENT_MESSAGE)
    return landed.groupBy(F.col("date").cast("string").alias("date"), "site").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("user_id").alias("user_ids"),
        F.max("event_id").alias("last_event"),
    )


def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "events").select(
        "event_id", message_value("props").alias("value")
    )
    return split_marked(mark_json(messages, PROPS), "malformed json", "events").rows


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn(
        "o_orderdate", F.col("o_orderdate").cast("string")
    )
    parsed = split_marked(mark_json(as_messages(orders), orders.schema), "malformed json", "orders")
    return parsed.rows


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("event_type") == "error", F.lit("{bad")).otherwise(F.col("props"))
    messages = table(spark, sf_dir, "events").select(broken.alias("value"))
    parsed = split_marked(mark_json(messages, PROPS), "malformed json", "events")
    kept = parsed.rows.select(F.lit("kept").alias("status"), F.col("k"))
    bad = parsed.quarantine.select(F.col("reason").alias("status"), F.lit(None).alias("k"))
    return kept.unionByName(bad).groupBy("status").agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("k"), F.lit(0)).alias("k_sum")
    )


def kafka_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = as_messages(event_records(spark, sf_dir)).select(
        F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value")
    )
    received = sent.select(message_value().alias("value"))
    return split_marked(mark_json(received, EVENT_MESSAGE), "malformed json", "topic").rows


# --- records and features


def enrich_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount"),
        "l_extendedprice",
    )
    return enrich(lines, ["discount", "l_extendedprice"], "total")


def vector_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value", "user_id")
    vectors = feat.assemble(events, ["value", "user_id"]).select("event_id", "features")
    return feat.vector_columns(vectors, ["value", "user_id"])


def vectors_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id")
    vectors = feat.only_vectors(feat.assemble(events, ["value", "user_id"]))
    return feat.vector_columns(vectors, ["value", "user_id"])


def explode_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "embeddings").select(
        "vec_id", array_to_vector("embedding").alias("features")
    )
    return feat.explode_vector(wide, ["vec_id"])


def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return feat.index_labels(events, "event_type")


def labeled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "value", "user_id")
    points = feat.labeled_points(feat.assemble(events, ["value", "user_id"]), "event_type")
    return feat.vector_columns(points, ["value", "user_id"])


def unpivot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.unpivot_features(event_features(spark, sf_dir), ["event_id"], EVENT_FEATURES)


def rebuild_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = feat.unpivot_features(event_features(spark, sf_dir), ["event_id"], EVENT_FEATURES)
    return feat.rebuild_rows(pieces, ["event_id"], EVENT_FEATURES)


def stamped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    stamped = stamp_records(events)
    stamped_at = parse_utc(F.col("utc"))
    return stamped.withColumn("utc", stamped_at.isNotNull()).withColumnRenamed("utc", "has_utc")


def dedupe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    retried = events.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE"))
    return dedupe(feat.union_rows(retried, events), ["event_id"], ["ts"])


# --- positions and samples


def dense_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_index(table(spark, sf_dir, "lineitem"))


def ordered_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id")
    return ordered_index(events, ["event_type", "ts"])


def poisson_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_sample(unique_events(spark, sf_dir), FRACTION, SEED, ["event_id"])


def marginal_resample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marginal_resample(
        unique_events(spark, sf_dir), EVENT_FEATURES, FRACTION, SEED, ["event_id"]
    )


def marginal_resample_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marginal_resample(
        unique_events(spark, sf_dir), EVENT_FEATURES, FRACTION, SEED, ["event_id"], "poisson"
    )


def marginal_resample_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty-four features at once."""
    vectors = dedupe(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), ["vec_id"])
    columns = [f"v{j}" for j in range(VECTOR_WIDTH)]
    wide = materialize(
        vectors.select("vec_id", *[F.col("embedding")[j].alias(c) for j, c in enumerate(columns)]),
        "vectors",
    )
    return marginal_resample(wide, columns, 1.0, SEED, ["vec_id"])


def bootstrap_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rows = orders.count()
    return bootstrap_rows(orders, rows, SEED, rows=rows)


def replayed_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records drawn at random, stamped with the draw and with the place drawn from."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return stamped_draws(events, SEED).drop("utc")


def contrast_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = contrast_set(
        unique_events(spark, sf_dir), EVENT_FEATURES, FRACTION, SEED, ["event_id"]
    )
    return both.groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum("value"), 2).alias("value_sum"),
        F.sum("k").alias("k_sum"),
        F.sum("user_id").alias("user_id_sum"),
    )


# --- anomalies and alerts


def anomaly_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies(table(spark, sf_dir, "labels"), "quality")


def alerts_first5(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = anomalies(flagged_events(spark, sf_dir))
    return first_alerts_per_batch(flagged, "batch", ["ts", "event_id"])


def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_flagged(flagged_events(spark, sf_dir), ["batch"])


def empty_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a batch from which every row was filtered out."""
    return count_flagged(flagged_events(spark, sf_dir).filter(F.col("value") < 0))


# --- streams

SLICE_FILES = 4


def deliver(slices: list[DataFrame], inbox: str) -> None:
    """Each slice as the same number of message files, one slice after the other."""
    for arriving in slices:
        as_messages(arriving).repartition(SLICE_FILES).write.mode("append").text(inbox)


def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    inbox = fresh_folder(spark, "messages")
    as_messages(event_records(spark, sf_dir)).write.text(inbox)
    out = fresh_folder(spark, "enriched")
    options = ScoringOptions(
        checkpoint=fresh_folder(spark, "checkpoint"),
        schema=EVENT_MESSAGE,
        total_of=("value", "user_id"),
        enriched_path=out,
        available_now=True,
    )
    await_stream(*score_stream(replay_messages(spark, inbox), options))
    enriched = T.StructType([*EVENT_MESSAGE.fields, T.StructField("total_bytes", T.DoubleType())])
    return scan_json(spark, out, enriched).drop("batch")


def stream_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams land enriched records of their sites in one tree, which a trainer scans as it is."""
    records = event_records(spark, sf_dir)
    root = fresh_folder(spark, "landed")
    for site in range(2):
        inbox = fresh_folder(spark, "messages")
        own = records.filter(F.col("user_id") % 2 == site)
        deliver([own.filter(F.col("event_type") == "error"), own.filter(F.col("event_type") != "error")], inbox)
        options = ScoringOptions(
            checkpoint=fresh_folder(spark, "checkpoint"),
            schema=EVENT_MESSAGE,
            total_of=("value", "user_id"),
            landed_path=root,
            site=f"site{site}",
            available_now=True,
        )
        await_stream(*score_stream(replay_messages(spark, inbox, SLICE_FILES), options))
    enriched = T.StructType([*EVENT_MESSAGE.fields, T.StructField("total_bytes", T.DoubleType())])
    return scan_sites(spark, root, enriched).drop("date")


def deduplicated(spark: SparkSession, sf_dir: str) -> tuple[str, str, T.StructType]:
    """(output, checkpoint, schema): four slices of time, with the last day of each sent again by the next.

    Two slices arrive before the stream is stopped and started again.
    """
    own = rocksdb_session(spark)
    events = table(own, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("event_time"), "event_type", "value"
    )
    ends = events.agg(F.min("event_time").alias("low"), F.max("event_time").alias("high")).first()
    step = (ends["high"] - ends["low"]) / 4
    inbox, out, checkpoint = (fresh_folder(spark, name) for name in ("retried", "unique", "checkpoint"))
    time = F.col("event_time")
    for half in range(2):
        for number in (2 * half, 2 * half + 1):
            begin, end = ends["low"] + number * step, ends["low"] + (number + 1) * step
            again = F.lit(begin) - F.expr("INTERVAL 1 DAY")
            until = time < F.lit(end) if number < 3 else time <= F.lit(ends["high"])
            arriving = events.filter((time >= again) & until)
            arriving.repartition(SLICE_FILES).write.mode("append").parquet(inbox)
        replayed = replay_table(own, inbox, events.schema, files_per_batch=SLICE_FILES)
        once = dedupe_stream(replayed, ["event_id"], "event_time", "2 days").drop("event_time")
        query = (
            once.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return out, checkpoint, once.schema


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, schema = deduplicated(spark, sf_dir)
    return spark.read.schema(schema).parquet(out)


def stream_dedupe_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys still held at the end: those for which a copy could still come in time."""
    _, checkpoint, _ = deduplicated(spark, sf_dir)
    return state_rows(rocksdb_session(spark), checkpoint).agg(F.count(F.lit(1)).alias("keys"))


def stream_max_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four slices of the ids arrive one after the other; the limit of two holds over a restart after the first."""
    records = event_records(spark, sf_dir)
    ends = records.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high")).first()
    slice_no = F.floor(
        (F.col("event_id") - ends["low"]) * 4 / F.lit(ends["high"] - ends["low"] + 1)
    )
    inbox = fresh_folder(spark, "slices")
    out = fresh_folder(spark, "enriched")
    options = ScoringOptions(
        checkpoint=fresh_folder(spark, "checkpoint"),
        schema=EVENT_MESSAGE,
        total_of=("value", "user_id"),
        enriched_path=out,
        available_now=True,
        max_batches=2,
    )
    for arriving in (range(1), range(1, 4)):
        deliver([records.filter(slice_no == number) for number in arriving], inbox)
        await_stream(*score_stream(replay_messages(spark, inbox, SLICE_FILES), options))
    return scan_json(spark, out, EVENT_MESSAGE).select("event_id", "user_id", "value")


def landing_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = event_records(spark, sf_dir)
    inbox = fresh_folder(spark, "messages")
    as_messages(records).write.text(inbox)
    landed = fresh_folder(spark, "landed")
    messages = replay_messages(spark, inbox)
    arrived = F.to_date(parse_utc(F.get_json_object("value", "$.utc")))
    site = F.concat(F.lit("site"), F.get_json_object("value", "$.user_id").cast("bigint") % 2)
    dated = messages.select("value", arrived.alias("date"), site.alias("site"))
    stream = land_stream(dated, landed, fresh_folder(spark, "checkpoint"))
    stream.trigger(availableNow=True).start().awaitTermination()
    merged = fresh_folder(spark, "compacted")
    compact(spark, landed, merged)
    return scan_sites(spark, merged, EVENT_MESSAGE).withColumn("date", F.col("date").cast("string"))


def compact_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is compacted, then more arrives for the last date, and only that is compacted again."""
    events = table(spark, sf_dir, "events").select(
        F.concat_ws(" ", "event_id", "event_type", "props").alias("value"),
        F.col("ts").cast("date").cast("string").alias("date"),
        F.concat(F.lit("site"), F.col("user_id") % 2).alias("site"),
    )
    size = events.agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("date").alias("last")).first()
    file_bytes = max(LANDED_BYTES, size["bytes"] // LANDED_FILES)
    landed, merged = fresh_folder(spark, "landed"), fresh_folder(spark, "compacted")
    land_table(events.repartition(SLICE_FILES), landed)
    compact(spark, landed, merged, file_bytes)
    before = materialize(landed_files(spark, merged).select("path"), "listing")
    late = events.filter(F.col("date") == size["last"])
    land_table(late.withColumn("value", F.concat(F.lit("late "), "value")), landed)
    compact(spark, landed, merged, file_bytes, [size["last"]])
    after = materialize(landed_files(spark, merged), "listing")
    files = after.join(before.withColumn("kept", F.lit(True)), "path", "left").groupBy("date", "site").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("length") > 1.5 * file_bytes).alias("large_files"),
        F.count_if(F.col("length") < 0.5 * file_bytes).alias("small_files"),
        F.count_if(F.col("kept").isNull()).alias("new_files"),
    )
    lines = spark.read.schema("value string, date string, site string").text(merged)
    return lines.groupBy("date", "site").agg(F.count(F.lit(1)).alias("rows")).join(files, ["date", "site"])


def line_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines and, as many again, lines put together from independent draws."""
    lines = materialize(with_row_id(line_features(spark, sf_dir), None, "line_id"), "lines")
    both = contrast_set(lines, LINE_FEATURES, 1.0, SEED + 1, ["line_id"])
    return both.select(F.col("row_id").alias("line_id"), *LINE_FEATURES)


def line_model(spark: SparkSession, sf_dir: str, settings: ForestSettings = ForestSettings()):
    lines = line_features(spark, sf_dir)
    return contrast_fit(lines, forest_estimator(SEED, settings), LINE_FEATURES, 1.0, SEED)


def alert_stream(spark: SparkSession, sf_dir: str) -> ScoringOptions:
    """A scoring stream over pairs that arrive in three batches; gives the options of the stream that ran."""
    messages = materialize(pair_messages(spark, sf_dir), "pairs")
    inbox = fresh_folder(spark, "messages")
    deliver([messages.filter(F.col("digit") % PAIR_SITES == n) for n in range(PAIR_SITES)], inbox)
    options = ScoringOptions(
        checkpoint=fresh_folder(spark, "checkpoint"),
        schema=PAIR_MESSAGE,
        features=PAIR_FEATURES,
        total_of=PAIR_FEATURES,
        order=("line_id",),
        alert_path=fresh_folder(spark, "alerts"),
        report_path=fresh_folder(spark, "report"),
        available_now=True,
    )
    model = pair_model(spark, sf_dir)
    await_stream(*score_stream(replay_messages(spark, inbox, SLICE_FILES), options, model))
    return options


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alert = T.StructType(
        [
            *PAIR_MESSAGE.fields,
            T.StructField("total_bytes", T.DoubleType()),
            T.StructField("alert_text", T.StringType()),
            T.StructField("batch", T.LongType()),
        ]
    )
    return scan_json(spark, alert_stream(spark, sf_dir).alert_path, alert)


def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = T.StructType([T.StructField(c, T.LongType()) for c in ("batch", "rows", "anomalies")])
    return scan_json(spark, alert_stream(spark, sf_dir).report_path, counts)


# --- the model


def forest_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = line_model(spark, sf_dir)
    weights = [float(w) for w in model.featureImportances.toArray()]
    return spark.createDataFrame(
        list(zip(LINE_FEATURES, weights)), "feature string, importance double"
    )


def forest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = feat.assemble(pair_messages(spark, sf_dir), PAIR_FEATURES)
    model = pair_model(spark, sf_dir)
    soft = score(pairs, model).select("line_id", "features", F.col("prediction").alias("soft"))
    both = score(soft, model, "hard").withColumnRenamed("prediction", "hard")
    source = F.substring_index("line_id", ":", 1).alias("source")
    return both.groupBy(source).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("soft") <= 0).alias("soft_anomalies"),
        F.count_if(F.col("hard") <= 0).alias("hard_anomalies"),
    )


def model_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish twice, fail a third time, then score with whatever is current: only the second finds these odd."""
    pairs, shifted = event_pairs(spark, sf_dir), event_pairs(spark, sf_dir, 4)
    root = fresh_folder(spark, "model")
    small = ForestSettings(trees=5, max_depth=12)
    options = TrainingOptions(PAIR_FEATURES, ["event_id"], fraction=1.0, seed=SEED, forest=small)
    train_and_publish(pairs, options, root, "1")
    train_and_publish(shifted, options, root, "2")
    try:
        train_and_publish(pairs.drop("triple"), options, root, "3")
    except Exception:  # the column is missing on purpose
        pass
    scored = score_table(pairs, load_published(spark, root), PAIR_FEATURES)
    rows = count_flagged(scored).select("rows", "anomalies")
    return rows.withColumn("version", F.lit(current_version(spark, root)))


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's prediction, by either vote."""
    model = pair_model(spark, sf_dir)
    soft = score_table(pair_messages(spark, sf_dir), model, PAIR_FEATURES).withColumnRenamed("prediction", "soft")
    both = score(soft.drop("rawPrediction", "probability"), model, "hard")
    return both.select("line_id", *PAIR_FEATURES, "soft", F.col("prediction").alias("hard"))


def site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model of all sites' records scores the records of the sites that are in service."""
    messages = pair_messages(spark, sf_dir)
    site = F.concat(F.lit("site"), (F.col("digit") % PAIR_SITES).cast("int"))
    day = F.concat(F.lit("2024-01-0"), (F.col("digit") % 2 + 1).cast("int"))
    root = fresh_folder(spark, "sites")
    land_table(
        messages.select(to_message(messages.columns).alias("value"), day.alias("date"), site.alias("site")), root
    )
    landed = scan_sites(spark, root, PAIR_MESSAGE)
    real = landed.filter(F.col("line_id").startswith("real:"))
    options = TrainingOptions(PAIR_FEATURES, ["line_id"], fraction=1.0, seed=SEED)
    models = fresh_folder(spark, "model")
    train_and_publish(real, options, models, "1")
    registry = materialize(landed.select("site").distinct().withColumn("on", F.col("site") != "site1"), "registry")
    scored = score_sites(landed, registry.filter("on"), load_published(spark, models), PAIR_FEATURES)
    return count_flagged(scored, ["site"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines -> contrast set -> forest -> score -> the first alerts."""
    lines = line_messages(spark, sf_dir)
    return alert_records(lines, line_model(spark, sf_dir), LINE_FEATURES, ["line_id"])


QUERIES = {
    "csv_declared_scan": csv_declared_scan,
    "csv_quarantine": csv_quarantine,
    "json_scan": json_scan,
    "multi_site_scan": multi_site_scan,
    "json_parse": json_parse,
    "json_roundtrip": json_roundtrip,
    "quarantine": quarantine,
    "kafka_encode": kafka_encode,
    "enrich_sum": enrich_sum,
    "vector_columns": vector_columns,
    "vectors_only": vectors_only,
    "explode_vector": explode_vector,
    "label_index": label_index,
    "labeled_points": labeled_points,
    "unpivot_features": unpivot_features,
    "rebuild_rows": rebuild_rows,
    "stamp_records": stamped_events,
    "dedupe_key": dedupe_key,
    "dense_index": dense_index_rows,
    "ordered_index": ordered_index_rows,
    "poisson_sample": poisson_sample_rows,
    "marginal_resample": marginal_resample_exact,
    "marginal_resample_poisson": marginal_resample_poisson,
    "marginal_resample_wide": marginal_resample_wide,
    "bootstrap_rows": bootstrap_orders,
    "replayed_draws": replayed_draws,
    "contrast_set": contrast_totals,
    "anomaly_filter": anomaly_filter,
    "alerts_first5": alerts_first5,
    "batch_counts": batch_counts,
    "empty_counts": empty_counts,
    "stream_enrich": stream_enrich,
    "stream_landing": stream_landing,
    "stream_dedupe": stream_dedupe,
    "stream_dedupe_state": stream_dedupe_state,
    "stream_max_batches": stream_max_batches,
    "landing_compact": landing_compact,
    "compact_date": compact_date,
    "stream_alerts": stream_alerts,
    "stream_report": stream_report,
    "forest_train": forest_train,
    "forest_score": forest_score,
    "model_publish": model_publish,
    "scored_rows": scored_rows,
    "site_scores": site_scores,
}

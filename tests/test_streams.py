import json
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.operators.forest import ForestSettings, contrast_fit, forest_estimator
from strayrow.operators.records import dedupe_stream
from strayrow.plans.train import TrainingOptions, train_and_publish
from strayrow.sources.committed import CommittedSink
from strayrow.sources.messages import replay_messages, replay_table
from strayrow.sources.tables import scan_json, scan_sites
from strayrow.streaming.landing import compact, land_stream, landed_files, with_landing_columns
from strayrow.streaming.scoring import BatchScorer, ScoringOptions, await_stream, score_stream

SCHEMA = T.StructType(
    [
        T.StructField("sequence_id", T.LongType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("src_bytes", T.DoubleType()),
        T.StructField("dst_bytes", T.DoubleType()),
    ]
)


def deliver(folder, name, rows):
    """One message file; modification times keep the order of delivery."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as out:
        for row in rows:
            out.write((row if isinstance(row, str) else json.dumps(row)) + "\n")
    order = time.time() - 1000 + len(os.listdir(folder))
    os.utime(path, (order, order))


def message(i, src=None, dst=None):
    return {
        "sequence_id": i, "uuid": f"u{i}",
        "src_bytes": float(i) if src is None else src,
        "dst_bytes": 2.0 * i if dst is None else dst,
    }


def options(tmp_path, **changes):
    defaults = dict(
        checkpoint=str(tmp_path / "checkpoint"),
        schema=SCHEMA,
        features=["src_bytes", "dst_bytes"],
        enriched_path=str(tmp_path / "enriched"),
        quarantine_path=str(tmp_path / "quarantine"),
        alert_path=str(tmp_path / "alerts"),
        report_path=str(tmp_path / "report"),
        available_now=True,
    )
    return ScoringOptions(**{**defaults, **changes})


def run(spark, inbox, opts, model=None, per_batch=1):
    return await_stream(*score_stream(replay_messages(spark, inbox, per_batch), opts, model))


@pytest.fixture(scope="module")
def model(spark):
    """dst is twice src in every record seen."""
    seen = spark.range(2000).select(
        F.concat(F.lit("u"), "id").alias("uuid"),
        F.col("id").cast("double").alias("src_bytes"),
        (F.col("id") * 2.0).alias("dst_bytes"),
    )
    forest = forest_estimator(3, ForestSettings(trees=8, max_depth=8))
    return contrast_fit(seen, forest, ["src_bytes", "dst_bytes"], 1.0, 3, ["uuid"])


def test_without_a_model_the_stream_only_enriches(spark, tmp_path):
    inbox = str(tmp_path / "in")
    deliver(inbox, "a", [message(1), "{bad", message(2)])
    deliver(inbox, "b", [message(3), '{"sequence_id":"x"}'])
    assert run(spark, inbox, options(tmp_path)) == 2
    enriched = spark.read.json(str(tmp_path / "enriched"))
    assert {(r.sequence_id, r.total_bytes) for r in enriched.collect()} == {
        (1, 3.0), (2, 6.0), (3, 9.0),
    }
    bad = spark.read.json(str(tmp_path / "quarantine"))
    assert {r.raw for r in bad.collect()} == {"{bad", '{"sequence_id":"x"}'}
    assert not os.path.exists(tmp_path / "alerts")


def test_outputs_are_optional(spark, tmp_path):
    inbox = str(tmp_path / "in")
    deliver(inbox, "a", [message(1)])
    off = options(
        tmp_path, enriched_path=None, quarantine_path=None, alert_path=None, report_path=None
    )
    assert run(spark, inbox, off) == 1
    assert sorted(os.listdir(tmp_path)) == ["checkpoint", "in"]


def test_first_five_alerts_in_order_and_a_full_count(spark, tmp_path, model):
    inbox = str(tmp_path / "in")
    odd = [message(i, 10.0 * i, 3900.0 - 10 * i) for i in range(8)]
    deliver(inbox, "a", [message(i) for i in range(100, 130)] + odd[::-1])
    deliver(inbox, "b", [message(i) for i in range(200, 210)])
    assert run(spark, inbox, options(tmp_path), model) == 2
    alerts = spark.read.json(str(tmp_path / "alerts"))
    first = alerts.filter("batch = 0").orderBy("sequence_id").collect()
    assert [r.sequence_id for r in first] == [0, 1, 2, 3, 4]
    assert {r.alert_text for r in first} == {"predicted to be an anomaly"}
    assert "features" not in alerts.columns and "total_bytes" in alerts.columns
    report = {r.batch: r.anomalies for r in spark.read.json(str(tmp_path / "report")).collect()}
    assert report == {0: 8, 1: 0}


def test_null_features_do_not_stop_the_stream(spark, tmp_path, model):
    inbox = str(tmp_path / "in")
    deliver(inbox, "a", ['{"sequence_id":1,"uuid":"u","src_bytes":null,"dst_bytes":3.0}'])
    assert run(spark, inbox, options(tmp_path), model) == 1
    assert spark.read.json(str(tmp_path / "enriched")).count() == 1


def test_a_replayed_batch_replaces_its_outputs(spark, tmp_path, model):
    scorer = BatchScorer(options(tmp_path), model)
    # A stream's batches have a session of their own.
    own = spark.newSession()
    batch = own.createDataFrame([(json.dumps(message(i)),) for i in range(20)], "value string")
    for _ in range(2):
        scorer(batch, 4)
    assert scorer.progress(spark) == (1, 4)
    assert spark.read.json(str(tmp_path / "enriched")).count() == 20
    assert scorer.report == (4, 20, 0)


def test_empty_batches_do_not_count(spark, tmp_path):
    scorer = BatchScorer(options(tmp_path, max_batches=1))
    empty = spark.createDataFrame([], "value string")
    scorer(empty, 0)
    assert scorer.progress(spark) == (0, -1) and not os.path.exists(tmp_path / "enriched")
    all_bad = spark.createDataFrame([("{bad",)], "value string")
    scorer(all_bad, 1)
    assert scorer.progress(spark) == (1, 1)
    scorer(empty, 2)
    with pytest.raises(Exception):
        scorer(all_bad, 3)


def test_the_stream_stops_at_the_limit_and_resumes(spark, tmp_path):
    inbox = str(tmp_path / "in")
    for name in "abcd":
        deliver(inbox, name, [message(ord(name))])
    assert run(spark, inbox, options(tmp_path, max_batches=2)) == 2
    enriched = str(tmp_path / "enriched")
    assert {r.uuid for r in spark.read.json(enriched).collect()} == {"u97", "u98"}
    assert run(spark, inbox, options(tmp_path, max_batches=2)) == 0
    assert run(spark, inbox, options(tmp_path, max_batches=3)) == 1
    assert len(os.listdir(tmp_path / "checkpoint" / "batches-done")) <= 2
    assert run(spark, inbox, options(tmp_path)) == 1
    assert spark.read.json(enriched).count() == 4
    assert run(spark, inbox, options(tmp_path)) == 0
    assert spark.read.json(enriched).count() == 4


def test_other_failures_are_not_swallowed(spark, tmp_path):
    inbox = str(tmp_path / "in")
    deliver(inbox, "a", [message(1)])
    with pytest.raises(Exception):
        run(spark, inbox, options(tmp_path, total_of=("missing",), max_batches=1))


def test_a_timed_stream_stops_at_the_limit(spark, tmp_path):
    inbox = str(tmp_path / "in")
    for name in "abc":
        deliver(inbox, name, [message(ord(name))])
    timed = options(tmp_path, available_now=False, interval_sec=0.2, max_batches=2)
    assert run(spark, inbox, timed) == 2
    assert spark.read.json(str(tmp_path / "enriched")).count() == 2


def unique_rows(spark, inbox, out, checkpoint, spread):
    schema = "uuid string, event_time timestamp, v int"
    stream = replay_table(spark, inbox, T._parse_datatype_string(schema), files_per_batch=1)
    once = dedupe_stream(stream, ["uuid"], "event_time", "2 days", spread)
    query = (
        once.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sorted(r.uuid for r in spark.read.parquet(out).collect())


@pytest.mark.parametrize("spread", [True, False])
def test_streaming_duplicates(spark, tmp_path, spread):
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    when = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    others = [when.alias("event_time"), F.lit(1).alias("v")]
    hot = spark.range(200).select(F.lit("hot").alias("uuid"), *others)
    rest = spark.range(20).select(F.concat(F.lit("u"), "id").alias("uuid"), *others)
    hot.union(rest).repartition(3).write.parquet(inbox)
    rest.union(hot).repartition(2).write.mode("append").parquet(inbox)
    expected = sorted(["hot", *[f"u{i}" for i in range(20)]])
    assert unique_rows(spark, inbox, out, checkpoint, spread) == expected
    rest.write.mode("append").parquet(inbox)
    assert unique_rows(spark, inbox, out, checkpoint, spread) == expected


def test_landing_by_arrival_date_and_site(spark, tmp_path):
    inbox, root = str(tmp_path / "in"), str(tmp_path / "landed")
    deliver(inbox, "a", [message(1), message(2)])
    arrived = with_landing_columns(replay_messages(spark, inbox), "site1")
    writer = land_stream(arrived, root, str(tmp_path / "checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()
    today = spark.sql("select cast(current_date() as string) d").first().d
    files = os.listdir(os.path.join(root, f"date={today}", "site=site1"))
    assert files
    assert spark.read.schema(SCHEMA).json(root).count() == 2


def test_runs_share_a_folder_and_lose_nothing(spark, tmp_path):
    out = str(tmp_path / "shared")
    for name in "ab":
        inbox = str(tmp_path / f"in{name}")
        deliver(inbox, "first", [message(ord(name))])
        deliver(inbox, "second", [message(ord(name) + 100)])
        own = options(tmp_path, checkpoint=str(tmp_path / f"checkpoint{name}"), enriched_path=out)
        assert run(spark, inbox, own) == 2
    assert {r.uuid for r in scan_json(spark, out, SCHEMA).collect()} == {"u97", "u98", "u197", "u198"}


def test_only_entered_attempts_are_read(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(3)
    sink = CommittedSink(spark, out, "run", ("batch",))
    sink.write(rows, 0)
    sink.write(rows.union(rows), 0)
    # An attempt that died before its entry, and one that died while it made the entry.
    rows.withColumn("batch", F.lit(1)).withColumn("_attempt", F.lit("run.1.dead")).write.mode("append").partitionBy(
        "batch", "_attempt"
    ).json(out)
    open(tmp_path / "out" / "_batches" / "run.1", "w").close()
    schema = T.StructType([T.StructField("id", T.LongType())])
    assert scan_json(spark, out, schema).count() == 3
    assert scan_json(spark, out).columns == ["id", "batch"]
    sink.write(rows.limit(2), 1)
    found = scan_json(spark, out, schema).groupBy("batch").count().collect()
    assert {tuple(r) for r in found} == {(0, 3), (1, 2)}


def test_enriched_records_are_scanned_and_trained_on_without_a_topic(spark, tmp_path):
    root = str(tmp_path / "landed")
    for site in ("site1", "site2"):
        inbox = str(tmp_path / site)
        deliver(inbox, "a", [message(n) for n in range(60)] + ["{bad"])
        deliver(inbox, "b", [message(n) for n in range(60, 90)])
        run(spark, inbox, options(tmp_path, checkpoint=str(tmp_path / f"c-{site}"), landed_path=root, site=site))
    enriched = T.StructType([*SCHEMA.fields, T.StructField("total_bytes", T.DoubleType())])
    landed = scan_sites(spark, root, enriched)
    assert landed.columns == [*enriched.fieldNames(), "date", "site"]
    assert {r.site: r["count"] for r in landed.groupBy("site").count().collect()} == {"site1": 90, "site2": 90}
    assert landed.where("total_bytes <> src_bytes + dst_bytes").count() == 0
    training = TrainingOptions(["src_bytes", "dst_bytes"], forest=ForestSettings(trees=2, max_depth=3))
    train_and_publish(landed, training, str(tmp_path / "model"), "1")
    merged = str(tmp_path / "merged")
    compact(spark, root, merged)
    assert scan_sites(spark, merged, enriched).count() == 180
    files = landed_files(spark, merged).collect()
    assert len(files) == 2 and {f.site for f in files} == {"site1", "site2"}

"""Message -> enrich -> land by date and site -> train -> publish -> score, on full records."""

import json
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.operators.forest import ForestSettings
from strayrow.plans.replay import replay_to_files, stamped_draws, stamped_pass
from strayrow.plans.score import alert_records, score_table
from strayrow.plans.train import TrainingOptions, train_and_publish
from strayrow.sources.messages import replay_messages
from strayrow.sources.models import load_published
from strayrow.sources.schema import connection_features, connection_schema, message_schema
from strayrow.sources.tables import scan_json, scan_records, scan_sites
from strayrow.streaming.landing import land_stream, with_landing_columns
from strayrow.streaming.scoring import ScoringOptions, await_stream, score_stream
from strayrow.streaming.sinks import as_messages


def connection_lines(count):
    rng = random.Random(3)
    for _ in range(count):
        level = rng.randint(1, 40)
        values = []
        for field in connection_schema().fields:
            if field.name in ("src_bytes", "dst_bytes", "count", "srv_count", "dst_host_count"):
                values.append(str(level * 10))
            elif isinstance(field.dataType, T.StringType):
                values.append("tcp")
            else:
                values.append("0")
        yield ",".join(values)


def test_the_whole_loop(spark, tmp_path):
    csv, inbox, root, models = (str(tmp_path / n) for n in ("csv", "inbox", "landed", "models"))
    lines = [(line,) for line in [*connection_lines(600), "broken,line"]]
    spark.createDataFrame(lines, "value string").repartition(3).write.text(csv)
    records = scan_records(spark, csv, "csv", connection_schema())
    assert records.count() == 600

    stamped = stamped_pass(records)
    assert len(stamped.columns) == 46
    replay_to_files(stamped, inbox)
    schema = message_schema(connection_schema())
    enriched_schema = T.StructType([*schema.fields, T.StructField("total_bytes", T.DoubleType())])

    options = ScoringOptions(
        checkpoint=str(tmp_path / "c1"), enriched_path=str(tmp_path / "out"), available_now=True
    )
    await_stream(*score_stream(replay_messages(spark, inbox), options))
    enriched = scan_json(spark, str(tmp_path / "out"), enriched_schema).drop("batch")
    assert enriched.count() == 600
    assert enriched.filter(F.col("total_bytes") != F.col("src_bytes") * 2).count() == 0

    topic = str(tmp_path / "topic")
    as_messages(enriched).write.text(topic)
    as_messages(enriched.limit(50)).write.mode("append").text(topic)  # a retry
    for number, site in enumerate(("site1", "site2")):
        arrived = with_landing_columns(replay_messages(spark, topic), site)
        if number:
            arrived = arrived.filter("false")
        writer = land_stream(arrived, root, str(tmp_path / f"land{number}"))
        writer.trigger(availableNow=True).start().awaitTermination()
    landed = scan_sites(spark, root, enriched_schema)
    assert landed.count() == 650

    features = connection_features()
    training = TrainingOptions(
        features, fraction=1.0, seed=1, forest=ForestSettings(trees=6, max_depth=8)
    )
    train_and_publish(landed, training, models, "1")
    model = load_published(spark, models)
    assert model.numFeatures == 38

    busy = enriched.filter("src_bytes >= 300").orderBy("sequence_id").limit(7)
    odd = busy.withColumn("dst_bytes", F.lit(10.0)).withColumn("count", F.lit(10.0))
    odd = odd.withColumn("uuid", F.concat(F.lit("odd"), "sequence_id"))
    mixed = enriched.unionByName(odd)
    flagged = score_table(mixed, model, features).filter("prediction <= 0")
    assert flagged.filter("uuid like 'odd%'").count() >= 4
    assert flagged.count() < 60
    alerts = alert_records(odd, model, features, ["sequence_id"], 3).collect()
    assert len(alerts) == 3
    fields = json.loads(json.dumps(alerts[0].asDict()))
    assert len(fields) == 48 and fields["alert_text"] == "predicted to be an anomaly"

    scored = ScoringOptions(
        checkpoint=str(tmp_path / "c2"), alert_path=str(tmp_path / "alerts"), available_now=True
    )
    odd_inbox = str(tmp_path / "odd")
    as_messages(odd.drop("total_bytes")).write.text(odd_inbox)
    await_stream(*score_stream(replay_messages(spark, odd_inbox), scored, model))
    assert 1 <= spark.read.json(str(tmp_path / "alerts")).count() <= 5


def test_random_replay(spark):
    kind = F.concat(F.lit("s"), F.col("id") % 3).alias("s")
    records = spark.range(200).select(F.col("id").alias("n"), kind)
    drawn = stamped_draws(records, 5, 300).collect()
    assert sorted(r.sequence_id for r in drawn) == list(range(300))
    assert len({r.uuid for r in drawn}) == 300
    places = {}
    for r in drawn:
        assert places.setdefault(r["index"], r.n) == r.n
    assert stamped_draws(records, 5).count() == 200


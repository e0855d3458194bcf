import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.functions.expressions import parse_utc, to_message
from strayrow.operators.records import enrich
from strayrow.sources.messages import kafka_read_options
from strayrow.sources.parsing import mark_json, split_marked
from strayrow.sources.schema import (
    connection_features,
    connection_schema,
    message_schema,
    schema_from_text,
)
from strayrow.sources.tables import (
    scan_csv,
    scan_json,
    scan_json_checked,
    scan_records,
    scan_sites,
    scan_sites_checked,
)
from strayrow.streaming.landing import compact, land_table
from strayrow.streaming.sinks import as_messages, kafka_write_options

SMALL = schema_from_text(
    "duration: continuous.\nprotocol: string.\nland: symbolic.\nlabel: string."
)
CSV_ROWS = [
    "1.5,tcp,0,normal.",
    "bad,udp,1,smurf.",
    "2,icmp,0,x.,extra",
    "3,tcp",
    ",udp,1,",
    "16777217,tcp,0,big.",
]


def write_lines(spark, path, lines):
    spark.createDataFrame([(line,) for line in lines], "value string").write.text(path)
    return path


def test_connection_schema():
    schema = connection_schema()
    kinds = [f.dataType.simpleString() for f in schema.fields]
    assert len(schema) == 42
    assert (kinds.count("double"), kinds.count("int"), kinds.count("string")) == (34, 4, 4)
    assert all(f.nullable for f in schema.fields)
    features = connection_features()
    assert len(features) == 38
    assert features[0] == "duration" and features[-1] == "dst_host_srv_rerror_rate"
    assert not {"protocol_type", "service", "flag", "label"} & set(features)
    assert len(message_schema(schema)) == 46


def test_unknown_kind_is_a_string():
    assert schema_from_text("a: odd.").fields[0].dataType == T.StringType()


def test_csv_keeps_the_same_rows_however_it_is_read(spark, tmp_path):
    path = write_lines(spark, str(tmp_path / "csv"), CSV_ROWS)
    parsed = scan_csv(spark, path, SMALL)
    rows = {tuple(r) for r in parsed.rows.collect()}
    assert rows == {
        (1.5, "tcp", 0, "normal."),
        (None, "udp", 1, None),
        (16777217.0, "tcp", 0, "big."),
    }
    assert parsed.rows.count() == 3
    assert parsed.rows.select("protocol").count() == 3
    assert len(parsed.rows.select("land").collect()) == 3
    bad = parsed.quarantine.collect()
    assert {r.raw for r in bad} == set(CSV_ROWS[1:4])
    assert {r.reason for r in bad} == {"malformed csv"}
    assert {r.source for r in bad} == {path}


def test_json_edge_rows(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])
    lines = ["{bad", '{"a":"x","b":1}', '{"b":1}', '{"a":7,"b":null}', "[1]", "null"]
    path = write_lines(spark, str(tmp_path / "json"), lines)
    parsed = scan_json_checked(spark, path, schema)
    assert {tuple(r) for r in parsed.rows.collect()} == {(None, 1.0), (7, None)}
    assert parsed.rows.select("b").count() == 2
    assert {r.raw for r in parsed.quarantine.collect()} == {lines[0], lines[1], lines[4], lines[5]}


def test_json_directory_columns_stand_once(spark, tmp_path):
    folder = str(tmp_path / "json")
    write_lines(spark, f"{folder}/batch=007/site=x", ['{"a":1,"batch":5}', '{"a":2}', "{bad"])
    write_lines(spark, f"{folder}/batch=8/site=y", ['{"a":3}'])
    for kind, want in ((T.LongType(), [7, 7, 8]), (T.StringType(), ["007", "007", "8"])):
        schema = T.StructType([T.StructField("batch", kind), T.StructField("a", T.LongType())])
        rows = scan_json(spark, folder, schema)
        assert rows.columns == ["batch", "a", "site"] and rows.schema["batch"].dataType == kind
        assert sorted(map(tuple, rows.collect())) == list(zip(want, [1, 2, 3], ["x", "x", "y"], strict=True))
        assert [r.raw for r in scan_json_checked(spark, folder, schema).quarantine.collect()] == ["{bad"]


def test_inferred_and_declared_json(spark, tmp_path):
    path = write_lines(spark, str(tmp_path / "json"), ['{"a":0}', '{"a":0.5}'])
    assert scan_json(spark, path).schema["a"].dataType == T.DoubleType()
    declared = scan_json(spark, path, T.StructType([T.StructField("a", T.StringType())]))
    assert {r.a for r in declared.collect()} == {"0", "0.5"}


def test_format_dispatch(spark, tmp_path):
    path = write_lines(spark, str(tmp_path / "csv"), CSV_ROWS)
    assert scan_records(spark, path, "csv", SMALL).count() == 3
    with pytest.raises(ValueError):
        scan_records(spark, path, "parquet", SMALL)
    with pytest.raises(ValueError):
        scan_records(spark, path, "csv")


def test_messages_write_nulls_out(spark):
    df = spark.createDataFrame([(1, None)], "a int, b double")
    assert df.select(to_message(df.columns).alias("m")).first().m == '{"a":1,"b":null}'
    assert as_messages(df).columns == ["value"]


def test_total_is_null_when_an_operand_is(spark):
    df = spark.createDataFrame(
        [(16777217.0, 2.0), (None, 1.0)], "src_bytes double, dst_bytes double"
    )
    assert [r.total_bytes for r in enrich(df).collect()] == [16777219.0, None]


def test_utc_with_and_without_fraction(spark):
    df = spark.createDataFrame(
        [("2016-04-01T12:00:00.123456",), ("2016-04-01T12:00:00",)], "utc string"
    )
    times = [r.t for r in df.select(parse_utc(F.col("utc")).alias("t")).collect()]
    assert [t.microsecond for t in times] == [123456, 0]


def test_whole_message_is_set_aside_not_its_good_fields(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])
    df = spark.createDataFrame([(5, '{"a":"x","b":1}')], "id int, value string")
    parsed = split_marked(mark_json(df, schema), "malformed", "test")
    assert parsed.rows.count() == 0
    assert parsed.rows.columns == ["id", "a", "b"]


@pytest.mark.parametrize("text", [None, '{"a":4}{"a":5}', '{"a":3,"b":1}junk', '{"a":1},{"a":2}', ""])
def test_a_message_is_one_json_value(spark, text):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])
    df = spark.createDataFrame([(text,), (' {"a":1,"b":2} ',), ('{"a":2}',)], "value string")
    parsed = split_marked(mark_json(df, schema), "malformed", "test")
    assert {r.a for r in parsed.rows.collect()} == {1, 2}
    assert [r.raw for r in parsed.quarantine.collect()] == [text]


def test_a_malformed_landed_line_is_no_record(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    folder = tmp_path / "date=2024-01-01" / "site=x"
    folder.mkdir(parents=True)
    (folder / "part.json").write_text('{"a":1}\n{bad\n\n{"a":2}{"a":3}\n')
    rows, quarantine = scan_sites_checked(spark, str(tmp_path), schema)
    assert [(r.a, str(r.date), r.site) for r in rows.collect()] == [(1, "2024-01-01", "x")]
    assert {r.raw for r in quarantine.collect()} == {"{bad", '{"a":2}{"a":3}'}
    assert scan_sites(spark, str(tmp_path), schema).count() == 1


def landed(spark, root):
    rows = [(f'{{"a":{i}}}', f"2024-01-0{1 + i % 3}", f"0{i % 2}") for i in range(300)]
    rows.append(('{"a":300}', "2024-01-01", "a b:c"))
    df = spark.createDataFrame(rows, "value string, date string, site string").repartition(7)
    land_table(df, root)
    return T.StructType([T.StructField("a", T.LongType())])


def test_sites_are_partitions(spark, tmp_path):
    root = str(tmp_path / "landed")
    schema = landed(spark, root)
    table = scan_sites(spark, root, schema)
    assert table.count() == 301
    assert {r.site for r in table.select("site").distinct().collect()} == {"00", "01", "a b:c"}
    one = scan_sites(spark, root, schema, ["01"]).filter(F.col("date") == "2024-01-02")
    assert one.count() == 50
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "site" in plan.split("PartitionFilters")[1][:200]


def data_files(root):
    return [
        os.path.join(folder, name)
        for folder, _, names in os.walk(root)
        for name in names
        if name.startswith("part-")
    ]


def test_compaction_keeps_every_line_in_fewer_files(spark, tmp_path):
    root, target = str(tmp_path / "landed"), str(tmp_path / "compacted")
    schema = landed(spark, root)
    compact(spark, root, target)
    before = scan_sites(spark, root, schema).collect()
    after = scan_sites(spark, target, schema).collect()
    assert sorted(map(tuple, before)) == sorted(map(tuple, after))
    assert len(data_files(root)) > len(data_files(target)) == 7


def test_a_large_directory_is_compacted_into_several_files(spark, tmp_path):
    root, target = str(tmp_path / "landed"), str(tmp_path / "compacted")
    rows = [(f"{i:06d}", "2024-01-01", "hot") for i in range(4000)]
    frame = spark.createDataFrame(rows, "value string, date string, site string")
    land_table(frame.repartition(40), root)
    compact(spark, root, target, file_bytes=4000)
    sizes = [os.path.getsize(f) for f in data_files(target)]
    assert len(sizes) == 7 and min(sizes) >= 2000 and max(sizes) <= 6000
    assert spark.read.text(target).count() == 4000


def test_one_date_is_compacted_and_others_stay(spark, tmp_path):
    root, target = str(tmp_path / "landed"), str(tmp_path / "compacted")
    schema = landed(spark, root)
    compact(spark, root, target)
    before = set(data_files(target))
    landed(spark, root)
    compact(spark, root, target, dates=["2024-01-02"])
    after = set(data_files(target))
    assert {f.split("date=")[1][:10] for f in before ^ after} == {"2024-01-02"}
    dates = {str(r.date): r["count"] for r in scan_sites(spark, target, schema).groupBy("date").count().collect()}
    assert dates == {"2024-01-01": 101, "2024-01-02": 200, "2024-01-03": 100}
    compact(spark, root, target, dates=["1999-01-01"])
    assert set(data_files(target)) == after
    with pytest.raises(ValueError):
        compact(spark, root, root)


def test_skewed_files_give_even_ones(spark, tmp_path):
    root, target = str(tmp_path / "landed"), str(tmp_path / "compacted")
    folder = tmp_path / "landed" / "date=2024-01-01" / "site=007"
    folder.mkdir(parents=True)
    for n, lines in enumerate([1, 3000, 0, 2, 500, 1500, *[3] * 100]):
        (folder / f"f{n:03d}").write_text("".join(f"{n:05d}-{line:05d}\n" for line in range(lines)))
    compact(spark, root, target, file_bytes=6000)
    sizes = [os.path.getsize(f) for f in data_files(target)]
    assert sum(sizes) == 12 * 5303 and len(sizes) == round(12 * 5303 / 6000)
    assert min(sizes) > 0.5 * 6000 and max(sizes) < 1.5 * 6000
    assert all("site=007" in f for f in data_files(target))


def test_kafka_options():
    read = kafka_read_options("b:9092", "in", rate_per_sec=100, interval_sec=15)
    assert read["startingOffsets"] == "latest"
    assert read["maxOffsetsPerTrigger"] == "1500"
    assert read["kafka.bootstrap.servers"] == "b:9092" and read["subscribe"] == "in"
    assert kafka_read_options("b", "t", rate_per_sec=0.01)["maxOffsetsPerTrigger"] == "1"
    assert "maxOffsetsPerTrigger" not in kafka_read_options("b", "t")
    assert kafka_write_options("b", "out")["kafka.linger.ms"] == "10"

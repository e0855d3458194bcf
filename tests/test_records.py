import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strayrow.operators import features as feat
from strayrow.operators.positions import (
    bucket_bits,
    dense_index,
    number_copies,
    ordered_index,
    with_row_id,
)
from strayrow.operators.records import dedupe, stamp_records

few = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def test_dedupe_keeps_the_first_and_survives_a_hot_key(spark):
    hot = spark.range(3000).select(
        F.lit("hot").alias("uuid"), (F.col("id") + 5).alias("seq"), F.lit("x").alias("v")
    )
    rest = spark.range(100).select(
        F.concat(F.lit("u"), "id").alias("uuid"), F.col("id").alias("seq"), F.lit("y").alias("v")
    )
    kept = dedupe(hot.union(rest).union(rest), ["uuid"], ["seq"])
    assert kept.count() == 101
    assert kept.columns == ["uuid", "seq", "v"]
    assert kept.filter("uuid = 'hot'").first().seq == 5
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_dedupe_without_key_keeps_all(spark):
    df = spark.createDataFrame([(1,), (1,)], "a int")
    assert dedupe(df, None).count() == 2
    assert dedupe(df, ["a"]).count() == 1


def test_copies_are_numbered_in_chunks(spark):
    df = spark.createDataFrame([("a", 1.0)] * 11 + [("b", None)] * 2 + [("c", 2.0)], "k string, v double")
    for chunk in (3, 5, 100):
        got = number_copies(df, per_chunk=chunk)
        rows = sorted((r.k, r.copy_no) for r in got.collect())
        assert rows == [*(("a", i) for i in range(11)), ("b", 0), ("b", 1), ("c", 0)]


def test_a_hot_row_is_written_out_by_several_tasks(spark):
    df = spark.range(60_000).select(F.lit("same").alias("s"))
    tasks = number_copies(df, per_chunk=1000).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 60_000


def test_row_ids_are_unique_without_a_key(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, 1)], "a int, b int")
    ids = [r.row_id for r in with_row_id(df, None).collect()]
    assert len(set(ids)) == 3


def test_bucket_bits_grow_with_the_rows():
    assert bucket_bits(0) == bucket_bits(10) == 5
    assert bucket_bits(1 << 30) == 12
    assert bucket_bits(1 << 40) == 22
    assert bucket_bits(1 << 60) == 40


@few
@given(values=st.lists(st.one_of(st.none(), st.integers(0, 5)), max_size=60))
def test_dense_index_is_a_bijection(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(3)
    got = dense_index(df, rows_per_bucket=2).collect()
    assert sorted(r["index"] for r in got) == list(range(len(values)))
    assert sorted(str(r.v) for r in got) == sorted(str(v) for v in values)


@few
@given(values=st.lists(st.one_of(st.none(), st.integers(0, 5)), max_size=60))
def test_ordered_index_follows_the_order(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(3)
    got = sorted(ordered_index(df, ["v"]).collect(), key=lambda r: r["index"])
    assert [r["index"] for r in got] == list(range(len(values)))
    in_order = sorted(values, key=lambda v: (v is not None, v))
    assert [r.v for r in got] == in_order


def test_positions_do_not_depend_on_the_layout(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    results = {
        tuple(sorted(map(tuple, dense_index(df.repartition(n), key).collect())))
        for n in (1, 7)
        for key in (["id"],)
    }
    assert len(results) == 1
    whole = {
        tuple(sorted(map(tuple, dense_index(df.repartition(n)).collect()))) for n in (1, 7)
    }
    assert len(whole) == 1


def test_stamps(spark):
    df = spark.createDataFrame([(i, f"r{i % 3}") for i in range(50)], "n int, r string")
    first, second = (
        {r.n: (r.sequence_id, r.uuid, r["index"]) for r in stamp_records(df.repartition(k)).collect()}
        for k in (1, 5)
    )
    assert first == second
    assert sorted(v[0] for v in first.values()) == list(range(50))
    assert len({v[1] for v in first.values()}) == 50
    in_order = stamp_records(df, order=["n"]).collect()
    assert all(r.sequence_id == r.n for r in in_order)
    datetime.datetime.fromisoformat(in_order[0].utc)
    random = stamp_records(df, random_uuid=True).collect()
    assert {len(r.uuid) for r in random} == {36}


def test_identical_records_get_different_stamps(spark):
    df = spark.createDataFrame([("a",)] * 4, "r string")
    rows = stamp_records(df).collect()
    assert len({r.uuid for r in rows}) == len({r.sequence_id for r in rows}) == 4


def test_invalid_features(spark):
    df = spark.createDataFrame([(None, 3.0), (float("nan"), 4.0), (1.0, 2.0)], "a double, b double")
    assert feat.assemble(df, ["a", "b"], handle_invalid="skip").count() == 1
    kept = feat.assemble(df, ["a", "b"], handle_invalid="keep").collect()
    assert sum(v != v for r in kept for v in r.features.toArray()) == 2
    with pytest.raises(Exception):
        feat.assemble(df, ["a", "b"]).collect()


def test_vectors_and_pieces_are_inverse(spark):
    df = spark.createDataFrame([(1, 2.0, 3), (2, None, 5)], "id int, a double, b int")
    pieces = feat.unpivot_features(df, ["id"], ["a", "b"])
    assert pieces.count() == 4
    back = {tuple(r) for r in feat.rebuild_rows(pieces, ["id"], ["a", "b"]).collect()}
    assert back == {(1, 2.0, 3.0), (2, None, 5.0)}
    vectors = feat.assemble(df.filter("a is not null"), ["a", "b"])
    exploded = feat.explode_vector(vectors, ["id"]).collect()
    assert {tuple(r) for r in exploded} == {(1, 0, 2.0), (1, 1, 3.0)}
    assert feat.only_vectors(vectors).columns == ["features"]
    columns = feat.vector_columns(vectors.select("id", "features"), ["x", "y"]).first()
    assert tuple(columns) == (1, 2.0, 3.0)


def test_incomplete_rows(spark):
    pieces = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 3.0)], "id int, feature int, value double")
    kept = feat.rebuild_rows(pieces.union(pieces), ["id"], ["a", "b"])
    assert {tuple(r) for r in kept.collect()} == {(1, 1.0, 2.0), (2, 3.0, None)}
    assert feat.rebuild_rows(pieces, ["id"], ["a", "b"], incomplete="drop").count() == 1
    with pytest.raises(Exception):
        feat.rebuild_rows(pieces, ["id"], ["a", "b"], incomplete="error").collect()
    with pytest.raises(ValueError):
        feat.rebuild_rows(pieces, ["id"], ["a", "b"], incomplete="odd")


def test_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "label string")
    got = {r.label: r.label_index for r in feat.index_labels(df, "label").collect()}
    assert got == {"b": 0.0, "a": 1.0, "c": 2.0}
    unlabelled = df.union(spark.createDataFrame([(None,)], "label string"))
    assert {r.label_index for r in feat.index_labels(unlabelled, "label").where("label is null").collect()} == {None}
    numeric = spark.createDataFrame([(1, 2.0)], "label int, a double")
    point = feat.labeled_points(feat.assemble(numeric, ["a"]), "label").first()
    assert point.label == 1.0 and point.features.toArray().tolist() == [2.0]


def test_bag_union(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("x", 1)], "s string, n int")
    assert [tuple(r) for r in feat.union_rows(a, b).collect()] == [(1, "x"), (1, "x")]

"""What the physical plans must look like for the operators to hold on large tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as contract
from strayrow.operators.forest import ForestSettings, contrast_fit, forest_estimator
from strayrow.operators.positions import dense_index, number_copies
from strayrow.operators.records import dedupe
from strayrow.operators.sampling import marginal_resample, poisson_sample
from strayrow.plans.score import score_sites
from strayrow.sources.tables import scan_sites
from strayrow.streaming.landing import land_table
from strayrow.workspace import materialize

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def wide(spark):
    columns = [f"f{j}" for j in range(6)]
    made = spark.range(2000).select(
        "id", F.lit("payload").alias("unused"), *[F.rand(j).alias(c) for j, c in enumerate(columns)]
    )
    return materialize(made, "wide"), columns


@pytest.mark.parametrize(
    "name", ["dense_index", "marginal_resample", "bootstrap_rows", "alerts_first5", "rebuild_rows"]
)
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(contract.queries()[name](spark, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert operator not in text


def test_the_resampled_source_is_not_shuffled(spark, wide):
    table, columns = wide
    text = plan(marginal_resample(table, columns, 0.1, 1, ["id"], rows=2000))
    # Draws to buckets, sizes of buckets (twice, small), positions to rows; then the broadcast.
    assert text.count("Exchange hashpartitioning") == 4
    assert "SortMergeJoin" in text or "BroadcastHashJoin" in text
    assert "unused" not in text


def test_sizes_are_counted_without_reading_values(spark, wide):
    table, columns = wide
    text = plan(dense_index(table, ["id"], rows=2000))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert len(scans) == 2
    assert any("ReadSchema: struct<id:bigint>" in line for line in scans)


def test_draws_are_counted_without_reading_features(spark, wide):
    table, columns = wide
    text = plan(marginal_resample(table, columns, 0.1, 1, ["id"], rows=2000))
    schemas = [line.split("ReadSchema: ")[1] for line in text.splitlines() if "FileScan" in line]
    assert len(schemas) == 2 and "struct<id:bigint>" in schemas


def test_a_sample_has_no_shuffle(spark, wide):
    table, _ = wide
    text = plan(poisson_sample(table.select("id", "f0"), 0.1, 1, ["id"]))
    assert "Exchange" not in text
    assert "ReadSchema: struct<id:bigint,f0:double>" in text


def test_copies_are_counted_before_the_shuffle(spark, wide):
    table, _ = wide
    text = plan(number_copies(table.select("f0", "f1")))
    assert "partial_count" in text
    three = spark.range(3).select(F.lit("x").alias("s"))
    both_branches = number_copies(three.union(spark.range(2).select(F.col("id").cast("string"))), per_chunk=2)
    assert both_branches.count() == 5
    both_branches.collect()
    assert "ReusedExchange" in plan(both_branches)


def test_dropping_copies_aggregates_first(spark, wide):
    table, columns = wide
    assert "partial_first" in plan(dedupe(table, ["id"]))
    assert "partial_min" in plan(dedupe(table, ["id"], ["f0"]))


def test_only_the_files_of_the_wanted_sites_are_read(spark, tmp_path):
    root = str(tmp_path / "landed")
    rows = spark.range(300).select(
        F.to_json(F.struct(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"))).alias("value"),
        F.lit("2024-01-01").alias("date"),
        F.concat(F.lit("site"), F.col("id") % 3).alias("site"),
    )
    land_table(rows.repartition(4), root)
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])
    landed = scan_sites(spark, root, schema)
    model = contrast_fit(landed, forest_estimator(1, ForestSettings(trees=2, max_depth=3)), ["a", "b"], 1.0, 1)
    registry = materialize(landed.select("site").distinct().withColumn("on", F.col("site") == "site1"), "registry")
    scored = score_sites(landed, registry.where("on"), model, ["a", "b"])
    assert "dynamicpruning" in plan(scored)
    for other in ("site0", "site2"):
        for file in (tmp_path / "landed" / "date=2024-01-01" / f"site={other}").glob("part-*"):
            file.unlink()
    assert len(scored.select("a", "prediction").collect()) == 100
    with pytest.raises(Exception, match="[Ff]ile"):
        landed.collect()

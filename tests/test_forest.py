import threading
import time
from functools import reduce

import duckdb
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from strayrow.operators import sampling
from strayrow.operators.alerts import anomalies, count_flagged, first_alerts, first_alerts_per_batch
from strayrow.operators.features import assemble
from strayrow.operators.forest import (
    ForestSettings,
    contrast_fit,
    contrast_set,
    fit_forest,
    forest_estimator,
    score,
    training_tables,
)
from strayrow.operators.positions import with_row_hash, with_row_id
from strayrow.plans.train import TrainingOptions, train, train_and_publish
from strayrow.sources.models import (
    PublishConflict,
    current_version,
    load_published,
    pointer_number,
    publish_model,
    save_model,
)
from strayrow.workspace import materialize, whole_file_session, write_compact

COLUMNS = ["a", "b", "c"]
SMALL = ForestSettings(trees=6, max_depth=8)


def trees(model):
    return model.toDebugString.split("\n", 1)[1]


@pytest.fixture(scope="module")
def records(spark):
    noise = (F.rand(2) - 0.5) * 0.05
    return (
        spark.range(3000)
        .select(F.concat(F.lit("u"), "id").alias("uuid"), F.rand(1).alias("a"))
        .withColumn("b", F.col("a") * 2 + noise)
        .withColumn("c", F.col("b") - F.col("a"))
        .cache()
    )


@pytest.fixture(scope="module")
def model(records):
    return contrast_fit(records, forest_estimator(5, SMALL), COLUMNS, 1.0, 5, ["uuid"])


def test_default_settings(spark):
    forest = forest_estimator(1)
    got = [
        forest.getNumTrees(), forest.getMaxDepth(), forest.getMaxBins(), forest.getImpurity(),
        forest.getFeatureSubsetStrategy(),
    ]
    assert got == [10, 15, 50, "gini", "auto"]


def test_real_rows_are_told_from_resampled_ones(spark, records, model):
    fresh = contrast_set(records, COLUMNS, 1.0, 99, ["uuid"])
    scored = score(assemble(fresh, COLUMNS), model)
    auc = BinaryClassificationEvaluator(labelCol="label").evaluate(scored)
    assert auc > 0.95


def test_same_rows_and_seed_give_the_same_forest(records, model):
    for parts in (1, 5):
        again = contrast_fit(
            records.repartition(parts), forest_estimator(5, SMALL), COLUMNS, 1.0, 5, ["uuid"]
        )
        assert trees(again) == trees(model)


def test_votes_agree_mostly_and_hard_counts_trees(spark, records, model):
    fresh = assemble(contrast_set(records, COLUMNS, 1.0, 99, ["uuid"]), COLUMNS)
    soft = score(fresh, model).select("row_id", F.col("prediction").alias("soft"))
    hard = score(fresh, model, "hard")
    assert set(hard.columns) == {*fresh.columns, "prediction"}
    votes = fresh.select("row_id", "features")
    names = []
    for i, tree in enumerate(model.trees):
        names.append(f"p{i}")
        tree.setPredictionCol(names[-1]).setRawPredictionCol("").setProbabilityCol("")
        votes = tree.transform(votes)
    ones = sum((F.col(n) for n in names), F.lit(0))
    checked = hard.join(votes, "row_id").filter(
        F.col("prediction") != (ones > len(names) / 2).cast("double")
    )
    assert checked.count() == 0
    both = hard.join(soft, "row_id")
    assert both.filter("soft <> prediction").count() < 0.05 * both.count()
    with pytest.raises(ValueError):
        score(fresh, model, "loud")


WALK = """
WITH RECURSIVE nodes AS (
    SELECT treeID AS tree, unnest(nodeData) FROM '{model}/data/*.parquet'),
walk AS (
    SELECT row_id, features, tree, id, leftChild, rightChild, split, impurityStats, prediction
    FROM points, nodes WHERE id = 0
    UNION ALL
    SELECT row_id, features, n.tree, n.id, n.leftChild, n.rightChild, n.split, n.impurityStats, n.prediction
    FROM walk w JOIN nodes n ON n.tree = w.tree AND w.leftChild >= 0 AND n.id = CASE
        WHEN features[w.split.featureIndex + 1] <= w.split.leftCategoriesOrThreshold[1]
        THEN w.leftChild ELSE w.rightChild END),
votes AS (
    SELECT row_id, sum(impurityStats[2] / (impurityStats[1] + impurityStats[2])) AS ones, count(*) AS trees,
           count(*) FILTER (WHERE prediction = 1) AS hard_ones
    FROM walk WHERE leftChild < 0 GROUP BY row_id)
SELECT row_id, CAST(2 * ones > trees AS INT) AS soft, CAST(2 * hard_ones > trees AS INT) AS hard FROM votes
"""


def test_votes_are_those_of_the_saved_node_table(spark, records, model, tmp_path):
    """The saved forest's own nodes, walked by recursive SQL in another engine, row by row."""
    fresh = materialize(contrast_set(records, COLUMNS, 0.3, 99, ["uuid"]), "fresh")
    points = assemble(fresh, COLUMNS)
    soft = score(points, model).select("row_id", "features", F.col("prediction").alias("soft"))
    both = score(soft, model, "hard").select("row_id", "soft", F.col("prediction").alias("hard"))
    ours = sorted((r.row_id, int(r.soft), int(r.hard)) for r in both.collect())
    path = publish_model(spark, model, str(tmp_path / "published"), "1")
    fresh.select("row_id", F.array(*COLUMNS).alias("features")).write.parquet(str(tmp_path / "points"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW points AS SELECT * FROM '{tmp_path}/points/*.parquet'")
    assert sorted(con.execute(WALK.format(model=path)).fetchall()) == ours
    assert {r[1] for r in ours} == {r[2] for r in ours} == {0, 1}


def test_any_two_class_estimator_can_be_wrapped(records):
    other = contrast_fit(records, LogisticRegression(maxIter=2), COLUMNS, 0.2, 5, ["uuid"])
    assert other.numClasses == 2


def test_saved_model_predicts_the_same(spark, records, model, tmp_path):
    root = str(tmp_path / "model")
    assert load_published(spark, root) is None
    publish_model(spark, model, root, "1")
    loaded = load_published(spark, root)
    points = assemble(records, COLUMNS)
    ours = score(points, model).select("uuid", "prediction", "probability")
    theirs = score(points, loaded).select("uuid", "prediction", "probability")
    assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))
    save_model(model, str(tmp_path / "plain"))
    save_model(model, str(tmp_path / "plain"))


def test_failed_retraining_leaves_the_old_model(spark, records, tmp_path):
    root = str(tmp_path / "published")
    options = TrainingOptions(COLUMNS, seed=1, forest=ForestSettings(trees=2, max_depth=3))
    train_and_publish(records, options, root, "1")
    train_and_publish(records.union(records), options._replace(seed=2), root, "2")
    kept = trees(load_published(spark, root))
    with pytest.raises(Exception):
        train_and_publish(records.drop("c"), options, root, "3")
    with pytest.raises(ValueError):
        publish_model(spark, train(records, options), root, "2")
    assert current_version(spark, root) == "2"
    assert trees(load_published(spark, root)) == kept


def test_of_two_publishers_one_wins(spark, records, model, tmp_path):
    root = str(tmp_path / "published")
    seen = pointer_number(spark, root)
    publish_model(spark, model, root, "mine", after=seen)
    with pytest.raises(PublishConflict):
        publish_model(spark, model, root, "theirs", after=seen)
    assert current_version(spark, root) == "mine"
    # A pointer left empty by a publisher that died does not count, and is followed.
    (tmp_path / "published" / "pointers" / f"{2:012d}").write_text("")
    assert current_version(spark, root) == "mine" and load_published(spark, root) is not None
    publish_model(spark, model, root, "next")
    assert current_version(spark, root) == "next"


def test_duplicates_do_not_change_the_training(records):
    options = TrainingOptions(COLUMNS, seed=3, fraction=1.0, forest=SMALL)
    once = train(records, options)
    twice = train(records.union(records).repartition(6), options)
    assert trees(once) == trees(twice)


def test_null_features_follow_the_option(spark, records):
    holed = records.withColumn("a", F.when(F.col("uuid") != "u7", F.col("a")))
    options = TrainingOptions(COLUMNS, forest=ForestSettings(trees=2, max_depth=3))
    train(holed, options._replace(handle_invalid="skip"))
    with pytest.raises(Exception):
        train(holed, options)


def test_alerts(spark):
    df = spark.createDataFrame(
        [(i, "h1" if i % 2 else "h2", 0.0 if i > 4 else 1.0) for i in range(20)],
        "sequence_id int, batch string, prediction double",
    )
    flagged = anomalies(df.repartition(3))
    assert flagged.count() == 15
    alerts = first_alerts(flagged, ["sequence_id"])
    assert sorted(r.sequence_id for r in alerts.collect()) == [5, 6, 7, 8, 9]
    assert {r.alert_text for r in alerts.collect()} == {"predicted to be an anomaly"}
    assert "prediction" not in alerts.columns
    per_batch = first_alerts_per_batch(flagged, "batch", ["sequence_id"], 2)
    assert sorted((r.batch, r.sequence_id) for r in per_batch.collect()) == [
        ("h1", 5), ("h1", 7), ("h2", 6), ("h2", 8),
    ]
    plan = per_batch._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_counts(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 1.0)], "batch string, prediction double")
    got = {r.batch: (r.rows, r.anomalies, r.empty) for r in count_flagged(df, ["batch"]).collect()}
    assert got == {"a": (2, 1, False), "b": (1, 0, False)}
    nothing = count_flagged(df.limit(0)).first()
    assert (nothing["rows"], nothing.anomalies, nothing.empty) == (0, 0, True)


@pytest.mark.parametrize("fails", [False, True])
def test_training_rows_are_laid_out_once_and_let_go(spark, fails):
    class Reader:
        def fit(self, points):
            self.points, self.level = points, points.storageLevel
            self.rows = [points.count(), points.count()]
            if fails:
                raise RuntimeError("no model")
            return "model"

    df = spark.range(40).select("id", F.col("id").cast("double").alias("a"), (F.col("id") % 3).alias("b"))
    reader = Reader()
    if fails:
        with pytest.raises(RuntimeError, match="no model"):
            contrast_fit(df, reader, ["a", "b"], 1.0, 1, ["id"])
    else:
        assert contrast_fit(df, reader, ["a", "b"], 1.0, 1, ["id"]) == "model"
    assert reader.level.useDisk and not reader.level.useMemory and reader.rows == [80, 80]
    assert not reader.points.storageLevel.useDisk


@pytest.fixture
def in_parts(monkeypatch):
    """Resamples of 3,000 rows are cut into parts, as large ones are."""
    monkeypatch.setattr(sampling, "ROWS_PER_PART", 700)


@pytest.mark.parametrize("mode, key", [("exact", ["uuid"]), ("poisson", ["uuid"]), ("exact", None)])
def test_training_tables_hold_the_contrast_set(spark, records, in_parts, mode, key):
    named = records
    if key is None:  # what identifies the rows then
        named = materialize(with_row_id(records.select(*COLUMNS), None, "_identity"), "named")
    want = contrast_set(named, COLUMNS, 1.0, 5, key or ["_identity"], mode)
    tables = training_tables(records, COLUMNS, 1.0, 5, key, mode, 3000)
    assert [label for label, _ in tables] == [0.0, 0.0, 0.0, 0.0, 1.0]
    got = [
        (label, *row) for label, path in tables for row in spark.read.parquet(path).select(*COLUMNS).collect()
    ]
    assert sorted(got) == sorted(tuple(row) for row in want.select("label", *COLUMNS).collect())


def test_parts_of_a_resample_have_consecutive_positions_and_skip_other_draws(spark, records):
    hashed = with_row_hash(records, ["uuid"], "_row")
    parts = sampling.marginal_resample_parts(
        hashed, COLUMNS, 3000, 1.0, 5, parts=3, tasks=2, rows_per_bucket=20
    )
    for number, part in enumerate(parts):
        rows = part.select("row_no", F.spark_partition_id().alias("task")).collect()
        assert sorted(r.row_no for r in rows) == list(range(1000 * number, 1000 * (number + 1)))
        assert {r.task for r in rows} == {0, 1}
        shuffled = executed_exchanges(part)
        assert shuffled and max(shuffled) < 0.5 * 3000 * len(COLUMNS)


def executed_exchanges(df):
    """The rows that every exchange of a query has written."""
    query = df._jdf.queryExecution()
    query.toRdd().count()
    found, nodes = [], [query.executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
        elif node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        nodes += [children.apply(n) for n in range(children.size())]
    return found


def test_compact_tables_leave_no_shuffle_files(spark, records):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        names = [found.apply(n).getName() for n in range(found.size())]
        return {name for name in names if name.startswith("shuffle_")}

    before = files()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(setting)
    path = write_compact(records.groupBy("uuid").count().repartition(3, "uuid"), "compact")
    deadline = time.time() + 20
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(setting) == kept
    assert spark.read.parquet(path).count() == 3000


def test_a_forest_is_the_one_spark_fits_without_its_copy_on_disk(spark, records, in_parts):
    tables = training_tables(records, COLUMNS, 1.0, 5, ["uuid"], "exact", 3000)
    read = whole_file_session(spark).read
    frames = [read.parquet(path).select(F.lit(label).alias("label"), *COLUMNS) for label, path in tables]
    training = assemble(reduce(lambda a, b: a.unionByName(b), frames), COLUMNS).select("label", "features")
    files = sum(len(frame.inputFiles()) for frame in frames)
    assert training.rdd.getNumPartitions() == files >= 8
    forest = forest_estimator(5, SMALL)
    got, want = fit_forest(forest, training), forest.fit(training)
    assert trees(got) == trees(want) and got.uid == want.uid and got.hasSummary
    assert got.featureImportances == want.featureImportances
    assert {p.name: v for p, v in got.extractParamMap().items()} == {
        p.name: v for p, v in want.extractParamMap().items()
    }
    fitted = contrast_fit(records, forest, COLUMNS, 1.0, 5, ["uuid"])
    assert trees(fitted) == trees(got)


def test_no_training_row_is_kept_on_an_executors_disk(spark, records):
    seen, done = set(), threading.Event()

    def watch():
        while not done.is_set():
            for rdd in list(spark.sparkContext._jsc.getPersistentRDDs().values()):
                seen.add((rdd.name(), rdd.getStorageLevel().useDisk()))
            time.sleep(0.01)

    watcher = threading.Thread(target=watch)
    others = {rdd.name() for rdd in spark.sparkContext._jsc.getPersistentRDDs().values()}
    watcher.start()
    try:
        contrast_fit(records, forest_estimator(5, SMALL), COLUMNS, 1.0, 5, ["uuid"])
    finally:
        done.set()
        watcher.join()
    new = {(name, disk) for name, disk in seen if name not in others}
    assert new and not any(disk for _, disk in new)

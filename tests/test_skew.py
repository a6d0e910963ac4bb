"""One patient with a third of all rows, one pile of copies, no broadcasting."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from oncolens.operators import grouping, her2
from oncolens.plans import pipelines, registry, reports
from oncolens.sources.fixtures import view
from tests.conftest import SF
from tests.test_oracle import check

# Small enough that the test data counts as skewed.
SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8kb",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16kb",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """sf0.001 with a third of the orders moved to patient 7, and one order copied 400 times."""
    duckdb = pytest.importorskip("duckdb")
    path = tmp_path_factory.mktemp("hot")
    con = duckdb.connect()
    for source in sorted(Path(SF).glob("*.parquet")):
        query = f"SELECT * FROM '{source}'"
        if source.stem == "orders":
            query = f"SELECT * REPLACE (if(o_orderkey % 3 = 0, 7, o_custkey) AS o_custkey) FROM '{source}'"
        if source.stem == "lineitem":
            copied = f"SELECT * FROM '{source}' WHERE l_orderkey = 360 LIMIT 1"
            query += f" UNION ALL SELECT a.* FROM ({copied}) AS a, range(400)"
        con.execute(f"COPY ({query}) TO '{path}/{source.stem}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {source.stem} AS SELECT * FROM '{path}/{source.stem}.parquet'")
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    yield str(path), con
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize(
    "name",
    [
        "metastatic_on_therapy", "with_both_tests_in_window", "her2_label", "her2_label_with_genetic",
        "nearest_fish_for_ihc", "nearest_fish_for_ihc_genetic", "drop_same_day_conflicts", "receptor_wide",
        "receptor_wide_genetic", "receptor_report", "ras_mutations", "ras_correct_counts",
        "kras_coamplified_by_variant", "kras_wt_amp_percent", "q_h17_labelled", "j07_nearest", "w04_group_min_max",
    ],
)
def test_hot_patient(spark, hot, name):
    path, con = hot
    check(spark, con, name, path)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    collected = df.groupBy(F.spark_partition_id()).count()
    collected.collect()
    return collected._jdf.queryExecution().executedPlan().toString()


def test_hot_group_is_split_at_the_join(spark, tmp_path):
    """Row-level labelling reads a hot same-day group in several tasks."""
    day = view(spark, SF, "patient_test").where("patient_id = 7 AND test_date IS NOT NULL").limit(1)
    copies = day.withColumn("note", F.explode(F.sequence(F.lit(0), F.lit(59999)))).repartition(6, "note")
    copies = copies.withColumn("note", F.col("note").cast("string"))
    copies = copies.withColumn("test_name_code", F.lit("18474-7")).withColumn("test_unit_name", F.col("note"))
    copies = copies.withColumn("test_value_name", F.expr("if(note = '5', 'Positive', 'Negative')"))
    copies.write.parquet(f"{tmp_path}/copies")
    stored = spark.read.parquet(f"{tmp_path}/copies").drop("note")
    before = {k: spark.conf.get(k, None) for k in SKEW}
    try:
        for key, value in SKEW.items():
            spark.conf.set(key, value)
        plan = final_plan(her2.her2_label(stored).where("sameday_ind = 'conflicting'"))
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "skew=true" in plan


def test_copies_do_not_reach_the_patient_shuffle(spark, hot):
    """The merged chain shuffles distinct values: its size does not follow the copies."""
    path, _ = hot
    rows = registry.ALL["her2_label"](lambda n: view(spark, path, n)).count()
    merged = pipelines.labelled_merged(lambda n: view(spark, path, n))
    assert merged.agg(F.sum("n_rows")).first()[0] == rows
    assert merged.count() < rows - 300


def with_skew(spark, run):
    before = {k: spark.conf.get(k, None) for k in SKEW}
    try:
        for key, value in SKEW.items():
            spark.conf.set(key, value)
        return run()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def hot_rows(spark, tmp_path_factory):
    """Patient 0 has a third of 90,000 rows."""
    path = str(tmp_path_factory.mktemp("rows"))
    rows = spark.range(0, 90000, numPartitions=6).selectExpr(
        "if(id % 3 = 0, 0, 1 + id % 500) AS patient_id", "CAST(id AS string) AS note"
    )
    rows.write.parquet(f"{path}/rows")
    return spark.read.parquet(f"{path}/rows")


@pytest.mark.parametrize("join", ["keys_in", "keys_not_in", "join_per_patient"])
def test_row_level_joins_split_a_hot_patient(spark, hot_rows, join):
    listed = hot_rows.where("patient_id < 40 OR patient_id > 480")
    run = {
        "keys_in": lambda: grouping.keys_in(hot_rows, listed),
        "keys_not_in": lambda: grouping.keys_not_in(hot_rows, listed.where("patient_id > 3")),
        "join_per_patient": lambda: grouping.join_per_patient(
            hot_rows, listed.groupBy("patient_id").agg(F.max("note").alias("last"))
        ),
    }[join]
    assert "skew=true" in with_skew(spark, lambda: final_plan(run()))


def test_sort_cuts_a_hot_value(spark, hot_rows):
    def sizes():
        ordered = reports.sorted_by(hot_rows, "patient_id")
        return [r["count"] for r in ordered.groupBy(F.spark_partition_id().alias("p")).count().collect()]

    assert max(with_skew(spark, sizes)) < 90000 / 3


def test_free_text_does_not_fill_a_patient(spark, tmp_path):
    """One patient with thousands of test names and numbers a day: what is placed on the
    patient is one row per day, method and result."""
    rows = spark.range(0, 60000, numPartitions=6).selectExpr(
        "CAST(7 AS BIGINT) AS patient_id", "'18474-7' AS test_name_code",
        "date_add(DATE '1998-01-01', CAST(id % 20 AS INT)) AS test_date", "DATE '1998-01-01' AS test_collection_date",
        "IF(id % 2 = 0, 'Immunohistochemistry', 'FISH') AS test_method_name", "concat('HER2 ', id) AS test_name_name",
        "'Negative' AS test_value_name", "IF(id % 3 = 0, NULL, concat('', id)) AS test_value_numeric",
        "CAST(NULL AS STRING) AS test_unit_name", "CAST(NULL AS STRING) AS genetic_test_type_name",
        "1 AS curation_indicator",
    )
    rows.write.parquet(f"{tmp_path}/tests")
    tests = spark.read.parquet(f"{tmp_path}/tests")
    settled = her2.settled_tests(tests)
    assert settled.count() == 20 and settled.agg(F.sum("n_rows")).first()[0] >= 20000
    judged = her2.label_merged(tests)
    sizes = [r["count"] for r in judged.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 60000 / 2


def test_ranks_of_a_patient_with_very_many_variants(spark, tmp_path):
    """10^5 distinct variants of one patient are ranked in ranges: no task sorts more than a few of them, ranks are dense."""
    rows = spark.range(0, 120_000, numPartitions=6).selectExpr(
        "if(id < 100000, 7, id) AS patient_id", "if(id = 99999, NULL, concat('p.', sha2(CAST(id AS STRING), 256))) AS variant"
    )
    rows.write.parquet(f"{tmp_path}/variants")
    stored = spark.read.parquet(f"{tmp_path}/variants")
    ranked = grouping.dense_rank_values(stored, ["patient_id"], "variant", "r", cells=64)
    hot = ranked.where("patient_id = 7")
    found = hot.agg(F.count("*"), F.count_distinct("r"), F.min("r"), F.max("r"), F.max(F.when(F.expr("variant IS NULL"), F.col("r")))).first()
    assert tuple(found) == (100_000, 100_000, 1, 100_000, 100_000)
    ordered = hot.where("variant IS NOT NULL").orderBy("r").limit(500).select("variant").collect()
    assert [r[0] for r in ordered] == sorted(r[0] for r in ordered)
    assert ranked.where("patient_id <> 7 AND r <> 1").isEmpty()
    cells = hot.groupBy(F.spark_partition_id().alias("task")).count()
    sizes = with_skew(spark, lambda: [r["count"] for r in cells.collect()])
    assert len(sizes) > 2 and max(sizes) < 60_000  # four shuffle partitions here; a range has some 1,600
    splitters = grouping.value_splitters(stored, "variant", 64)
    sample = spark.range(1).select(splitters.alias("s")).first().s
    assert sample == sorted(set(sample)) and 40 < len(sample) <= 64


def scans_of_tests(df):
    plan = final_plan(df).split("+- == Initial Plan ==")[0]
    return sum("FileScan" in line and "l_orderkey" in line for line in plan.splitlines())


ONE_READ = ("q_h16_combined_negative", "q_h16_negative_counts", "q_h17_nearest", "q_h17_combined")
FUNNEL = ("n_her2_in_window", "with_both_tests_in_window", "funnel_counts")


# Medication and the tests come from the same files here, so the funnel reads these twice.
@pytest.mark.parametrize(
    "name, most",
    [*[(n, 1) for n in ONE_READ], *[(n, 2) for n in FUNNEL], ("receptor_wide", 2)],
)
def test_tests_are_scanned_as_seldom_as_can_be(spark, name, most):
    assert 0 < scans_of_tests(registry.run(name, spark, SF)) <= most


@pytest.mark.parametrize("source", pipelines.SOURCES)
def test_staged_reports_equal_single_queries(spark, source):
    def load(name):
        return view(spark, SF, name)

    staged = registry.staged_reports(load, source)
    assert len(staged) >= 4
    single = ("receptor_report", "q_h13_wide", "q_h18_wide_preview")
    for name, df in staged.items():
        assert scans_of_tests(df) == 0
        if name.startswith(single):
            assert df.collect() == registry.ALL[name](load).collect()

"""Loading, checking and storing tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from oncolens.operators.windowed import her2_test_filter
from oncolens.plans import pipelines, registry
from oncolens.sources import tables
from oncolens.sources.fixtures import VIEWS, view
from tests.conftest import SF


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The fixture views written out as real tables."""
    path = tmp_path_factory.mktemp("clinical")
    for name in VIEWS:
        view(spark, SF, name).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_fixture_views_have_the_declared_columns(spark):
    for name, schema in tables.SCHEMAS.items():
        df = view(spark, SF, name)
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]


def test_physical_tables_give_the_same_status(spark, folder):
    def load(name):
        return tables.read_folder(spark, folder, name)

    physical = registry.plain(pipelines.receptor_status(load)).collect()
    derived = registry.run("receptor_wide", spark, SF).collect()
    assert sorted(map(str, physical)) == sorted(map(str, derived))


def test_filters_and_columns_reach_the_scan(spark, folder):
    tests = tables.read_folder(spark, folder, "patient_test")
    plan = her2_test_filter(tests).select("patient_id", "test_date")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "In(test_name_code" in plan
    assert "test_unit_name" not in scan and "test_collection_date" not in scan


def _depth(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-"))


def test_status_scans_each_table_no_more_than_needed(spark, folder):
    df = pipelines.receptor_status(lambda n: tables.read_folder(spark, folder, n), cut_above=0)
    df.collect()
    executed = df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
    lines, scans, skip = executed.splitlines(), 0, None
    for line in lines:  # a subquery shows its initial plan too, indented below its heading
        depth = _depth(line)
        skip = None if skip is not None and depth < skip else skip
        if "== Initial Plan ==" in line:
            skip = depth
        scans += skip is None and "FileScan parquet" in line
    # HER2 and ER/PR tests; condition for receptor diagnoses and for onset; stage once. The
    # cohort's bitmap reads condition and stage once more, whoever uses it.
    assert scans == 7


def test_cohort_cuts_the_tests_below_the_first_exchange(spark, folder):
    def load(name):
        return tables.read_folder(spark, folder, name)

    large = tables.scanned_bytes(load("genetic_test"))
    assert 0 < large < tables.scanned_bytes(load("patient_test").join(load("genetic_test"), "patient_id"))
    assert "shiftright" not in pipelines.receptor_status(load, "genetic")._jdf.queryExecution().toString()
    df = pipelines.receptor_status(load, "genetic", cut_above=0)
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    tests = [k for k, line in enumerate(lines) if "FileScan parquet" in line and ("test_name" in line or "biomarker" in line)]
    assert len(tests) == 4
    for k in tests:  # between a scan and its parent stand the subqueries of the parent's condition
        depth = _depth(lines[k])
        parent = next(lines[j] for j in range(k, -1, -1) if _depth(lines[j]) < depth)
        assert "Filter" in parent and "shiftright(Subquery" in parent


def test_namespaces(spark, folder):
    spark.sql("CREATE DATABASE IF NOT EXISTS release_a")
    tables.read_folder(spark, folder, "drug_cohort").write.mode("overwrite").saveAsTable("release_a.drug_cohort")
    assert tables.read_table(spark, "drug_cohort", "release_a").count() == 25
    try:
        tables.use_namespace(spark, "release_a")
        assert tables.read_table(spark, "drug_cohort").count() == 25
    finally:
        tables.use_namespace(spark, "default")
        spark.sql("DROP DATABASE release_a CASCADE")


def test_conform_checks_columns_and_types(spark):
    good = "CAST(1 AS bigint) patient_id, 1 curation_indicator, timestamp'2000-01-02 03:04:05' stage_date, "
    good += "'2000-01' stage_date_collected, 'x' stage_group_name, 'y' mstage_name"
    df = spark.sql(f"SELECT {good}")
    assert dict(tables.conform(df, "stage").dtypes)["stage_date"] == "date"
    with pytest.raises(ValueError, match="missing"):
        tables.conform(df.drop("mstage_name"), "stage")
    with pytest.raises(ValueError, match="expected text"):
        tables.conform(df.selectExpr("* except (mstage_name)", "1 mstage_name"), "stage")
    with pytest.raises(ValueError, match="expected a date"):
        tables.conform(df.selectExpr("* except (stage_date)", "'2000' stage_date"), "stage")
    text_key = df.selectExpr("* except (patient_id)", "explode(array('p1', NULL)) patient_id")
    assert tables.conform(text_key, "stage").count() == 1
    assert tables.conform(text_key, "stage", keep_null_patients=True).count() == 2


def test_text_patient_keys_work_through_the_pipeline(spark, folder):
    def load(name):
        df = tables.read_folder(spark, folder, name)
        return df.withColumn("patient_id", df.patient_id.cast("string")) if "patient_id" in df.columns else df

    assert pipelines.receptor_status(load).count() == 74
    assert pipelines.ras_secondary_percent(load).first().percent_secondary == pytest.approx(99.33, abs=0.01)


class FakeCluster:
    """As much of a session on a cluster as the choice of the stage folder asks for."""

    def __init__(self, folder):
        self.conf = {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": "yarn"})


def test_stages(spark):
    df = spark.range(5)
    tables.name_stage(df, "five")
    tables.name_stage(spark.range(7), "five")
    assert spark.table("five").count() == 7
    with pytest.raises(ValueError, match="shared_mount"):
        tables._stage_folder(FakeCluster("file:///tmp/x"), False)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables._stage_folder(FakeCluster(None), False)
    assert tables._stage_folder(FakeCluster("file:///mnt/x"), True) == "file:///mnt/x"
    assert tables._stage_folder(FakeCluster("hdfs://x/y"), False) == "hdfs://x/y"
    first, second = tables.store_stage(df, "s"), tables.store_stage(df, "s")
    assert first.inputFiles() and set(first.inputFiles()).isdisjoint(second.inputFiles())
    assert first.count() == second.count() == 5


def test_named_stage_is_replaced_as_a_whole(spark):
    stage = tables.NamedStage(spark, "cohort-of-a-test")
    folder = Path(stage.folder)
    assert not stage.exists() and not stage.drop()
    with pytest.raises(LookupError):
        stage.read()
    first = stage.replace(spark.range(3).withColumnRenamed("id", "patient_id"))
    second = stage.replace(first.where("patient_id > 0").withColumn("x", F.lit("a")))  # built from itself
    assert sorted(map(tuple, second.collect())) == [(1, "a"), (2, "a")]
    assert first.count() == 3  # who began with the version before still has it
    broken = second.withColumn("x", F.expr("IF(patient_id = 2, raise_error('broken'), x)"))
    with pytest.raises(Exception, match="broken"):
        stage.replace(broken)
    assert sorted(map(tuple, stage.read().collect())) == [(1, "a"), (2, "a")]
    third = stage.replace(second.limit(0))
    assert third.count() == 0 and third.columns == ["patient_id", "x"]
    versions = [p.name for p in folder.iterdir() if p.name.startswith("v-")]
    assert len(versions) == 2  # the current one and the one before; a failed build leaves none
    assert tables.NamedStage(spark, "cohort-of-a-test").read().count() == 0  # found by its name
    assert stage.drop() and not stage.exists() and not folder.exists()
    for name in ("", "../x", "a/b"):
        with pytest.raises(ValueError, match="no name"):
            tables.NamedStage(spark, name)


def _exchanges(df):
    """Exchanges of the plan itself, those of its subqueries aside."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line and "groupingexpression" not in line for line in text.splitlines())


@pytest.mark.parametrize(
    "plan", [pipelines.nearest_fish, pipelines.nearest_fish_by_ruleset, pipelines.her2_results, pipelines.her2_results_by_ruleset]
)
def test_bucketed_tests_are_not_exchanged(spark, folder, bucketed, plan):
    """HER2 tests in buckets by patient: judged, merged, matched and unfolded with the same rows and no exchange."""
    df = plan(pipelines.placed(lambda n: tables.read_table(spark, n, bucketed)))
    assert _exchanges(df) == 0
    plain = plan(lambda n: tables.read_folder(spark, folder, n))
    assert _exchanges(plain) >= 3
    assert sorted(map(str, df.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("source", pipelines.SOURCES)
def test_bucketed_tables_give_the_same_status(spark, folder, bucketed, source):
    df = pipelines.receptor_status(pipelines.placed(lambda n: tables.read_table(spark, n, bucketed)), source)
    want = pipelines.receptor_status(lambda n: tables.read_folder(spark, folder, n), source)
    assert sorted(map(str, df.collect())) == sorted(map(str, want.collect()))


@pytest.fixture(scope="module")
def bucketed(spark, folder):
    spark.sql("CREATE DATABASE IF NOT EXISTS by_patient")
    for name in ("stage", "condition", "patient_test", "genetic_test"):
        tables.write_bucketed(tables.read_folder(spark, folder, name), name, "by_patient", buckets=4)
    return "by_patient"

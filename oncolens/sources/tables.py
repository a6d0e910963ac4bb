"""Declared input tables: load from a catalogue namespace or a folder, check, reuse.

Namespaces (a database such as one per release) are chosen per call, so two
releases can be read side by side in one job.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _DAY, _INT, _LONG = T.StringType(), T.DateType(), T.IntegerType(), T.LongType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "stage": _schema(
        patient_id=_LONG, curation_indicator=_INT, stage_date=_DAY, stage_date_collected=_TEXT,
        stage_group_name=_TEXT, mstage_name=_TEXT,
    ),
    "condition": _schema(
        patient_id=_LONG, curation_indicator=_INT, diagnosis_date=_DAY, diagnosis_date_collected=_TEXT,
        diagnosis_type_name=_TEXT, diagnosis_type_code=_TEXT, diagnosis_code_code=_TEXT, diagnosis_code_name=_TEXT,
    ),
    "medication": _schema(
        patient_id=_LONG, med_generic_name_code=_TEXT, med_generic_name_name=_TEXT, med_route_name=_TEXT,
        med_status=_TEXT,
    ),
    "drug": _schema(drug_code=_LONG, drug_name=_TEXT, broad_category=_TEXT, antineoplastic=_TEXT),
    "drug_rxnorm_map": _schema(drug_code=_LONG, rxcui=_TEXT),
    "drug_condition": _schema(drug_code=_LONG, condition_code=_LONG),
    "drug_cohort": _schema(condition_code=_LONG, patient_cohort=_TEXT),
    "patient_test": _schema(
        patient_id=_LONG, test_name_code=_TEXT, test_date=_DAY, test_collection_date=_DAY, test_method_name=_TEXT,
        test_name_name=_TEXT, test_value_name=_TEXT, test_value_numeric=_TEXT, test_unit_name=_TEXT,
        genetic_test_type_name=_TEXT, curation_indicator=_INT,
    ),
    "genetic_test": _schema(
        patient_id=_LONG, report_date=_DAY, specimen_collected_date=_DAY, biomarker_name=_TEXT,
        biomarker_test_type=_TEXT, biomarker_variant_type=_TEXT, test_result=_TEXT, test_result_1_numeric=_TEXT,
        test_result_1_unit=_TEXT, test_result_2_numeric=_TEXT, test_result_2_unit=_TEXT,
    ),
    "biomarker_table": _schema(
        patient_id=_LONG, biomarker_name_name=_TEXT, biomarker_variant_type_name=_TEXT, test_result_name=_TEXT,
        molecular_variant=_TEXT, variant_classification_name=_TEXT, report_date=_DAY,
    ),
}

_FORBIDDEN_AS_TEXT = (T.NumericType, T.BooleanType, T.ArrayType, T.MapType, T.StructType)


def conform(df: DataFrame, name: str, keep_null_patients: bool = False) -> DataFrame:
    """The declared columns of ``name`` in declared order, checked before any job runs.

    Timestamps become dates. The type of ``patient_id`` is left as it comes, since
    no operator depends on it. Rows without a patient are dropped: no operator can
    place them, and one such row would empty every NOT IN.
    """
    declared = SCHEMAS[name]
    missing = [f.name for f in declared if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    out = []
    for f in declared:
        found = df.schema[f.name].dataType
        column = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            if not isinstance(found, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                raise ValueError(f"{name}.{f.name}: expected a date, found {found.simpleString()}")
            if not isinstance(found, T.DateType):
                column = F.to_date(column).alias(f.name)
        elif isinstance(f.dataType, T.StringType) and isinstance(found, _FORBIDDEN_AS_TEXT):
            # '2+' and '1-2' are results: a numeric column would already have lost them.
            raise ValueError(f"{name}.{f.name}: expected text, found {found.simpleString()}")
        out.append(column)
    df = df.select(*out)
    if "patient_id" in df.columns and not keep_null_patients:
        df = df.where(F.col("patient_id").isNotNull())
    return df


def read_table(spark: SparkSession, name: str, namespace: str | None = None, **options: bool) -> DataFrame:
    """A catalogue table, qualified by ``namespace`` or from the current database."""
    return conform(spark.table(f"{namespace}.{name}" if namespace else name), name, **options)


def read_folder(spark: SparkSession, folder: str, name: str, **options: bool) -> DataFrame:
    """A parquet table ``folder/name.parquet``."""
    return conform(spark.read.parquet(f"{folder}/{name}.parquet"), name, **options)


def scanned_bytes(df: DataFrame) -> int:
    """What the sources of ``df`` hold by Spark's estimate; nothing is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def use_namespace(spark: SparkSession, namespace: str) -> None:
    """Make unqualified names resolve in ``namespace`` from here on."""
    spark.catalog.setCurrentDatabase(namespace)


def name_stage(df: DataFrame, name: str) -> DataFrame:
    """Register a stage for SQL users; running it again replaces the old one."""
    df.createOrReplaceTempView(name)
    return df


def write_bucketed(df: DataFrame, name: str, namespace: str | None = None, buckets: int = 200) -> DataFrame:
    """Save a table in buckets by patient, each one file sorted by patient, and return it read back.

    A hash of the patient names the bucket, so what works patient by patient on such a
    table, or joins such tables with the same number of buckets, needs no exchange
    (``pipelines.placed``). Where different tables meet in a union Spark 4.1 loses that in
    most plans and exchanges what is left by then. Take as many buckets as the cluster runs
    tasks, or a multiple. An existing table of the name is replaced.
    """
    full = f"{namespace}.{name}" if namespace else name
    placed = df.repartition(buckets, "patient_id")
    placed.write.mode("overwrite").bucketBy(buckets, "patient_id").sortBy("patient_id").saveAsTable(full)
    return df.sparkSession.table(full)


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="oncolens-stages-")


def _stage_folder(spark: SparkSession, shared_mount: bool) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.master.startswith("local"):
        return folder or _local_folder()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if folder.startswith("file:") and not shared_mount:
        raise ValueError(f"{folder} is on each machine's own disk; shared_mount=True says it is mounted on all")
    return folder


def store_stage(df: DataFrame, name: str, shared_mount: bool = False) -> DataFrame:
    """Write a stage that several reports read, and return it read back.

    It goes to the shared folder in ``spark.checkpoint.dir`` under a fresh name,
    so a lost executor costs no recomputation and no run overwrites another. On a
    cluster the folder must be set and must not be a ``file:`` one, unless
    ``shared_mount`` says that all machines mount it; a local session has a default.
    """
    spark = df.sparkSession
    folder = _stage_folder(spark, shared_mount)
    path = f"{folder.rstrip('/')}/oncolens-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- named stages ---------------------------------------------------------
class NamedStage:
    """A stage that is rebuilt as a whole under one name, readers seeing the old one or the new one.

    Its folder holds versions and a small manifest that names the current one. A build
    writes its version aside and then switches the manifest by one rename, which file
    systems such as HDFS do at once; on object stores without it the switch is a copy. The
    version before the current stays for those who began to read it, older ones are cleared. A
    build that fails leaves everything as it was. One driver at a time rebuilds a stage.
    """

    def __init__(self, spark: SparkSession, name: str, shared_mount: bool = False):
        if not re.fullmatch(r"\w[\w.-]*", name):
            raise ValueError(f"{name!r} is no name for a stage")
        self.spark, self.name = spark, name
        self.folder = f"{_stage_folder(spark, shared_mount).rstrip('/')}/oncolens-stage-{name}"
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self._path().getFileSystem(self.conf)

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _manifest(self) -> dict | None:
        path = self._path("manifest")
        if not self.files.exists(path):
            return None
        stream = self.files.open(path)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _switch(self, manifest: dict) -> None:
        aside = self._path(f"manifest-{uuid.uuid4().hex}")
        stream = self.files.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        kinds = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.OVERWRITE
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.conf)
        files.rename(files.makeQualified(aside), files.makeQualified(self._path("manifest")), options)

    def replace(self, df: DataFrame) -> DataFrame:
        """Build the stage anew from ``df``, which may read the stage itself, and return it read back."""
        old, version = self._manifest() or {}, f"v-{uuid.uuid4().hex}"
        try:
            df.write.mode("errorifexists").parquet(str(self._path(version)))
            self._switch({"version": version, "before": old.get("version"), "schema": df.schema.jsonValue()})
        except BaseException:
            self.files.delete(self._path(version), True)
            raise
        if old.get("before"):
            self.files.delete(self._path(old["before"]), True)
        return self.read()

    def exists(self) -> bool:
        return self._manifest() is not None

    def read(self) -> DataFrame:
        found = self._manifest()
        if found is None:
            raise LookupError(f"no stage {self.name}")
        schema = T.StructType.fromJson(found["schema"])
        return self.spark.read.schema(schema).parquet(str(self._path(found["version"])))

    def drop(self) -> bool:
        """Remove the stage if there is one, and say whether there was."""
        return self.files.delete(self._path(), True)

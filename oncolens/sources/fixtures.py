"""The clinical input tables as projections of the driver's star schema.

Each table is one SELECT that means the same in Spark SQL and in DuckDB, so both
engines start from identical rows (see FIXTURES.md). The texts differ in one place:
a choice by remainder is a CASE in DuckDB and an index into a constant array in Spark,
since long CASE chains outgrow the size up to which the JVM compiles a method.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _lit(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


@dataclass(frozen=True)
class Choice:
    """values[expr], the last one standing for every other remainder."""

    expr: str
    values: tuple[str | None, ...]

    def spark(self) -> str:
        items = ", ".join(_lit(v) for v in self.values)
        return f"get(array({items}), CAST(least({self.expr}, {len(self.values) - 1}) AS INT))"

    def duckdb(self) -> str:
        whens = " ".join(f"WHEN {i} THEN {_lit(v)}" for i, v in enumerate(self.values[:-1]))
        return f"CASE {self.expr} {whens} ELSE {_lit(self.values[-1])} END"


@dataclass(frozen=True)
class Either:
    """One expression where ``condition`` holds, another where not."""

    condition: str
    then: str | Choice | Either
    otherwise: str | Choice | Either

    def spark(self) -> str:
        return f"CASE WHEN {self.condition} THEN {spark_text(self.then)} ELSE {spark_text(self.otherwise)} END"

    def duckdb(self) -> str:
        return f"CASE WHEN {self.condition} THEN {duckdb_text(self.then)} ELSE {duckdb_text(self.otherwise)} END"


def spark_text(e: str | Choice | Either) -> str:
    return e if isinstance(e, str) else e.spark()


def duckdb_text(e: str | Choice | Either) -> str:
    return e if isinstance(e, str) else e.duckdb()


def pick(expr: str, *values: str | None) -> Choice:
    return Choice(expr, values)


def lookup(expr: str, pairs: dict, otherwise: str | None) -> str:
    whens = " ".join(f"WHEN {k} THEN {_lit(v)}" for k, v in pairs.items())
    return f"CASE {expr} {whens} ELSE {_lit(otherwise)} END"


DAY = "CAST(o_orderdate AS DATE)"
DAY_TEXT = f"CAST({DAY} AS STRING)"
PARTIAL_DAY = (
    f"CASE WHEN o_orderkey % 7 = 0 THEN substr({DAY_TEXT},1,4) "
    f"WHEN o_orderkey % 7 = 1 THEN substr({DAY_TEXT},1,7) "
    f"WHEN o_orderkey % 31 = 2 THEN NULL ELSE {DAY_TEXT} END"
)
# Patients whose results go by the kind of test, so that every counted receptor group has some.
SORTED_PATIENTS = "o_custkey % 9 = 8"
HER2_NAMES = ("Borderline", "Low", "Borderline", "Low", "Negative")
RESULT_NAMES = ("Positive", "Negative", "Negative", "Borderline", "Equivocal", "Low", None, "Not Recorded")


@dataclass(frozen=True)
class View:
    tables: tuple[str, ...]
    columns: dict[str, str | Choice | Either] = field(default_factory=dict)
    where: str | None = None


ORDER_LINES = ("lineitem", "orders")

VIEWS: dict[str, View] = {
    "stage": View(
        ("orders",),
        {
            "patient_id": "o_custkey",
            "curation_indicator": "CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END",
            "stage_date": DAY,
            "stage_date_collected": PARTIAL_DAY,
            "stage_group_name": "CASE WHEN o_orderstatus='F' AND o_orderpriority='1-URGENT' THEN 'Stage 4B' "
            "WHEN o_orderpriority='2-HIGH' THEN 'Stage 2' ELSE NULL END",
            "mstage_name": "CASE WHEN o_orderstatus='P' AND o_orderpriority='5-LOW' AND o_orderkey % 3 = 0 "
            "THEN 'cM1a' ELSE 'M0' END",
        },
    ),
    "condition": View(
        ("orders",),
        {
            "patient_id": "o_custkey",
            "curation_indicator": "CASE WHEN o_orderkey % 4 = 1 THEN 0 ELSE 1 END",
            "diagnosis_date": DAY,
            "diagnosis_date_collected": PARTIAL_DAY,
            "diagnosis_type_name": lookup("o_orderkey % 29", {0: "Metastatic neoplasm", 1: "metastatic"}, "Primary"),
            "diagnosis_type_code": "CASE WHEN o_orderkey % 37 = 0 THEN '109359008' ELSE '86049000' END",
            "diagnosis_code_code": lookup("o_orderkey % 19", {0: "Z17.0", 1: "z17.1"}, "C50.9"),
            "diagnosis_code_name": lookup(
                "o_orderkey % 19",
                {0: "Estrogen receptor positive status", 1: "Estrogen receptor negative status"},
                "Malignant neoplasm of breast",
            ),
        },
    ),
    "medication": View(
        ORDER_LINES,
        {
            "patient_id": "o_custkey",
            "med_generic_name_code": "CAST(l_partkey AS STRING)",
            "med_generic_name_name": "concat('generic-',CAST(l_partkey AS STRING))",
            "med_route_name": lookup("l_returnflag", {"'A'": "Intravenous push", "'N'": "Oral"}, None),
            "med_status": "CASE WHEN l_linestatus='F' THEN 'administered' ELSE 'ordered' END",
        },
    ),
    "drug": View(
        ("part",),
        {
            "drug_code": "p_partkey",
            "drug_name": "p_name",
            "broad_category": "p_type",
            "antineoplastic": "CASE WHEN p_size = 50 THEN NULL WHEN p_size % 3 = 2 THEN 'never' "
            "WHEN p_size % 3 = 1 THEN 'sometimes' ELSE 'always' END",
        },
    ),
    "drug_rxnorm_map": View(("part",), {"drug_code": "p_partkey", "rxcui": "CAST(p_partkey AS STRING)"}),
    "drug_condition": View(("part",), {"drug_code": "p_partkey", "condition_code": "p_partkey % 25"}),
    "drug_cohort": View(
        ("nation",),
        {
            "condition_code": "CAST(n_nationkey AS BIGINT)",
            "patient_cohort": "CASE WHEN n_regionkey = 0 THEN 'breast' ELSE 'other' END",
        },
    ),
    "patient_test": View(
        ORDER_LINES,
        {
            "patient_id": "o_custkey",
            "test_name_code": pick(
                "o_orderkey % 12", "18474-7", "72383-3", "3430", "C16152", "48676-1", "14228-1", "3467",
                "16113-3", "8910", "HR-PANEL", "40557-1", "OTHER",
            ),
            "test_date": f"CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE {DAY} END",
            "test_collection_date": "CAST(l_shipdate AS DATE)",
            "test_method_name": pick(
                "o_orderkey % 5", "Immunohistochemistry", "FISH", "Fluorescence in situ hybridization",
                "Immunohistochemistry", None,
            ),
            "test_name_name": pick(
                "o_orderkey % 12", "HER2 Ag Tissue", "HER2 presence by immunoassay", "ERBB2 gene",
                "ERBB2 amplification", "HER2 status", "Estrogen receptor", "Estrogen receptor gene",
                "Progesterone receptor by immune stain", "Progesterone receptor", "Hormone receptor panel",
                "Progesterone receptor", "Ki-67",
            ),
            "test_value_name": Either(
                SORTED_PATIENTS,
                Either(
                    "o_orderkey % 12 >= 5",
                    pick("o_custkey % 2", "Positive", "Negative"),
                    Either("o_orderkey % 5 IN (1, 2)", "'Negative'", pick("o_custkey % 5", *HER2_NAMES)),
                ),
                Either("o_orderkey % 7 < 4", pick("o_custkey % 8", *RESULT_NAMES), pick("l_partkey % 8", *RESULT_NAMES)),
            ),
            "test_value_numeric": pick("l_suppkey % 9", None, None, "1", "1+", "2+", "0", "3+", "1.0", "2"),
            "test_unit_name": "CASE WHEN l_suppkey % 2 = 0 THEN 'Staining Intensity (+)' ELSE NULL END",
            "genetic_test_type_name": pick(
                "o_orderkey % 11", "Copy number variation", "Gene amplification", "Mutation", None
            ),
            "curation_indicator": "CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END",
        },
    ),
    "genetic_test": View(
        ORDER_LINES,
        {
            "patient_id": "o_custkey",
            "report_date": DAY,
            "specimen_collected_date": "CAST(l_shipdate AS DATE)",
            "biomarker_name": pick("o_orderkey % 5", "ERBB2", "ESR1", "PGR", "ERBB2", "TP53"),
            "biomarker_test_type": pick(
                "l_partkey % 5", "IHC", "ICC", "FISH", "Chromogenic In Situ Hybridization", "NGS"
            ),
            # Not in FIXTURES.md: needed by the report that groups by variant type.
            "biomarker_variant_type": pick("o_orderkey % 3", "Copy number", "Mutation", None),
            "test_result": Either(
                SORTED_PATIENTS,
                Either("l_partkey % 5 >= 2", "'Negative'", pick("o_custkey % 5", *HER2_NAMES)),
                pick("l_suppkey % 4", "Positive", "Negative", "Equivocal", None),
            ),
            "test_result_1_numeric": pick("l_suppkey % 6", "0", "1", "1.0", "2", "3", None),
            "test_result_1_unit": pick("l_suppkey % 3", "Staining Intensity (+)", "HER2/CEP-17 ratio", None),
            "test_result_2_numeric": pick("l_partkey % 6", "0", "1", "2.0", "2", "3", None),
            "test_result_2_unit": pick("l_partkey % 3", "ERBB2:CEP17", "percent", None),
        },
    ),
    "biomarker_table": View(
        ORDER_LINES,
        {
            "patient_id": "o_custkey",
            "biomarker_name_name": pick("l_partkey % 5", "KRAS", "KRAS", "NRAS", "HRAS", "TP53"),
            "biomarker_variant_type_name": pick(
                "l_suppkey % 12", "Gene Mutation", "Gene Amplification", "Gene Mutation",
                "Gene Rearrangement Abnormality", "Gene Mutation", "Copy Number Polymorphism", "Gene Mutation",
                "Exon Deletion", "Gene Mutation", "Gene Amplification", "Gene Mutation", "Wild Type",
            ),
            "test_result_name": pick(
                "l_partkey % 7", "Positive", "Positive", "Equivocal", "Negative", "Negative", "Low", "Intermediate"
            ),
            "molecular_variant": pick(
                "l_partkey % 20", "p.G12D", "c.35G>A", "p.G12V", "G12R", "p.G12A", "c.34G>T", "p.Q61H", "183A>C",
                "Q61K", "p.Q16R", "Q61L", "p.G13D", "T58I", "G12L", "A146T", "Exon 2", "exon2 G12", "p.G13C",
                None, None,
            ),
            "variant_classification_name": pick(
                "l_suppkey % 7", None, None, "Pathogenic", "Likely benign", "Uncertain significance",
                "Likely pathogenic", None,
            ),
            "report_date": DAY,
        },
    ),
}


_SCHEMAS: dict[str, StructType] = {}


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file; its footer is asked for the schema once per process."""
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One clinical table over the parquet files in ``sf_dir``."""
    spec = VIEWS[name]
    frames = [_read(spark, f"{sf_dir}/{t}.parquet") for t in spec.tables]
    df = frames[0]
    if spec.tables == ORDER_LINES:
        df = df.join(frames[1], F.col("l_orderkey") == F.col("o_orderkey"))
    if spec.where:
        df = df.where(spec.where)
    return df.selectExpr(
        *[f"{spark_text(e)} AS {column}" for column, e in spec.columns.items()]
    )


def delivered(df: DataFrame) -> DataFrame:
    """A view as a release may deliver it: days as timestamps, every tenth patient's rows
    once more without the patient, columns in another order and one too many."""
    columns = [F.col(c).cast("timestamp").alias(c) if kind == "date" else F.col(c) for c, kind in reversed(df.dtypes)]
    raw = df.select(*columns, F.lit("x").alias("load_note"))
    if "patient_id" not in df.columns:
        return raw
    lost = raw.where(F.col("patient_id") % 10 == 0).withColumn("patient_id", F.lit(None).cast(raw.schema["patient_id"].dataType))
    return raw.unionByName(lost)


def view_sql(name: str) -> str:
    """The same table as a SELECT over the driver's registered tables."""
    spec = VIEWS[name]
    columns = ", ".join(f"{duckdb_text(e)} AS {column}" for column, e in spec.columns.items())
    source = spec.tables[0]
    if spec.tables == ORDER_LINES:
        source += " JOIN orders ON l_orderkey = o_orderkey"
    where = f" WHERE {spec.where}" if spec.where else ""
    return f"SELECT {columns} FROM {source}{where}"

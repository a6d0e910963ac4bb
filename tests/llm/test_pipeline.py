"""Registered queries against their SQL, and the stages against brute force."""

from __future__ import annotations

from collections import Counter
from functools import partial

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oncolens.llm import best_fit, rule_quality, simhash
from oncolens.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import DOCUMENTS
from tests.llm.test_texts import plain_removal

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(want)


def test_mixing_sql_has_no_highest_count(spark, tmp_path):
    big = spark.range(20, numPartitions=4).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 5_000_000).alias("text"), F.lit("big").alias("source")
    )
    small = spark.createDataFrame([(100, "", "small")], "doc_id long, text string, source string")
    big.unionByName(small).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op5_poisson_mixing"](spark, str(tmp_path)).select("doc_id", "source", "copies", "copy", "shuffle_key")
    rows = Counter(map(tuple, got.collect()))
    assert sum(n for r, n in rows.items() if r[1] == "small") > 201
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, source, copies, copy, shuffle_key FROM ({ORACLE_SQL['op5_poisson_mixing']})").fetchall()
    assert rows == Counter(want)


def test_every_query_has_its_columns(spark):
    wanted = {
        "op1_simhash_near_dedup": "doc_id fingerprint component_id",
        "op2_lz_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op3_quality_rules": "doc_id held_out score predicted",
        "op4_cross_parsing_language": "doc_id held_out lang_pred score",
        "op6_block_anchor_dedup": "doc_id n_words n_removed kept_sha256",
        "op9_label_shards": "doc_id size text_crc32 law shard slot grown_shard",
    }
    rows = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, columns in wanted.items():
        df = QUERIES[name](spark, SF)
        assert df.columns == columns.split() and df.count() == rows


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    model = rule_quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in rule_quality.scored(docs.select("doc_id", "text"), model).collect()}
    good = stages["quality"](spark, docs, SF)
    assert sorted(r.doc_id for r in good.collect()) == sorted(k for k, s in scores.items() if s >= 0.3)

    single = stages["near_dedup"](spark, good, SF)
    kept = simhash.near_duplicates(good).where("id = component")
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.id for r in kept.collect())

    rows = sorted(map(tuple, single.select("doc_id", "text", "lang", "source", "n_chars").collect()))
    want = []
    for row, (words, gone) in zip(rows, plain_removal([r[:2] for r in rows], 13), strict=True):
        left = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        if not any(gone):
            want.append(row)
        elif left:
            want.append((row[0], left, *row[2:4], len(left)))
    cut = stages["substring_dedup"](spark, single, SF)
    assert sorted(map(tuple, cut.collect())) == want

    mixed = stages["mixing"](spark, cut, SF)
    assert mixed.columns == list(corpus_pipeline.COLUMNS)
    assert set(map(tuple, mixed.collect())) <= set(want)
    packed = stages["packing"](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed.collect())


def test_packing_keeps_its_tokens(spark):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(["one two three", "", None, "é 日本 " * 900, "one two three"])]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    packed = dict(corpus_pipeline.STAGES)["packing"](spark, docs, SF)
    encoder = best_fit.Encoder.of(public_tokenizers.path("byte_bpe_50k.json"))
    found = sorted(packed.collect(), key=lambda r: r.start)
    for k, text, *_ in rows:
        assert b"".join(r.ids for r in found if r.doc_id == k) == encoder.encode(text or "") + b"\2\0\0\0"
    assert len(found) > len(rows)
    packed = QUERIES["op7_best_fit_packing"](spark, SF)
    assert packed.columns == "doc_id piece start length ids_crc32 sequence_id offset".split()
    assert "crc32(ids" in packed._jdf.queryExecution().optimizedPlan().toString()
    plain = best_fit.pack(spark.read.parquet(f"{SF}/documents.parquet"))
    assert Counter(map(tuple, packed.drop("sequence_id", "offset").collect())) == Counter(
        map(tuple, plain.drop("sequence_id", "offset").collect())
    )


def test_quality_stage_keeps_documents_without_a_rule(spark, tmp_path):
    docs = spark.createDataFrame([(k, "the same clean text", "en", "s", 19) for k in range(15)], DOCUMENTS)
    labels = spark.createDataFrame([(k, int(k < 3)) for k in range(15)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert dict(corpus_pipeline.STAGES)["quality"](spark, docs, str(tmp_path)).count() == 15


def test_stages_on_odd_tables(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0)], DOCUMENTS)
    odd = odd.withColumn("fp", F.lit(1)).withColumn("mix_u", F.lit(2)).withColumn("chunk", F.lit("x")).withColumn("ID", F.lit(0))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        partial(stage, spark)(odd, SF).collect()

"""The registered queries of this subpackage, and DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from oncolens.llm import (
    best_fit,
    block_anchors,
    cross_parsing,
    filter_cascade,
    label_shards,
    line_ranges,
    lz_fingerprint,
    pca_tiles,
    periodic_runs,
    poisson_mixing,
    rule_quality,
    simhash,
    token_alignment,
)
from oncolens.llm.common import held_out, pick, ship


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, radius=4)
    code = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), code.alias("fingerprint"), F.col("component").alias("component_id"))


def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.edit_likeness(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = rule_quality.learn(docs, read(spark, sf_dir, "labels"))
    found = rule_quality.scored(pick(docs, doc_id="doc_id", text="text"), model)
    return found.select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op4_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = cross_parsing.predicted(docs, cross_parsing.learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), doc_id="doc_id", source="source", text="text")
    return poisson_mixing.replicate(docs).select("doc_id", "source", "copies", "copy", "shuffle_key")


OP5_SQL = """
WITH sizes AS (
    SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY source
), rates AS (
    SELECT source, pow(size, 0.7) * ((SELECT sum(size) FROM sizes) / (SELECT sum(pow(size, 0.7)) FROM sizes)) / size AS rate
    FROM sizes
), cdf AS (
    SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
    FROM rates, (SELECT unnest(generate_series(0, (max(rate) + 12 * sqrt(max(rate)) + 30)::BIGINT)) AS k FROM rates) AS s
), drawn AS (
    SELECT doc_id, source,
        ('0x' || substr(md5('7/' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / pow(2, 52) AS u
    FROM documents
), counted AS (
    SELECT doc_id, d.source,
        (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.below <= d.u) AS copies
    FROM drawn d
)
SELECT doc_id, source, copies, copy,
    ('0x' || substr(md5('8/' || coalesce(doc_id::VARCHAR, '') || '/' || copy::VARCHAR), 1, 13))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(copies)) AS copy FROM counted)
"""


def op6_block_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = block_anchors.remove_repeats(read(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, place, array_to_string(list_slice(words, place, place + 12), ' ') AS seen
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS place FROM split)
), firsts AS (
    SELECT seen, min(doc_id) AS first FROM windows GROUP BY seen HAVING count(DISTINCT doc_id) > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(place, place + 13)) AS place
    FROM windows JOIN firsts USING (seen) WHERE first < doc_id
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
    FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split)
    ANTI JOIN gone USING (doc_id, place)
    GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, len(words) - coalesce(n, 0) AS n_removed,
    sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = best_fit.pack(read(spark, sf_dir, "documents"), capacity=1024, end_id=2, with_ids=True)
    return found.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


ALLOWED = ("com/", "www.example.com/en/")
BLOCKED = ("example.com/en/", "net/es/", "net/fr/")


def op8_filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_cascade.judge(read(spark, sf_dir, "pages"), ALLOWED, BLOCKED)


OP8_SQL = f"""
WITH rules AS (
    SELECT *, split_part(rule, '/', 1) AS host, substr(rule, strpos(rule, '/')) AS path
    FROM (VALUES {", ".join(f"('{r}', '{v}')" for rs, v in ((ALLOWED, "allow"), (BLOCKED, "block")) for r in rs)}) AS v(rule, verdict)
), parts AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM (
    SELECT *, (
        SELECT arg_max(r, length(r.rule)) FROM rules r
        WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    ) AS best
    FROM parts p
)
"""


def op9_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = label_shards.shards(read(spark, sf_dir, "documents"), n_shards=40)
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pca_tiles.near_duplicates(read(spark, sf_dir, "embeddings"), least=0.9)


OP10_SQL = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), sound AS (
    SELECT * FROM vectors
    WHERE len([x for x in v if x IS NULL OR NOT isfinite(x)]) = 0 AND list_sum([x * x for x in v]) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
    SELECT a AS node, a AS root FROM links
    UNION
    SELECT links.b, reach.root FROM reach JOIN links ON reach.node = links.a
), counts AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
), roots AS (
    SELECT node AS vec_id, min(root) AS root FROM reach GROUP BY node
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(root, vec_id)) AS component_id,
    vec_id = least(vec_id, coalesce(root, vec_id)) AS kept
FROM vectors LEFT JOIN counts USING (vec_id) LEFT JOIN roots USING (vec_id)
"""


def op11_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_ranges.drop_repeated_lines(read(spark, sf_dir, "documents"), shortest=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP11_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT doc_id, line, place, translate(
        trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), firsts AS (
    SELECT key, min(doc_id) AS first FROM keyed
    WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
    SELECT doc_id, line, place, coalesce(doc_id <> first, false) AS dropped FROM keyed LEFT JOIN firsts USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(read(spark, sf_dir, "documents"))
    groups_sha256 = F.when(F.col("n_a") > 0, F.sha2(F.col("groups"), 256)).otherwise("")
    return found.withColumn("groups_sha256", groups_sha256).drop("groups")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    repeated = periodic_runs.with_repetition(F.col("text"), F.floor(drawn / 10))
    docs = docs.withColumn("text", F.when(drawn % 10 == 0, repeated).otherwise(F.col("text")))
    found = periodic_runs.periodic_runs(docs, exponent=4, shortest=6)
    longest = F.array_min(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    found = found.withColumn("longest", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.shorter")).alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("(1000 * -longest.shorter) div longest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_lz_fingerprint": op2_lz_fingerprint,
    "op3_quality_rules": op3_quality_rules,
    "op4_cross_parsing_language": op4_cross_parsing_language,
    "op5_poisson_mixing": op5_poisson_mixing,
    "op6_block_anchor_dedup": op6_block_anchor_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_filter_cascade": op8_filter_cascade,
    "op9_label_shards": op9_label_shards,
    "op10_pca_tiles": op10_pca_tiles,
    "op11_line_ranges": op11_line_ranges,
    "op12_token_alignment": op12_token_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op5_poisson_mixing": OP5_SQL,
    "op6_block_anchor_dedup": OP6_SQL,
    "op8_filter_cascade": OP8_SQL,
    "op10_pca_tiles": OP10_SQL,
    "op11_line_ranges": OP11_SQL,
}

"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import cotraining, decontaminate, language, language_model, licences, line_dedup, minhash, packing, quality_rules, suffix_dedup
from weftline.llm.common import documents


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, removed lines, and length and hash of the text that is left."""
    done = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", F.col("_removed").alias("n_removed"), F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(documents(spark, sf_dir)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir))


def op3_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_masked_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir)).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_cotraining_quality": op3_cotraining_quality,
    "op4_language_id": op4_language_id,
    "op5_masked_lm_score": op5_masked_lm_score,
    "op6_line_dedup": op6_line_dedup,
    "op7_packing": op7_packing,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_licence_scan": op10_licence_scan,
}
#: DuckDB SQL; the other operators fit models, search by edit distance or cut bytes, and are tested against plain versions.
ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ab AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS doc_id, b AS m FROM ab UNION SELECT r.doc_id, ab.b FROM r JOIN ab ON ab.a = r.m),
c AS (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, least(w.doc_id, coalesce(m, w.doc_id)) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op6_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line FROM d),
k AS (SELECT *, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER w AS r, count(*) OVER (PARTITION BY doc_id) AS c
      FROM (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM l) WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT doc_id, r, c, [t, lead(t, 1) OVER w, lead(t, 2) OVER w] AS t, [words, lead(words, 1) OVER w, lead(words, 2) OVER w] AS words FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, r, n, t[1:n] AS run FROM a, (VALUES (1), (2), (3)) v(n) WHERE r <= c - n + 1 AND (n = least(3, c) OR list_sum(words[1:n]) >= 50)),
later AS (SELECT doc_id, r, n FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, r) AS seen FROM runs) WHERE seen > 1),
gone AS (SELECT DISTINCT k.doc_id, k.i FROM k JOIN (SELECT doc_id, unnest(range(r, r + n)) AS r FROM later) USING (doc_id, r)),
kept AS (SELECT doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text FROM l LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_removed, 0) AS n_removed, length(kept.text) AS n_chars_left, sha256(kept.text) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)""",
}

"""The registered queries of this subpackage, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, iblt, jaccard_join, language_id, line_dedup, mixing, packing, periodic_runs, quality, substring_dedup, toxicity, warc
from ._shared import WHITE, id_bucket


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False))
    model = language_id.train(docs, ~held_out)
    found = language_id.identify(docs.select("doc_id", "text"), model, carry=["doc_id"]).select("carry.doc_id", "lang_pred", "score", "shares")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.to_json("shares").alias("shares"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(_documents(spark, sf_dir))).withColumnRenamed("id", "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False))
    languages = language_id.train(docs, ~held_out)
    model = toxicity.train(docs, labels, ~held_out, languages)
    scored = toxicity.score(docs, model, languages).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_groups(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.page_records(warc.read_archives(archives, block=False))


def op8_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_documents(spark, sf_dir), with_text=False).withColumnRenamed("id", "doc_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.passage_parts(_documents(spark, sf_dir))
    return found.select(F.when(F.col("doc") != substring_dedup.NO_ID, F.col("doc")).alias("doc_id"), "start", "end", "words", F.when(F.col("first_doc") != substring_dedup.NO_ID, F.col("first_doc")).alias("first_doc_id"), "is_first")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held_out = F.coalesce(id_bucket("doc_id", 3) == 1, F.lit(False))
    scored = quality.score(docs, quality.train(docs, labels, ~held_out)).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(_documents(spark, sf_dir), change=periodic_runs.repeated).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_iblt_fingerprints": op8_iblt_fingerprints,
    "op9_line_dedup": op9_line_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_quality": op12_quality,
    "op13_periodic_runs": op13_periodic_runs,
}

_NORM = "translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE = {
    "op1_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_NORM} AS norm, length(coalesce(text, '')) AS n_cp FROM documents),
        k AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS rn, count(*) OVER (PARTITION BY norm) AS group_size FROM n),
        f AS (SELECT norm, doc_id AS keep_id FROM k WHERE rn = 1)
        SELECT k.doc_id, f.keep_id, k.group_size, k.rn = 1 AS kept, sha256(k.norm) AS text_sha256
        FROM k JOIN f ON k.norm = f.norm""",
    "op6_mixing": f"""
        WITH d AS (SELECT doc_id, source, {_WORDS} AS size, coalesce(text, '') AS t FROM documents),
        q AS (SELECT doc_id, source, size, CASE WHEN t = '' THEN 1.0::DOUBLE ELSE greatest(0.05::DOUBLE, length(translate(t, '{mixing.NOISE}', ''))::DOUBLE / length(t)) END AS w,
              (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0::DOUBLE AS u FROM d),
        k AS (SELECT doc_id, source, size, -ln(u) / w AS key FROM q),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM k GROUP BY source),
        c AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS share, 3 * source_size AS cap FROM s),
        l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / share, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(share) OVER (ORDER BY cap::DOUBLE / share, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM c),
        g AS (SELECT *, max(CASE WHEN cap > level * share THEN level END) OVER () AS top FROM l),
        t AS (SELECT source, source_size, CASE WHEN cap <= level * share THEN cap::DOUBLE ELSE top * share END AS target FROM g),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
        p AS (SELECT k.*, e.source_size, e.target, e.epochs, floor(e.target + 0.5)::BIGINT - e.epochs * e.source_size AS rest,
              coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
              FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, source, size, source_size, target, epochs, (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM p""",
    "op9_line_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        l AS (SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT k.doc_id, k.i, k.line, g.key IS NOT NULL AND k.doc_id <> g.top AS gone FROM k LEFT JOIN g ON k.key = g.key)
        SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::BIGINT)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}

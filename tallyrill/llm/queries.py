"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, licenses, lines, packing, quality, sharding, simhash, suffixes, tokens, winnowing
from ._shared import documents


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_size(documents(spark, sf_dir), shards=40, overhead=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(documents(spark, sf_dir), length=100)


def op4_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint_edits(documents(spark, sf_dir), k=32, window=64)


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(documents(spark, sf_dir), k=8, similarity=0.8)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), width=4, radius=4)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20, width=1)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op1_pack, op2_shard, op3_suffixes, op4_winnow, op5_lines, op6_bpe, op7_simhash, op8_ann, op9_licenses, op10_quality)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    """DuckDB's form of licenses.canonical."""
    sql = f"lower(coalesce({text}, ''))"
    for pattern, to in licenses.PATTERNS:
        sql = f"regexp_replace({sql}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    sql = f"('  ' || trim({sql}, ' ') || '  ')"
    for a, b in licenses.EQUIVALENT:
        sql = f"replace({sql}, {_quoted(' ' + a.replace(' ', '  ') + ' ')}, {_quoted(' ' + b.replace(' ', '  ') + ' ')})"
    return f"trim(replace({sql}, '  ', ' '), ' ')"


_KNOWN_SQL = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, texts in licenses.KNOWN.items() for text in texts)

ORACLE_SQL = {
    "op9_licenses": f"""
WITH raw(license_id, text) AS (VALUES {_KNOWN_SQL}),
known AS (SELECT sha256({_canonical_sql("text")}) AS digest, min(license_id) AS license_id FROM raw GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
hits AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses FROM lines JOIN known ON sha256({_canonical_sql("line")}) = digest GROUP BY doc_id),
found AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents)
SELECT d.doc_id, d.digest, k.license_id, coalesce(h.line_licenses, '') AS line_licenses
FROM found d LEFT JOIN known k ON d.digest = k.digest LEFT JOIN hits h ON d.doc_id IS NOT DISTINCT FROM h.doc_id
""",
}

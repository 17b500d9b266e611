"""Queries p2: references to blocks that never came, are deleted or come later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.operators.orphans import orphans
from quireloom.session import table

REFERRING = {"citation_requests": "request_id", "claims": "claim_id", "drivers": "driver_id"}


def references(spark: SparkSession, d: str) -> DataFrame:
    """(record_table, record_id, document_id, block_id, recorded_at): one row per distinct reference."""
    one = lambda t, k: table(spark, d, t).select(F.lit(t).alias("record_table"), F.col(k).alias("record_id"), "document_id", F.explode("evidence_block_ids").alias("block_id"), "recorded_at")
    return reduce(DataFrame.unionByName, [one(t, k) for t, k in REFERRING.items()]).where(F.col("block_id").isNotNull()).distinct()


def p2_orphans(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "blocks").select("document_id", "block_id", "ingested_at", "deleted_at")
    return orphans(references(spark, d), blocks, "document_id", "block_id", "recorded_at", "ingested_at", "deleted_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """See TESTDATA.md."""
    return p2_orphans(spark, d).select("record_table", "record_id", "block_id", F.date_format("recorded_at", "yyyy-MM").alias("ref_period")).distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and month: how many lie beyond every run of their document's keys, and how many in runs that didn't live then."""
    o = p2_orphans(spark, d).withColumn("ref_period", F.date_format("recorded_at", "yyyy-MM"))
    beyond = F.sum(F.when(F.col("in_run"), 0).otherwise(1)).cast("bigint")
    dead = F.sum(F.when(F.col("in_run") & ~F.col("in_life"), 1).otherwise(0)).cast("bigint")
    return o.groupBy("record_table", "ref_period").agg(F.count("*").alias("n_orphans"), beyond.alias("n_beyond_runs"), dead.alias("n_late_or_deleted"))


def queries() -> dict:
    return {"p2_found": p2_found, "p2_report": p2_report}


_REFS = " UNION ".join(f"SELECT '{t}' AS record_table, {k} AS record_id, document_id, unnest(evidence_block_ids) AS block_id, recorded_at FROM {t}" for t, k in REFERRING.items())
_ORPHANS = f"""FROM (SELECT DISTINCT * FROM ({_REFS}) WHERE block_id IS NOT NULL) r WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.document_id = r.document_id AND b.block_id = r.block_id
 AND b.ingested_at <= r.recorded_at AND (b.deleted_at IS NULL OR r.recorded_at < b.deleted_at))"""
_NUMBER = "TRY_CAST(nullif(regexp_extract({0}, '^p[0-9]+-b([0-9]{{1,15}})-[0-9a-f]+$', 1), '') AS BIGINT)"


def oracle_sql() -> dict:
    return {
        "p2_found": f"SELECT DISTINCT record_table, record_id, block_id, strftime(recorded_at, '%Y-%m') AS ref_period {_ORPHANS}",
        "p2_report": f"""SELECT record_table, ref_period, count(*) AS n_orphans, CAST(sum(CASE WHEN inside THEN 0 ELSE 1 END) AS BIGINT) AS n_beyond_runs, CAST(sum(CASE WHEN inside AND NOT living THEN 1 ELSE 0 END) AS BIGINT) AS n_late_or_deleted FROM (
SELECT record_table, strftime(recorded_at, '%Y-%m') AS ref_period, EXISTS (SELECT 1 FROM blocks c WHERE c.document_id = r.document_id AND {_NUMBER.format('c.block_id')} = {_NUMBER.format('r.block_id')}) AS inside,
EXISTS (SELECT 1 FROM blocks c WHERE c.document_id = r.document_id AND {_NUMBER.format('c.block_id')} = {_NUMBER.format('r.block_id')} AND c.ingested_at <= r.recorded_at AND (c.deleted_at IS NULL OR r.recorded_at < c.deleted_at)) AS living {_ORPHANS}) GROUP BY 1, 2""",
    }

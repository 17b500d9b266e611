"""Structured Streaming over landing reports: a growing catalog and late requests.

A decision may change when another report lands, so decisions are never
appended: the catalog stream keeps one row per file name, the first that came
(all it holds derives from the name), and resolve is run again per batch over
the whole catalog table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quireloom.functions import text as X
from quireloom.operators.retrieval import catalog_of


def landing_blocks(spark: SparkSession, folder: str, schema: str, late: str = "2 days") -> DataFrame:
    """A stream of layout rows by arrival; rows later than the watermark are dropped from windows."""
    return spark.readStream.schema(schema).parquet(folder).withWatermark("ingested_at", late)


def arrivals(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """(window, source, n_blocks): blocks that came per window and source; repeated rows of a block count once."""
    s = stream.dropDuplicatesWithinWatermark(["document_id", "block_id"])
    key = F.lower(F.regexp_replace(X.parse_filename(F.col("source_filename"))["broker"], r"[^\p{L}\p{N}]", ""))
    return s.groupBy(F.window("ingested_at", width), key.alias("source")).agg(F.count("*").alias("n_blocks"))


def keep_catalog(stream: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Adds the files of each batch that the catalog at path hasn't yet; then gets the whole catalog.

    A batch has a folder of its own, which it writes anew if it is repeated, so
    a restart adds nothing twice.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        new = catalog_of(df, "source_filename")
        schema = T.StructType([*new.schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            old = spark.read.schema(schema).parquet(path).where((F.col("run") != run) | (F.col("batch") != n))
            new = new.join(old.select("filename"), "filename", "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/run={run}/batch={n}")
        if then:
            then(spark.read.schema(schema).parquet(path).drop("run", "batch"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

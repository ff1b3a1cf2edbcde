"""Streaming jobs over the test tables, run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeseam.plans.lifecycle import SCAN, STORED
from codeseam.session import shared_folder, table
from codeseam.streaming import jobs


def _folder(spark: SparkSession) -> str:
    """A new folder in the space that all executors share."""
    return f"{shared_folder(spark, 'streams')}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table as a stream of its files; it may be a file or a folder of files."""
    path = f"{sf}/{name}.parquet"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    reader = spark.readStream.schema(table(spark, sf, name).schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf) if single else reader.parquet(path)


def _finished(result: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Run a streaming aggregation over all that is there and read what it wrote: the last version of each key."""
    spark, folder = result.sparkSession, _folder(result.sparkSession)

    def write(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    rest = [c for c in result.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def stream_usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    e = _stream(spark, sf, "events").select(
        F.col("event_type").alias("tool"), F.col("user_id").alias("repo_id"), F.col("event_id").alias("at"), F.octet_length("props").cast("bigint").alias("served"), F.lit(1).cast("bigint").alias("saved")
    )
    return _finished(jobs.usage_rollup(e), "update", ["tool", "repo_id"])


def stream_file_refresh(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark)

    def process(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    # each of the folder's files may be a batch of its own, so a batch is only set against the paths that it brings
    jobs.refresh(_stream(spark, sf, "scanned_files"), lambda: table(spark, sf, "files"), process, f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("index_id", "path", "change")


QUERIES = {"stream_usage_rollup": stream_usage_rollup, "stream_file_refresh": stream_file_refresh}
ORACLES = {
    "stream_file_refresh": f"SELECT n.index_id, n.path, CASE WHEN o.path IS NULL THEN 'new' ELSE 'changed' END AS change FROM {SCAN} n LEFT JOIN (SELECT * FROM {STORED} WHERE NOT deleted) o "
    "ON n.index_id = o.index_id AND n.path = o.path WHERE o.path IS NULL OR n.size IS DISTINCT FROM o.size OR n.mtime_ms IS DISTINCT FROM o.mtime_ms",
    "stream_usage_rollup": "SELECT event_type AS tool, user_id AS repo_id, count(*) AS calls, max(event_id) AS last_called_at, sum(octet_length(encode(props)))::BIGINT AS bytes_served, count(*) AS bytes_saved FROM events GROUP BY ALL",
}

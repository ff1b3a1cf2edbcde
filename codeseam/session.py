"""Session set-up and the few decisions that need a look at the cluster."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if it is measured to have at most so many rows, and so many bytes of text and arrays.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 * 1024 * 1024


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codeseam")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder that all executors share.

    The folder is ``spark.checkpoint.dir`` of the session. Where that is unset, as in tests on one machine, a
    temporary folder is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that all executors see: below ``spark.checkpoint.dir``, or a temporary one where that is unset and Spark
    runs on one machine. On a cluster without it there is none, which is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared if name == "checkpoints" else f"{shared.rstrip('/')}/{name}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster has to name a shared folder in spark.checkpoint.dir")
    return os.path.join(tempfile.gettempdir(), f"codeseam-{name}")


def _weight(df: DataFrame):
    """The bytes of a row that can be of any size: texts and arrays; other columns have a few bytes each."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    sizes += [F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return sum(sizes, F.lit(16 * len(df.columns))).cast("bigint")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True if a side has at most ``rows`` rows and ``size`` bytes. The measure reads at most ``rows + 1`` rows and sends two
    numbers to the driver."""
    n, total = df.limit(rows + 1).select(_weight(df).alias("w")).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).head()
    return n <= rows and total <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a side measured to be small; else the side as it is, for a shuffle join."""
    return F.broadcast(df) if is_small(df, rows) else df

"""Tables on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: With this setting a query's shuffle files go when it has ended, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names as ``spark.checkpoint.dir``.

    Without one, a session of a single machine gets a temporary folder; on a
    cluster that would be a different one on each machine, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="docweave-")
    return _local[app]


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: later steps neither compute nor plan it anew, and lost executors cost nothing.

    What the writing has shuffled is not needed again and is dropped at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweave/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)

"""Helpers that several operators share: the shared folder and written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallymark.session import ship

#: MB of rows that go to a Python worker at once, unless one row is longer.
BATCH_MB = 16


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this package on its executors and batches that leave room for long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # the default: the user has chosen no size
        spark.conf.set(name, f"{BATCH_MB}m")
    return ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset (tests on one machine), a temporary folder is made and remembered in the session.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='tallymark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, what: str, codec: str | None = None) -> DataFrame:
    """df as Parquet in the shared folder, read again: cuts the lineage and survives lost executors."""
    at = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a frame that written() returned, once nothing reads them any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {p.rpartition("/")[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

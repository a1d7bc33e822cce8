"""What a session needs before Python code of this package runs on its executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_tallymark_shipped", False):
        return spark
    top = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="tallymark-"), "tallymark.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(to)
    context._tallymark_shipped = True
    return spark


def staged(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder: what reads it plans over its rows, not over how they were read."""
    path = scratch(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the folder that driver and executors share, for files named ``name``; on one machine, without such a folder, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='tallymark-')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}-{name}"

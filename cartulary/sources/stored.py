"""Results stored in the folder that driver and executors share: lineage ends there."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Only where that is unset on one machine, as in tests, a folder of our own is
    set, which goes when Python ends.  A cluster has to name one.
    """
    if not (d := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="cartulary-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        d = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted when the driver's JVM ends."""
    at = f"{shared_dir(spark)}/cartulary-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back."""
    at = fresh_path(df.sparkSession, name)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.saved_at = at
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of what saved() gave, once all that reads them is stored itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

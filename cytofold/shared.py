"""Tables kept in the folder that the driver and all executors see: they cut a plan's lineage, and no lost executor takes them along."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or for local sessions without it a temporary one of this process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    made = getattr(shared_dir, "made", None)
    if not made:
        made = shared_dir.made = "file://" + tempfile.mkdtemp(prefix="cytofold-")
    return made


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_path = path
    return back


def dropped(*tables: DataFrame | None) -> None:
    """Deletes the files of stored() tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        if df is not None and (path := getattr(df, "_stored_path", None)):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)

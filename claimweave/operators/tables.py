"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a local master, as in tests, gets a folder of this machine's; a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="claimweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A path of the shared folder that nothing has written to."""
    return f"{shared_folder(spark)}/claimweave-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and a lost executor loses nothing of it.

    The tables stay as long as the session's results may read them; ``clear`` removes them.
    """
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Removes all that was written to the shared folder under fresh paths, once no result needs it; returns how many."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in (fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "claimweave-*")) or [])]
    return sum(bool(fs.delete(p, True)) for p in found)

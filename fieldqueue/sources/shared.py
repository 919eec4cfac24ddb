"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset, and Spark is local, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir")


def kept(df: DataFrame) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them again: cuts the lineage, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/fieldqueue-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the table that kept() wrote and df reads; for callers who know that nothing else reads it any more. Other tables are left alone."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    context = df.sparkSession.sparkContext
    for folder in folders:
        if folder.rsplit("/", 1)[-1].startswith("fieldqueue-"):
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

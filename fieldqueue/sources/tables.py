"""Reading of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldqueue.sources.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows, or an error that names the columns they lack."""
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"missing columns {missing}")
    return rows


def framed(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, cast to its types; null where the rows lack one."""
    types = [part.strip().split(" ", 1) for part in schema.split(",")]
    return rows.select(*[(F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name) for name, kind in types])


def written_as(rows: DataFrame, kind: str, **options: str) -> str:
    """Writes the rows as json or csv files in the shared folder; their path."""
    path = f"{shared_folder(rows.sparkSession)}/fieldqueue-{uuid.uuid4().hex}"
    rows.write.format(kind).options(**options).save(path)
    return path


def first_of_lines(path: str, spark: SparkSession, schema: str, before: str) -> DataFrame:
    """JSON lines (`line` numbers them) as rows: of an id the first line, created before a day."""
    rows = spark.read.schema(schema).json(path)
    first = rows.groupBy("id").agg(F.min_by(F.struct(*rows.columns), "line").alias("r")).select("r.*")
    return first.where(F.col("created_at") < F.lit(before).cast("timestamp"))

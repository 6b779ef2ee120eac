"""Schemas of the tables, validation and a helper that cuts lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTOR_TYPES = ("embedding", "logit")
VECTORS = "vec_id long, file_path string, vector array<float>, vector_type string, processed_at timestamp, file_size long, thumbnail_path string, pca_x float, pca_y float"
FAILURES = "file_path string, error string, tried_at timestamp"
THUMBNAILS = "file_path string, key string, content binary"
ASSIGNMENTS = "vec_id long, cluster_id int, is_seed boolean, similarity double"
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


class VectorError(ValueError):
    """Vectors that can't be compared with each other."""


def check_vectors(df: DataFrame, vector: str = "vector", key: str | None = None) -> tuple[int, int]:
    """How many there are, and their common dimension, 0 for none. Raises for nulls, NaN, mixed dimensions, or repeated keys."""
    bad = F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    row = df.agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b"), F.coalesce(F.count_if(bad), F.lit(0)).alias("bad")).first()
    if row["bad"]:
        raise VectorError(f"{row['bad']} vectors are null or hold nulls or NaN")
    if row["a"] != row["b"]:
        raise VectorError(f"vectors of {row['a']} to {row['b']} dimensions")
    if key and df.groupBy(key).count().filter("count > 1").head(1):
        raise VectorError(f"{key} repeats")
    return row["n"], row["a"] or 0


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a session in local mode, whose driver is its one executor, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return (found or LOCAL_CHECKPOINTS).rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder. The application's part of it is deleted when the driver's JVM ends."""
    root = f"{shared_dir(spark)}/embedspace-{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{root}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: survives lost executors and cuts lineage."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

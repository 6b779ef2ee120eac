"""Folders of files as tables, and decoded images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedspace.functions.paths import is_image


def one_form(path: Column) -> Column:
    """Local paths with one slash after the scheme, as readers differ in that."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def list_files(spark: SparkSession, folder: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """(file_path, file_size, modified) of a folder. Content isn't read. Names that start with _ or . are skipped; a folder that can't be read is empty."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    try:
        found = reader.load(folder)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "file_path string, file_size long, modified timestamp")
    return found.select(one_form(F.col("path")).alias("file_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder).filter(is_image(F.col("file_path")))


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ordinal, file_path) of a list given in the program."""
    return spark.createDataFrame(list(enumerate(paths)), "ordinal long, file_path string")


def decode_images(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """(file_path, height, width, channels, bgr) of the images that can be decoded, by Spark's own reader; others have height -1."""
    found = spark.read.format("image").option("recursiveFileLookup", "true").load(folder)
    return found.select(one_form(F.col("image.origin")), "image.height", "image.width", "image.nChannels", "image.data").toDF("file_path", "height", "width", "channels", "bgr")


def unseen(files: DataFrame, store: DataFrame, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Files whose key the store lacks."""
    return files.join(store.select(*keys).distinct(), list(keys), "left_anti")


def seen(files: DataFrame, store: DataFrame, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    return files.join(store.select(*keys).distinct(), list(keys), "left_semi")

"""Incremental ingest of image folders by Structured Streaming, and progress."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from embedspace.functions.paths import is_image, percent, thumbnail_path
from embedspace.operators.images import Vectorizer, thumbnails, vectorize
from embedspace.operators.layout import CANVAS, positions
from embedspace.schema import written
from embedspace.sources.files import decode_images, list_images, one_form, unseen
from embedspace.sources.store import VectorStore


def scan_progress(steps: DataFrame, order: str = "seq", block: int = 10_000) -> DataFrame:
    """steps(seq, current_file, skipped, failed) to a row for each file that is neither: how many are processed by then, of how many.

    Skipped files count as processed without a row of their own; failed ones don't count. Running
    counts are taken in blocks of the order and carried over in two levels, blocks within groups of
    them and then groups, so that no task holds all rows, nor all blocks.
    """
    done = F.when(F.col("failed"), 0).otherwise(1)
    rows = steps.withColumn("__b", F.floor(F.col(order) / block))
    sums = rows.groupBy(F.col("__b").alias("__k")).agg(F.sum(done).alias("__s"), F.count("*").alias("__n")).withColumn("__g", F.floor(F.col("__k") / block))
    groups = sums.groupBy(F.col("__g").alias("__h")).agg(F.sum("__s").alias("__t"), F.sum("__n").alias("__m"))
    groups = groups.select("__h", (F.sum("__t").over(Window.orderBy("__h")) - F.col("__t")).alias("__base"), F.sum("__m").over(Window.partitionBy()).alias("total_count"))
    carried = sums.withColumn("__in", F.sum("__s").over(Window.partitionBy("__g").orderBy("__k")) - F.col("__s")).join(groups, F.col("__g") == F.col("__h"))
    carried = carried.select("__k", (F.col("__base") + F.col("__in")).alias("__before"), "total_count")
    rows = rows.withColumn("__run", F.sum(done).over(Window.partitionBy("__b").orderBy(order))).join(carried, F.col("__b") == F.col("__k"))
    count = (F.col("__before") + F.col("__run")).cast("long")
    out = rows.filter("not skipped and not failed").select(F.col(order).alias("seq"), "current_file", count.alias("processed_count"), F.col("total_count").cast("long").alias("total_count"))
    return out.withColumn("pct", percent(F.col("processed_count"), F.col("total_count")))


TRIED = "file_path string, error string"


def ingest_some(files: DataFrame, store: VectorStore, make: Callable[[], Vectorizer], vector_type: str, with_thumbnails: bool) -> tuple[DataFrame, int, int]:
    """files(file_path, file_size), a bounded number: decodes, vectorizes and saves them, makes thumbnails and notes failures.

    Returns (file_path, error) of them, and how many were saved and failed. vec_ids go on from the greatest one, in the
    order of the paths.
    """
    spark = store.spark
    paths = [r["file_path"] for r in files.select("file_path").collect()]
    if not paths:
        return spark.createDataFrame([], TRIED), 0, 0
    pictures = decode_images(spark, paths)
    found = written(vectorize(pictures, make))
    good = found.filter("error is null").join(files.select("file_path", "file_size"), "file_path")
    number = F.row_number().over(Window.orderBy("file_path")) - 1 + F.lit(store.next_id())
    place = thumbnail_path(store.thumbnail_folder(), F.col("file_path"), ".png") if with_thumbnails else F.lit(None).cast("string")
    if with_thumbnails:
        store.save_thumbnails(thumbnails(pictures, store.thumbnails()))
    store.save(good.select(
        number.cast("long").alias("vec_id"), "file_path", "vector", F.lit(vector_type).alias("vector_type"), F.current_timestamp().alias("processed_at"),
        "file_size", place.alias("thumbnail_path"), F.lit(None).cast("float").alias("pca_x"), F.lit(None).cast("float").alias("pca_y"),
    ))
    store.save_failures(found.filter("error is not null"))
    counts = found.agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad")).first()
    return found.select("file_path", "error"), counts["good"], counts["bad"]


def refresh_layout(store: VectorStore, width: float = CANVAS, height: float = CANVAS) -> bool:
    """Places all vectors anew and writes the places back if any row lacks one; says whether it did."""
    if store.complete():
        return False
    rows = written(store.read())
    placed = positions(rows, width=width, height=height).join(rows.select("vec_id", "file_path"), "vec_id")
    store.save_layout(placed.select("file_path", "x", "y"))
    return True


def ingest_folder(spark: SparkSession, folder: str, store: VectorStore, make: Callable[[], Vectorizer], vector_type: str = "embedding", files_per_batch: int = 10_000, with_thumbnails: bool = True, layout: bool = False) -> DataFrame:
    """One scan: images that the store lacks, and no others, are decoded and saved, a bounded number at a time. Returns (file_path, error) of those tried.

    Files that failed before are lacking too, so they are tried again. layout: places the vectors afterwards, if any lacks a place.
    """
    new = written(unseen(list_images(spark, folder), store.read()).select("file_path", "file_size"))
    count, tried = new.count(), []
    parts = max(1, -(-count // files_per_batch))
    for part in range(parts if count else 0):
        tried.append(ingest_some(new.filter(F.pmod(F.xxhash64("file_path"), F.lit(parts)) == part), store, make, vector_type, with_thumbnails)[0])
    if layout:
        refresh_layout(store)
    return functools.reduce(DataFrame.unionByName, tried) if tried else spark.createDataFrame([], TRIED)


def retry_failed(store: VectorStore, make: Callable[[], Vectorizer], vector_type: str = "embedding", with_thumbnails: bool = True) -> DataFrame:
    """Tries the files that failed last time again; a stream doesn't come back to them by itself. Returns (file_path, error)."""
    failed = written(store.failures().select("file_path", F.lit(None).cast("long").alias("file_size")))
    return ingest_some(failed, store, make, vector_type, with_thumbnails)[0]


def ingest_stream(spark: SparkSession, folder: str, store: VectorStore, make: Callable[[], Vectorizer], checkpoint: str, files_per_batch: int = 1000, vector_type: str = "embedding", on_progress: Callable[[int, int, int], None] | None = None, with_thumbnails: bool = True) -> StreamingQuery:
    """Works off what is in the folder and ends. files_per_batch bounds a batch; stop() keeps what was saved; a restart goes on where it was, and rows that are saved already are skipped.

    Files that fail are kept in store.failures(). on_progress(batch, saved, failed) is called after each batch.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    files = files.select(one_form(F.col("path")).alias("file_path"), F.col("length").alias("file_size")).filter(is_image(F.col("file_path")))

    def save(batch: DataFrame, number: int) -> None:
        new = written(unseen(batch, store.read()))
        _, good, bad = ingest_some(new, store, make, vector_type, with_thumbnails)
        if on_progress and good + bad:
            on_progress(number, good, bad)

    return files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ticks(spark: SparkSession, per_second: int = 1000) -> DataFrame:
    """A counter as a stream."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select("timestamp", "value")


def append_rows(spark: SparkSession, path: str, checkpoint: str, per_second: int = 1, seconds: float = 1.0) -> StreamingQuery:
    """A timer that appends a row (timestamp, value) to the Parquet table at path, until it is stopped."""
    return ticks(spark, per_second).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, in Java and Python regular expressions and as characters.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
#: Checkpoint folder of a session in local mode that names none (tests, notebooks).
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a session in local mode may leave it unset; a cluster without it is refused, as a
    machine's own temporary folder would lose rows.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = LOCAL_CHECKPOINTS
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here.

    Unlike a local checkpoint the files outlive executors, and unlike checkpoint() they are
    columnar and compressed, and their size lets Spark decide on broadcasts. The application's
    files are deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/embedspace-{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):  # results may still be read until the application ends
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Array of words; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_key(text: Column) -> Column:
    """With doc_id, this tells rows apart that share a doc_id but not the text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def ascii_lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Batches are bounded in bytes as well as in rows, by spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless the session says otherwise)."""
    return df.mapInArrow(function, schema)


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """docs with a new text, and n_chars to match where there is such a column."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def replace_texts(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """docs with the texts of changes(doc_id, th, new_text); rows without a change stay as they are."""
    changes = changes.select(F.col("doc_id").alias("__es_id"), F.col("th").alias("__es_th"), F.col("new_text").alias("__es_text"))
    on = docs["doc_id"].eqNullSafe(changes["__es_id"]) & (text_key(docs["text"]) == changes["__es_th"])
    out = docs.join(changes, on, "left")
    return with_text(out, F.coalesce("__es_text", "text")).select(*docs.columns)

"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch's distinct digests meet it by a
sort-merge anti-join; what is new is appended. All rows then get the row that stays from the index, by
a merge join of distinct digests. Appends leave further files in each bucket, which ends the order
within it; compact() writes the index anew, with one sorted file a bucket and as many buckets as its
rows ask for, and append() calls it when files have piled up. In the last join, of all rows with
their groups, large groups of copies are split by Spark's skew join, as both its sides are plain tables.

A whole table is dealt in batches of ascending doc_id, so that the smallest doc_id of a text is the
one that the index keeps, whatever the batches' bounds.

Edge cases: null text counts as empty. Rows that share text and doc_id are repeated rows: exactly
one of them is kept. Null doc_ids come after all others, in the last batch. A digest that an earlier
batch brought keeps that batch's row, so all rows of the new batch are dropped. Very long texts are
digested whole, in the row. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedspace.llm.common import WORD_BREAK, materialize

#: Rows of the index in a bucket, about: some 100 MB.
BUCKET_ROWS = 2_000_000
#: Files in a bucket, on average, beyond which an append compacts the index.
MOST_FILES = 8


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with every run of spaces made one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WORD_BREAK, " "), 256))


class DigestIndex:
    """Tables `name`_v1, `name`_v2 and so on (digest binary, keep_id long) in the session's catalog and warehouse, or in folders v1, v2 ... at `path`.

    The one with the greatest number counts; a table is only registered once its files are whole, so a compaction that
    fails changes nothing.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 8, path: str | None = None):
        self.spark, self.name, self.buckets, self.path = spark, name, buckets, path and path.rstrip("/")

    def version(self) -> int:
        """0 if there is no index yet."""
        names = [t.name for t in self.spark.catalog.listTables(pattern=f"{self.name.lower()}_v*")]
        return max((int(n.rpartition("_v")[2]) for n in names if n.rpartition("_v")[2].isdigit()), default=0)

    def table(self, version: int | None = None) -> str:
        return f"{self.name}_v{version or self.version()}"

    def exists(self) -> bool:
        return self.version() > 0

    def open(self) -> None:
        """Registers the index that an earlier session left at `path`, with the buckets that its file names show."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [str(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []
        whole = [int(n[1:]) for n in found if n[:1] == "v" and n[1:].isdigit() and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        if whole:
            v = max(whole)
            self.spark.sql(f"create table if not exists {self.table(v)} (digest binary, keep_id bigint) using parquet clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self.path}/v{v}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table())

    def fresh(self, found: DataFrame) -> DataFrame:
        """Rows of found(digest, ...), one for each digest, that the index lacks."""
        return found.join(self.read().hint("merge"), "digest", "left_anti") if self.exists() else found

    def _write(self, rows: DataFrame, version: int) -> None:
        """Each bucket is written by one task."""
        spread = rows.select("digest", "keep_id").repartition(F.pmod(F.hash("digest"), F.lit(self.buckets)))
        out = spread.sortWithinPartitions("digest").write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        (out.option("path", f"{self.path}/v{version}") if self.path else out).saveAsTable(self.table(version))

    def append(self, found: DataFrame) -> None:
        """Adds fresh rows."""
        self._write(found, max(1, self.version()))
        if len(self.read().inputFiles()) > MOST_FILES * self.buckets:
            self.compact()

    def compact(self) -> None:
        """Writes the index anew, with buckets for the rows it has."""
        old, rows = self.version(), self.read()
        self.buckets = max(8, -(-rows.count() // BUCKET_ROWS))
        self._write(rows, old + 1)
        self.spark.sql(f"drop table {self.table(old)}")

    def drop(self) -> None:
        for t in self.spark.catalog.listTables(pattern=f"{self.name.lower()}_v*"):
            self.spark.sql(f"drop table if exists {t.name}")


def digests(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, copies): equal rows counted, written down."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"))
    return materialize(own.groupBy("digest", "doc_id").agg(F.count("*").alias("copies")))


def add(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """Adds a batch of rows(digest, doc_id) to the index; returns what was new, (digest, keep_id), written down."""
    fresh = materialize(index.fresh(rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))))
    index.append(fresh)
    return fresh


def resolve(rows: DataFrame, index: DigestIndex, fresh: DataFrame) -> DataFrame:
    """rows(digest, doc_id, copies), one for each copy: doc_id, keep_id from the index, group_size, kept (only where fresh(digest) holds the digest), text_sha256."""
    groups = rows.groupBy("digest").agg(F.sum("copies").alias("group_size"))
    known = groups.join(index.read().hint("merge"), "digest").join(fresh.select("digest", F.lit(True).alias("new")), "digest", "left")
    known = materialize(known.select(F.col("digest").alias("d"), "keep_id", "group_size", F.coalesce("new", F.lit(False)).alias("new")))
    each = rows.join(known, rows["digest"] == known["d"]).select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    kept = F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Adds a batch of documents to the index. One row for each: doc_id, keep_id, group_size (in this batch), kept, text_sha256."""
    rows = digests(docs)
    return resolve(rows, index, add(rows, index))


def deduplicate_table(docs: DataFrame, index: DigestIndex, batches: int = 4) -> DataFrame:
    """The same for a whole table, which is dealt into batches of ascending doc_id; group_size counts all of it."""
    rows = digests(docs)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] or []
    cuts = sorted(set(cuts))
    fresh = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = F.lit(True) if low is None else F.coalesce(F.col("doc_id") > low, F.lit(True))
        batch &= F.lit(True) if high is None else F.coalesce(F.col("doc_id") <= high, F.lit(False))
        new = add(rows.filter(batch), index)
        fresh = new if fresh is None else fresh.unionByName(new)
    return resolve(rows, index, fresh)


def deduplicate_once(docs: DataFrame) -> DataFrame:
    """deduplicate_table() with an index of its own, dropped afterwards; the result no longer needs it."""
    index = DigestIndex(docs.sparkSession, f"digests_{uuid.uuid4().hex}")
    out = deduplicate_table(docs, index)
    index.drop()
    return out


ORACLE = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) text_sha256 from documents)
select doc_id, min(doc_id) over g keep_id, count(*) over g group_size, row_number() over (partition by text_sha256 order by doc_id nulls last) = 1 kept, text_sha256
from d window g as (partition by text_sha256)"""

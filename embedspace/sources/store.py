"""A store of vectors in Parquet, keyed by file path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedspace.schema import FAILURES, THUMBNAILS, VECTORS


def last_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with the same keys the one that comes last in the order; combined in every task, so a hot key is no problem."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order and not dict(df.dtypes)[c].startswith("map")])).alias("r")).select(*keys, "r.*").select(*df.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """existing with the rows of new put in or replaced; the last of new's rows with the same keys wins."""
    last = last_by_key(new, keys, order)
    return existing.join(last, keys, "left_anti").unionByName(last)


def violations(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that repeat."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def fetch_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with this key, if there is one; the filter reaches the files."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def with_layout(vectors: DataFrame, layout: DataFrame, key: str) -> DataFrame:
    """vectors with pca_x and pca_y from layout(key, x, y) where it has the key; other keys of the layout do nothing."""
    new = layout.select(F.col(key).alias("__k"), F.col("x").cast("float").alias("__x"), F.col("y").cast("float").alias("__y"))
    out = vectors.join(new, F.col(key) == F.col("__k"), "left")
    return out.withColumns({"pca_x": F.coalesce("__x", "pca_x"), "pca_y": F.coalesce("__y", "pca_y")}).drop("__k", "__x", "__y")


def layout_complete(vectors: DataFrame) -> DataFrame:
    """One row: whether all rows have both coordinates; true for none."""
    return vectors.agg(F.coalesce(F.bool_and(F.col("pca_x").isNotNull() & F.col("pca_y").isNotNull()), F.lit(True)).alias("complete"))


class VectorStore:
    """Commits under root: each is a folder of rows and a marker file that names it, so a failed write changes nothing.

    A base commit holds the whole table; a delta commit only rows that are put in or replaced, so a save writes no more
    than it brings. Readers put the last base and the deltas since together, the later commit winning by key. When deltas
    have piled up, in number or in bytes, the next save writes a base. Only what compaction replaced is deleted, one
    base later, for those who still read it.

    Thumbnails and failures are Parquet tables beside it. File work goes through Hadoop's file system, so root may be on
    any store that Spark reaches. One writer at a time.
    """

    #: Deltas, and their share of the base's bytes, from which a save compacts.
    MOST_DELTAS, MOST_SHARE = 16, 0.5

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...] = ("file_path",)):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def ensure(self) -> None:
        self._fs.mkdirs(self._path(self.root))

    def _names(self, folder: str = "") -> list[str]:
        at = self._path(f"{self.root}/{folder}" if folder else self.root)
        return sorted(str(s.getPath().getName()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _commits(self) -> list[tuple[int, str, str]]:
        """(number, kind, folder) of what counts: the last base and the deltas after it."""
        found = [(int(n.split("-")[1]), n.split("-")[2], n.split("-")[3]) for n in self._names() if n.startswith("commit-")]
        base = max((i for i, c in enumerate(found) if c[1] == "base"), default=0)
        return found[base:]

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], VECTORS + ", commit long")
        return self.spark.read.schema(VECTORS + ", commit long").parquet(*(f"{self.root}/{f}" for f in folders))

    def read(self) -> DataFrame:
        """The table's rows. Deltas are small beside the base, so its rows need no shuffle where Spark broadcasts their keys."""
        commits = self._commits()
        base, deltas = self._rows([f for _, k, f in commits if k == "base"]), [f for _, k, f in commits if k == "delta"]
        if not deltas:
            return base.drop("commit")
        return upsert(base, self._rows(deltas), self.keys, "commit").drop("commit")

    def exists(self, path: str) -> bool:
        return bool(self.read().filter(F.col("file_path") == path).select("file_path").head(1))

    def fetch(self, path: str) -> DataFrame:
        return fetch_key(self.read(), "file_path", path)

    def next_id(self) -> int:
        """The vec_id after the greatest one: ids given out from it on follow the order of arrival."""
        return int(self.read().agg(F.coalesce(F.max("vec_id") + 1, F.lit(0))).first()[0])

    def _commit(self, rows: DataFrame, kind: str) -> None:
        self.ensure()
        number = max((int(n.split("-")[1]) for n in self._names() if n.startswith("commit-")), default=0) + 1
        folder = f"v{uuid.uuid4().hex}"
        columns = [f.name for f in self._rows([]).schema if f.name != "commit"]
        rows.select(*columns, F.lit(number).cast("long").alias("commit")).write.parquet(f"{self.root}/{folder}")
        before = {c[2] for c in self._commits()}
        self._fs.create(self._path(f"{self.root}/commit-{number:012d}-{kind}-{folder}")).close()
        if kind == "base":
            for n in self._names():
                if (n.startswith("commit-") and n.split("-")[3] not in before | {folder}) or (n.startswith("v") and n not in before | {folder}):
                    self._fs.delete(self._path(f"{self.root}/{n}"), True)

    def _bytes(self, folders: list[str]) -> int:
        return sum(self._fs.getContentSummary(self._path(f"{self.root}/{f}")).getLength() for f in folders)

    def save(self, rows: DataFrame, order: str = "processed_at") -> None:
        """Puts rows in or replaces them by key; the last one wins."""
        self._commit(last_by_key(rows, self.keys, order), "delta")
        commits = self._commits()
        base, deltas = [f for _, k, f in commits if k == "base"], [f for _, k, f in commits if k == "delta"]
        if len(deltas) >= self.MOST_DELTAS or base and self._bytes(deltas) > self.MOST_SHARE * self._bytes(base):
            self.compact()

    def compact(self) -> None:
        self._commit(self.read(), "base")

    def save_layout(self, layout: DataFrame) -> None:
        """Coordinates from layout(file_path, x, y), all rows in one rewrite."""
        self._commit(with_layout(self.read(), layout, "file_path"), "base")

    def complete(self) -> bool:
        return layout_complete(self.read()).first()["complete"]

    def thumbnail_folder(self) -> str:
        return f"{self.root}/thumbnails"

    def thumbnails(self) -> DataFrame:
        """(file_path, key, content)."""
        return self._beside("thumbnails", THUMBNAILS)

    def save_thumbnails(self, rows: DataFrame) -> None:
        rows.select("file_path", "key", "content").write.mode("append").parquet(self.thumbnail_folder())

    def failures(self) -> DataFrame:
        """(file_path, error, tried_at) of files that failed when they were tried last and that the table lacks."""
        found = last_by_key(self._beside("failures", FAILURES), ["file_path"], "tried_at")
        return found.join(self.read().select("file_path"), "file_path", "left_anti")

    def save_failures(self, rows: DataFrame) -> None:
        rows.select("file_path", "error", F.current_timestamp().alias("tried_at")).write.mode("append").parquet(f"{self.root}/failures")

    def _beside(self, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}") if self._names(folder) else self.spark.createDataFrame([], schema)

    def clear(self) -> None:
        """Deletes the table's commits, thumbnails and failures under root, and nothing else."""
        for n in self._names():
            if n.startswith("commit-") or n.startswith("v") and len(n) == 33 or n in ("thumbnails", "failures"):
                self._fs.delete(self._path(f"{self.root}/{n}"), True)


__all__ = ["VectorStore", "fetch_key", "last_by_key", "layout_complete", "upsert", "violations", "with_layout"]

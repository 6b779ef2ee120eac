"""Leader clustering in the order of vec_id, and what is computed for clusters.

A vector is a seed if no earlier seed is similar to it; any other joins the earliest similar seed.
Rounds: the first undecided rows (a bounded batch) are decided on the driver, their new seeds are
sent out, and all undecided rows meet them in NumPy blocks. Only a batch of seeds is ever sent. Each
round writes what it met to a folder of its own, decided rows without their vectors; the result is one
scan of all rounds' folders, so plans don't grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedspace.operators.similarity import blocks, matrix, unit_rows
from embedspace.schema import ASSIGNMENTS, check_vectors, fresh_path, written

#: Default threshold, and that of the interactive preset.
THRESHOLD, PRESET = 0.85, 0.5
#: Greatest long.
MOST = (1 << 63) - 1


def first_by_key(df: DataFrame, key: str) -> DataFrame:
    """Of rows with the same key the one with the least vec_id: later ones take no part in clustering."""
    least = df.groupBy(F.col(key).alias("__k")).agg(F.min("vec_id").alias("__v"))
    return df.join(least, (F.col(key) == F.col("__k")) & (F.col("vec_id") == F.col("__v")), "left_semi")


def cut_point(df: DataFrame, size: int) -> int | None:
    """A vec_id such that between size and a few times size rows are not above it, or None for all; found by zooming into histograms, so little reaches the driver."""
    row = df.agg(F.count("*").alias("n"), F.min("vec_id").alias("a"), F.max("vec_id").alias("b")).first()
    if row["n"] <= size:
        return None
    low, high, below = row["a"], row["b"], 0
    while True:
        width = max(1, -(-(high - low + 1) // 1024))
        # In decimals: the distance of two longs, such as hashes, may pass what a long holds.
        place = F.floor((F.col("vec_id").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int")
        counts = {r["k"]: r["n"] for r in df.filter(F.col("vec_id").between(low, min(high, MOST))).groupBy(place.alias("k")).agg(F.count("*").alias("n")).collect()}
        total = below
        for k in sorted(counts):
            if total + counts[k] >= size:
                break
            total += counts[k]
        if width == 1 or total + counts[k] <= 4 * size:
            return min(low + (k + 1) * width - 1, MOST)
        low, high, below = low + k * width, low + (k + 1) * width - 1, total


def leaders(rows: np.ndarray, threshold: float) -> list[int]:
    """Positions of the seeds among rows (normalised, in order), none of which is similar to an earlier seed."""
    seeds: list[int] = []
    taken = np.zeros(len(rows), bool)
    for i in range(len(rows)):
        if not taken[i]:
            seeds.append(i)
            taken |= rows @ rows[i] >= threshold
            taken[i] = True
    return seeds


def leader_clusters(df: DataFrame, threshold: float = THRESHOLD, batch: int = 2048) -> DataFrame:
    """df(vec_id, vector) to (vec_id, cluster_id, is_seed, similarity to the seed), clusters numbered from 0 in the order of their seeds.

    vec_id must be unique and is the order; a zero vector is similar to nothing and is a cluster of
    its own, with similarity 1 like every seed.
    """
    spark = df.sparkSession
    undecided, count, paths = written(df.select(F.col("vec_id").cast("long").alias("vec_id"), "vector")), 0, []
    _, dims = check_vectors(undecided)
    kinds = ASSIGNMENTS + ", vector array<float>"
    while True:
        cut = cut_point(undecided, batch)
        head = (undecided if cut is None else undecided.filter(F.col("vec_id") <= cut)).orderBy("vec_id").toArrow().combine_chunks()
        if head.num_rows:
            ids, rows = head.column("vec_id").to_numpy(), unit_rows(matrix(head.column("vector").combine_chunks(), dims))
            new = leaders(rows, threshold)
            sent = spark.sparkContext.broadcast((ids[new], rows[new], count))

            def assign(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                seed_ids, seeds, base = sent.value
                for b in blocks(batches):
                    own = b.column(0).to_numpy()
                    s = unit_rows(matrix(b.column(1), dims)) @ seeds.T
                    place = np.searchsorted(seed_ids, own)
                    is_seed = (place < len(seed_ids)) & (seed_ids[np.minimum(place, len(seed_ids) - 1)] == own)
                    hit = s >= threshold
                    first = np.where(is_seed, place, np.argmax(hit, axis=1))
                    decided = is_seed | hit.any(axis=1)
                    sim = np.where(is_seed, 1.0, s[np.arange(len(own)), np.minimum(first, len(seed_ids) - 1)])
                    left = pc.if_else(pa.array(decided), pa.scalar(None, b.column(1).type), b.column(1))
                    yield pa.record_batch([b.column(0), pa.array(np.where(decided, base + first, -1).astype(np.int32)), pa.array(is_seed), pa.array(sim), left], ["vec_id", "cluster_id", "is_seed", "similarity", "vector"])

            paths.append(fresh_path(spark))
            undecided.mapInArrow(assign, kinds).write.parquet(paths[-1])
            undecided = spark.read.schema(kinds).parquet(paths[-1]).filter("cluster_id < 0").select("vec_id", "vector")
            count += len(new)
        if cut is None:
            if not paths:
                return spark.createDataFrame([], ASSIGNMENTS)
            return spark.read.schema(ASSIGNMENTS).parquet(*paths).filter("cluster_id >= 0")


def members(df: DataFrame, assignments: DataFrame) -> DataFrame:
    return df.join(assignments.select("vec_id", "cluster_id", "is_seed"), "vec_id")


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("cluster_id").agg(F.count("*").alias("image_count"))


def centroid_entries(df: DataFrame, key: str) -> DataFrame:
    """(key, dim, value): means by element; combined in every task before the shuffle."""
    return df.select(key, F.posexplode("vector").alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def centroids(df: DataFrame, key: str) -> DataFrame:
    """(key, image_count, centroid array<double>)."""
    entries = centroid_entries(df, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("e"))
    counts = df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("image_count"))
    return entries.join(counts, F.col(key) == F.col("__k")).select(key, "image_count", F.transform("e", lambda x: x["value"]).alias("centroid"))


def nested_clusters(df: DataFrame, assignments: DataFrame) -> DataFrame:
    """(cluster_id, images, centroid): members of each cluster as an array, seed first, then in order. For clusters that fit in a row."""
    own = members(df, assignments)
    listed = own.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("is_seed")).alias("later"), "vec_id"))).alias("m"))
    return listed.join(centroids(own, "cluster_id"), "cluster_id").select("cluster_id", F.transform("m", lambda x: x["vec_id"]).alias("images"), "image_count", "centroid")

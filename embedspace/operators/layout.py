"""PCA maps and canvas layouts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedspace.operators.clustering import centroids
from embedspace.operators.similarity import blocks, matrix
from embedspace.schema import VectorError, written

#: Canvas of the map and of the interactive preset; share of a side left free at each end; least range.
CANVAS, PRESET_CANVAS, PADDING, LEAST_RANGE = 10_000, 1_000, 0.05, 1e-4
#: Numbers in a block of a sum that tasks add up.
BLOCK = 1 << 15
SUMS = "block long, n long, numbers binary"


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the tasks' sums, added up one after another."""
    found: dict[int, list] = {}
    for b in batches:
        for block, n, numbers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            own = np.frombuffer(numbers)
            had = found.setdefault(block, [0, np.zeros(len(own))])
            if len(had[1]) != len(own):
                raise VectorError("vectors of unequal length")
            had[0], had[1] = had[0] + n, had[1] + own
    yield sum_batch(list(found), [x[0] for x in found.values()], [x[1] for x in found.values()])


def sum_batch(places: list[int], n: list[int], numbers: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(places, pa.int64()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in numbers], pa.binary())], ["block", "n", "numbers"])


def in_blocks(total: np.ndarray, n: int) -> pa.RecordBatch:
    flat = total.reshape(-1)
    parts = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
    return sum_batch(list(range(len(parts))), [n] * len(parts), parts)


def added(parts: DataFrame, ways: int = 64) -> DataFrame:
    """One row a block: first within groups of tasks, then over these, so that no task adds up all tasks' blocks but for a few."""
    near = parts.repartition("block", F.pmod(F.spark_partition_id(), F.lit(ways))).mapInArrow(sums, SUMS)
    return near.repartition("block").mapInArrow(sums, SUMS)


def mean_vector(df: DataFrame) -> np.ndarray:
    """Means of df(vector) by place; empty for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in blocks(batches):
            x = matrix(b.column(0), None if total is None else len(total))
            total, n = x.sum(axis=0) + (0 if total is None else total), n + len(x)
        if n:
            yield in_blocks(total, n)

    rows = sorted(added(df.select("vector").mapInArrow(run, SUMS)).collect(), key=lambda r: r["block"])
    if len({r["n"] for r in rows}) > 1:
        raise VectorError("vectors of unequal length")
    return np.concatenate([np.frombuffer(bytes(r["numbers"])) / r["n"] for r in rows]) if rows else np.zeros(0)


def column_means(df: DataFrame) -> DataFrame:
    """(dim, mean) over all vectors."""
    return df.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(mean_vector(df))], "dim int, mean double")


def centered(df: DataFrame) -> DataFrame:
    """df with vector less the means, as doubles; the means are sent out."""
    sent = df.sparkSession.sparkContext.broadcast(mean_vector(df))
    at = df.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            x = matrix(b.column(at), len(sent.value)) - sent.value
            own = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1])), pa.int32()), pa.array(x.reshape(-1)))
            yield b.set_column(at, "vector", own)

    schema = df.withColumn("vector", F.col("vector").cast("array<double>")).schema
    return df.mapInArrow(run, schema)


def principal_axes(df: DataFrame, k: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, the first k axes (as columns) and their singular values, of df(vector). Scatter matrices are summed in every task and block by block
    over the tasks; one task solves for the axes, so d x k numbers reach the driver.

    Each axis's greatest loading by size is positive. Axes that the data lack are zero.
    """
    mean = mean_vector(df)
    d = len(mean)
    if not d:
        return mean, np.zeros((0, k)), np.zeros(k)
    sent = df.sparkSession.sparkContext.broadcast(mean)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((d, d)), 0
        for b in blocks(batches):
            x = matrix(b.column(0), d) - sent.value
            total += x.T @ x
            n += len(x)
        if n:
            yield in_blocks(total, n)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d * d)
        for b in batches:
            for block, numbers in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                total[block * BLOCK : block * BLOCK + len(numbers) // 8] = np.frombuffer(numbers)
        values, vectors = np.linalg.eigh(total.reshape(d, d))
        m = min(k, d)
        yield pa.record_batch([pa.array([pickle.dumps((values[::-1][:m].copy(), vectors[:, ::-1][:, :m].copy()))])], ["found"])

    parts = written(added(df.select("vector").mapInArrow(scatter, SUMS)))
    values, vectors = pickle.loads(bytes(parts.coalesce(1).mapInArrow(solve, "found binary").first()["found"]))
    axes, sizes = np.zeros((d, k)), np.zeros(k)
    axes[:, : len(values)], sizes[: len(values)] = vectors * (values > 0), np.sqrt(np.maximum(values, 0))
    big = axes[np.abs(axes).argmax(axis=0), np.arange(k)]
    return mean, axes * np.where(big < 0, -1, 1), sizes


def singular_values(df: DataFrame, k: int = 2) -> DataFrame:
    """(axis, singular_value) of the centered vectors, the greatest first."""
    sizes = principal_axes(df.select("vector"), k)[2]
    return df.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(sizes)], "axis int, singular_value double")


def pca_scores(df: DataFrame, names: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """df with its scores on the first axes, unscaled, instead of the vector. A single row, or rows all equal, score 0."""
    mean, axes, _ = principal_axes(df.select("vector"), len(names))
    if not len(mean):
        return df.withColumns({n: F.lit(0.0) for n in names}).drop("vector")
    sent, rest, at = df.sparkSession.sparkContext.broadcast((mean, axes)), [c for c in df.columns if c != "vector"], df.columns.index("vector")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes = sent.value
        for b in blocks(batches):
            scores = (matrix(b.column(at), len(mean)) - mean) @ axes
            yield pa.record_batch([*(b.column(c) for c in rest), *(pa.array(scores[:, i].copy()) for i in range(len(names)))], [*rest, *names])

    schema = df.select(*rest, *(F.lit(0.0).cast("double").alias(n) for n in names)).schema
    return df.mapInArrow(project, schema)


def bounds(df: DataFrame) -> DataFrame:
    """One row: least and greatest x and y."""
    return df.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def on_canvas(p: Column, low: Column, span: Column, size: float) -> Column:
    return (p - low) / span * F.lit(size * (1 - 2 * PADDING)) + F.lit(size * PADDING)


def to_canvas(df: DataFrame, width: float = CANVAS, height: float = CANVAS, cached: bool = False) -> DataFrame:
    """x and y moved and scaled into the canvas. A range below 0.0001 counts as 1, or in cached layouts as 0.0001."""
    wide = df.crossJoin(F.broadcast(bounds(df)))
    span = lambda a, b: F.greatest(b - a, F.lit(LEAST_RANGE)) if cached else F.when(b - a < LEAST_RANGE, 1.0).otherwise(b - a)
    x = on_canvas(F.col("x"), F.col("min_x"), span(F.col("min_x"), F.col("max_x")), width)
    y = on_canvas(F.col("y"), F.col("min_y"), span(F.col("min_y"), F.col("max_y")), height)
    return wide.withColumns({"x": x, "y": y}).drop("min_x", "max_x", "min_y", "max_y")


def positions(df: DataFrame, assignments: DataFrame | None = None, width: float = CANVAS, height: float = CANVAS, with_centroids: bool = True) -> DataFrame:
    """(vec_id, cluster_id, is_centroid, x, y): vectors and, as rows without vec_id, their clusters' centroids on one map."""
    own = df.select("vec_id", "vector")
    own = own.withColumn("cluster_id", F.lit(0)) if assignments is None else own.join(assignments.select("vec_id", "cluster_id"), "vec_id")
    rows = own.select("vec_id", "cluster_id", F.lit(False).alias("is_centroid"), F.col("vector").cast("array<double>").alias("vector"))
    if with_centroids and assignments is not None:
        middle = centroids(own, "cluster_id").filter("centroid is not null")
        rows = rows.unionByName(middle.select(F.lit(None).cast("long").alias("vec_id"), "cluster_id", F.lit(True).alias("is_centroid"), F.col("centroid").alias("vector")))
    return to_canvas(written(pca_scores(rows)), width, height)  # read twice, once for the bounds


def scatter_summary(placed: DataFrame) -> DataFrame:
    """(cluster_id, x, y, image_count) of clusters that have a centroid, at its place."""
    at = lambda c: F.max(F.when(F.col("is_centroid"), F.col(c))).alias(c)
    return placed.groupBy("cluster_id").agg(at("x"), at("y"), F.count_if(~F.col("is_centroid")).alias("image_count"), F.bool_or("is_centroid").alias("c")).filter("c").drop("c")


def images_only(placed: DataFrame) -> DataFrame:
    return placed.filter(~F.col("is_centroid"))


def on_grid(placed: DataFrame) -> DataFrame:
    """Whole coordinates, cut towards zero."""
    return placed.withColumns({"x": F.col("x").cast("int"), "y": F.col("y").cast("int")})

"""Similarity search and similarity joins.

All take df(vec_id, vector). Bulk products run as NumPy blocks over Arrow batches. Vectors of unequal
length, or with nulls or NaN, can't be compared: a VectorError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedspace.functions.vectors import sparsify
from embedspace.schema import VectorError, check_vectors

#: Largest matrix, in bytes, that is sent to all executors; beyond it the join is tiled.
BROADCAST_BYTES = 64 << 20
#: Rows of one side of a tile, and of a block that is worked on at a time.
TILE_ROWS, BLOCK_ROWS = 4096, 1024


def matrix(column: pa.Array, dims: int | None = None, kind: type = np.float64) -> np.ndarray:
    """Rows of equal length (dims, if given) as a matrix of doubles, or of another kind."""
    if not len(column):
        return np.zeros((0, dims or 0))
    sizes = pc.list_value_length(column)
    least, most = pc.min_max(sizes).as_py().values()
    if column.null_count or least != most or dims not in (None, most):
        raise VectorError(f"vectors of {least} to {most} numbers, of {most if dims is None else dims}, or null ones")
    flat = column.flatten()
    numbers = flat.to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)
    if flat.null_count or numbers.size and np.isnan(numbers.min()):  # a least number is NaN if any is
        raise VectorError("vectors that hold nulls or NaN")
    return numbers


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows become NaN, so that they match nothing."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def first_vector(df: DataFrame) -> int | None:
    """The vec_id that comes first."""
    return df.agg(F.min("vec_id").alias("first")).first()["first"]


def anchor_row(df: DataFrame, anchor: int) -> np.ndarray | None:
    found = df.filter(F.col("vec_id") == anchor).select("vector").limit(1).toArrow().combine_chunks().column("vector").combine_chunks()
    return matrix(found)[0] if len(found) else None


SIMILARITIES = "vec_id long, similarity double"


def similarity_to(df: DataFrame, anchor: int, ranked: bool = False) -> DataFrame:
    """(vec_id, similarity) of all other rows to the anchor, NaN where a vector is zero. The anchor, of length one, is sent out; no shuffle."""
    one = anchor_row(df, anchor)
    if one is None:
        return df.sparkSession.createDataFrame([], SIMILARITIES)
    sent = df.sparkSession.sparkContext.broadcast(unit_rows(one[None])[0])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            yield pa.record_batch([b.column(0), pa.array(unit_rows(matrix(b.column(1), len(sent.value))) @ sent.value)], ["vec_id", "similarity"])

    out = df.filter(F.col("vec_id") != anchor).select(F.col("vec_id").cast("long").alias("vec_id"), "vector").mapInArrow(meet, SIMILARITIES)
    return out.orderBy(F.desc("similarity"), "vec_id") if ranked else out


def greatest_entries(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of each row's k greatest entries, in falling order, ties to the lower place."""
    n, d = m.shape
    k = min(k, d)
    if not n or not k:
        return np.zeros((n, k), np.int64), np.zeros((n, k))
    edge = np.partition(m, d - k, axis=1)[:, d - k, None]
    chosen = m >= edge
    tied = np.flatnonzero(np.count_nonzero(chosen, axis=1) > k)
    if len(tied):
        above, level = m[tied] > edge[tied], m[tied] == edge[tied]
        chosen[tied] = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    at = np.nonzero(chosen)[1].reshape(n, k)
    values = np.take_along_axis(m, at, axis=1)
    order = np.argsort(-values, axis=1, kind="stable")
    return np.take_along_axis(at, order, axis=1), np.take_along_axis(values, order, axis=1)


def sparse_entries(df: DataFrame, k: int = 10) -> DataFrame:
    """(vec_id, dim, val): the k greatest entries of each vector."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            at, values = greatest_entries(matrix(b.column(1), kind=np.float32), k)
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), at.shape[1])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(at.reshape(-1).astype(np.int32)), pa.array(values.reshape(-1))], ["vec_id", "dim", "val"])

    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<float>").alias("vector")).mapInArrow(pick, "vec_id long, dim int, val float")


def sparse_vectors(df: DataFrame, k: int = 10) -> DataFrame:
    return df.select("vec_id", sparsify(F.col("vector"), k).alias("sparse"))


def sparse_similarity_to(df: DataFrame, anchor: int, k: int = 10) -> DataFrame:
    """(vec_id, similarity) of sparsified vectors to the anchor's, 0 where one is zero. The anchor's k entries are sent out; no shuffle."""
    one = anchor_row(df, anchor)
    if one is None:
        return df.sparkSession.createDataFrame([], SIMILARITIES)
    at, values = greatest_entries(one[None].astype(np.float32), k)
    wanted = np.zeros(len(one))
    wanted[at[0]] = values[0]
    sent = df.sparkSession.sparkContext.broadcast(wanted)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in blocks(batches):
            at, values = greatest_entries(matrix(b.column(1), len(own), np.float32), k)
            values = values.astype(np.float64)
            size = np.sqrt((values * values).sum(axis=1)) * np.sqrt(own @ own)
            dot = (values * own[at]).sum(axis=1)
            yield pa.record_batch([b.column(0), pa.array(np.divide(dot, size, out=np.zeros(len(dot)), where=size > 0))], ["vec_id", "similarity"])

    return df.filter(F.col("vec_id") != anchor).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<float>").alias("vector")).mapInArrow(meet, SIMILARITIES)


def block_pairs(ids: np.ndarray, rows: np.ndarray, other_ids: np.ndarray, others: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a < b) of rows (normalised) with a product of threshold or more."""
    s = rows @ others.T
    i, j = np.nonzero((s >= threshold) & (ids[:, None] < other_ids[None, :]))
    return ids[i], other_ids[j], s[i, j]


PAIRS = "a long, b long, similarity double"


def pair_batch(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(s.astype(np.float64))], ["a", "b", "similarity"])


def similar_pairs(df: DataFrame, threshold: float, broadcast_bytes: int = BROADCAST_BYTES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """All pairs (a, b, similarity) with a < b and a similarity of threshold or more.

    A matrix within broadcast_bytes is sent out and met block by block; a larger one is dealt into
    tiles, so that each task holds two chunks of tile_rows.
    """
    df = df.select("vec_id", "vector")
    n, d = check_vectors(df)
    if n * d * 8 <= broadcast_bytes:
        table = df.toArrow().combine_chunks()
        ids = table.column("vec_id").to_numpy()
        rows = unit_rows(matrix(table.column("vector").combine_chunks())) if n else np.zeros((0, 0))
        sent = df.sparkSession.sparkContext.broadcast((ids, rows))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_ids, all_rows = sent.value
            for part in blocks(batches):
                yield pair_batch(*block_pairs(part.column(0).to_numpy(), unit_rows(matrix(part.column(1), d)), all_ids, all_rows, threshold))

        return df.repartition(max(1, min(n // 256, 10_000)), "vec_id").mapInArrow(meet, PAIRS)
    g = -(-n // tile_rows)
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(g)).cast("int")
    spread = df.withColumn("c", chunk).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    spread = spread.select(F.least("c", "j").alias("ta"), F.greatest("c", "j").alias("tb"), "c", "vec_id", "vector")

    def tile(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        c, ids = table.column("c").to_numpy(), table.column("vec_id").to_numpy()
        rows = unit_rows(matrix(table.column("vector").combine_chunks()))
        a, b = (c == k.as_py() for k in key)
        if key[0].as_py() == key[1].as_py():
            found = block_pairs(ids, rows, ids, rows, threshold)
        else:
            x, y, s = block_pairs(ids[a], rows[a], ids[b], rows[b], threshold)
            u, v, w = block_pairs(ids[b], rows[b], ids[a], rows[a], threshold)
            found = np.concatenate((x, u)), np.concatenate((y, v)), np.concatenate((s, w))
        return pa.Table.from_batches([pair_batch(*found)])

    return spread.groupBy("ta", "tb").applyInArrow(tile, PAIRS)

"""Column expressions on dense and sparse vectors; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; NaN where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(F.try_divide(dot(a, b), size))


def at_least(similarity: Column, threshold: float) -> Column:
    """similarity >= threshold, with NaN counted as false, although Spark orders NaN above all numbers."""
    return ~F.isnan(similarity) & (similarity >= F.lit(threshold))


def top_entries(v: Column, k: int) -> Column:
    """The k greatest entries by signed value as structs (dim, val), ties to the lower index."""
    ranked = F.array_sort(F.transform(v, lambda x, i: F.struct((-x).alias("neg"), i.alias("dim"), x.alias("val"))))
    return F.transform(F.slice(ranked, 1, k), lambda e: F.struct(e["dim"].alias("dim"), e["val"].alias("val")))


def sparsify(v: Column, k: int = 10) -> Column:
    """The k greatest entries as map<int, float>; shorter vectors keep all."""
    return F.map_from_entries(top_entries(v, k))


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps over their shared keys, norms over all of each; 0 where a norm is 0."""
    square = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    shared = F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"].cast("double") * F.coalesce(F.try_element_at(b, e["key"]).cast("double"), F.lit(0.0)))
    size = square(a) * square(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.try_divide(shared, size))


def softmax(v: Column) -> Column:
    """Softmax, shifted by the greatest entry."""
    top = F.array_max(doubles(v))
    powers = F.transform(doubles(v), lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, y: s + y)
    return F.get(F.transform(F.array(total), lambda t: F.transform(powers, lambda x: x / t)), F.lit(0))


def arg_max(v: Column) -> Column:
    """0-based index of the greatest entry, the first of equals."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def dump(v: Column) -> Column:
    """Entries as text with spaces between."""
    return F.array_join(F.transform(v, lambda x: x.cast("string")), " ")

"""Connected components by labels that fall to the least neighbour and jump to their label's label.

Everything stays in Spark: aggregations by minimum combine in every task before they shuffle, and
joins are between written tables, so Spark splits what is skewed. Rounds grow with the logarithm
of a component's width in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedspace.llm.common import materialize


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges(a, b) of longs to (node, label), label being the least node of its component. Nodes without an edge are absent."""
    both = materialize(edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        fell = materialize(labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        up = fell.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        jumped = materialize(fell.join(up, fell["label"] == up["__n"]).select("node", F.least("label", "__l").alias("label"), (F.least("label", "__l") < F.col("old")).alias("moved")))
        labels = jumped.select("node", "label")
        if not jumped.filter("moved").head(1):
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def memberships_of(rows: DataFrame, classes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """rows(doc_id, key, ...) with component_id and root, where classes(key, first_id) are linked by edges(a, b).

    component_id is the least first_id of a component; null if it has none. root, the least key of a
    component, tells components apart that share a component_id or have none.
    """
    labels = components(edges).select(F.col("node").alias("__n"), "label")
    rooted = materialize(classes.join(labels, classes[key] == labels["__n"], "left").select(key, "first_id", F.coalesce("label", key).alias("root")))
    least = materialize(rooted.groupBy(F.col("root").alias("__r")).agg(F.min("first_id").alias("component_id")))
    of = materialize(rooted.join(least, rooted["root"] == least["__r"]).select(F.col(key).alias("__f"), "component_id", "root"))
    return rows.join(of, rows[key] == of["__f"]).select(*rows.columns, "component_id", "root")

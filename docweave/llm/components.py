"""Connected components of links, by minimum labels and pointer jumping.

Labels and links stay in tables: the driver sees only counts.  Every round is
written to the shared folder, which cuts lineage.  A node with very many links
is met by partial aggregation before any row of it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component): each linked id and the smallest id that it reaches.  ``edges``: (a, b) of one type."""
    edges = edges.filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
    # Each id hangs on its smallest neighbour; contracting roots shrinks the links until none is left.
    labels = None
    while True:
        edges = materialize(edges, "component-links")
        if edges.isEmpty():
            break
        both = edges.union(edges.selectExpr("b AS a", "a AS b"))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).selectExpr("a AS id", "least(a, p) AS parent")
        parent = _jump(materialize(parent, "component-parents"))
        labels = parent if labels is None else materialize(_relabel(labels, parent, "parent"), "component-labels")
        edges = _relabel(_relabel(edges, parent, "a"), parent, "b").filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
    if labels is None:
        return edges.selectExpr("a AS id", "b AS component").limit(0)
    return labels.withColumnRenamed("parent", "component")


def _jump(parent: DataFrame) -> DataFrame:
    """Follows parents to roots; a chain's length halves each round."""
    while True:
        up = parent.selectExpr("id AS up", "parent AS top")
        parent = parent.join(up, F.col("parent") == F.col("up"), "left").select("id", F.coalesce("top", "parent").alias("parent"), (F.coalesce("top", "parent") != F.col("parent")).alias("moved"))
        parent = materialize(parent, "component-parents")
        if parent.filter("moved").isEmpty():
            return parent.drop("moved")
        parent = parent.drop("moved")


def _relabel(rows: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    new = parent.selectExpr("id AS _id", "parent AS _parent")
    return rows.join(new, F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("_parent", column)).drop("_id", "_parent")

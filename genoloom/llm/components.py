"""Connected components of a link table, by hooking and pointer jumping on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import discard, stored


def _followed(rows: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    """rows with root: the parent of the node in column, or that node if it has none."""
    up = parents.select(F.col("node").alias("__node"), F.col("parent").alias("__parent"))
    return rows.join(up, F.col(column) == F.col("__node"), "left").withColumn("root", F.coalesce("__parent", column)).drop("__node", "__parent")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): component is the smallest node reachable, itself included.

    Each round hooks every node on its smallest smaller neighbour, jumps pointers until they rest on roots, and contracts the links to
    their roots; links between different roots are left for the next round. Nothing but counts reaches the driver, and three small tables a round are written.
    All but the result are removed at the end.
    """
    links = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    used = [links]
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node"))
    while not links.isEmpty():
        parents = stored(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "parents")
        used.append(parents)
        while True:
            once = _followed(parents, parents, "parent").select("node", F.col("root").alias("parent"))
            jumped = stored(_followed(once, parents, "parent").select("node", F.col("root").alias("parent"), (F.col("root") != F.col("parent")).alias("moved")), "jumped")
            used.append(jumped)
            parents = jumped.select("node", "parent")
            if jumped.filter("moved").isEmpty():
                break
        labels = _followed(labels, parents, "component").select("node", F.col("root").alias("component"))
        rest = _followed(_followed(links, parents, "a").select(F.col("root").alias("a"), "b"), parents, "b").select("a", F.col("root").alias("b"))
        links = stored(rest.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        used.append(links)
    labels = stored(labels, "labels")
    discard(*used)
    return labels

"""Connected components of a link table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import discard, join_hot, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); the component is its smallest node.

    Each round writes its links to the shared folder, so lineage stays short and no row passes
    through the driver.  A node with very many links is no single task's work: the star steps
    aggregate its neighbours' minimum with map-side partial sums and join it back by `join_hot`.
    Self-links, repeated links and nulls are ignored; an empty table gives an empty result.
    """
    edges = materialize(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    while True:
        # Large star: every neighbour that is larger than a node links to the smallest around it.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_hot(both, low, ["u"], "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large-star")
        # Small star: the smaller neighbours of a node, and the node, link to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_hot(large, low, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        small = materialize(small.filter("u <> v").distinct(), "small-star")
        discard(large)
        changed = small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty()
        discard(edges)
        edges = small
        if changed:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()

"""Connected components of an edge table by repeated neighbourhood contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.scratch import table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the smallest node of its component.

    Large-star and small-star steps: every step keeps connectivity, and repeating both turns each component into a star
    around its smallest node in a logarithmic number of rounds.  A node's neighbours are never gathered in one row: a
    step groups to one minimum per node and joins it back, so a hub's rows can be split.  Each round is written to the
    shared folder.  Edges with a null end and loops are ignored; no edges give no rows.
    """
    links = table(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    before = None
    while True:
        # Large star: connect each node's larger neighbours to the smallest node among it and its neighbours.
        both = links.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(links.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
        links = both.where("m > n").join(least, "n").where("m <> least").select(F.col("m").alias("hi"), F.col("least").alias("lo")).distinct()
        # Small star: connect each node and its smaller neighbours to the smallest of them.
        least = links.groupBy("hi").agg(F.min("lo").alias("least"))
        links = (
            links.join(least, "hi").select(F.when(F.col("lo") == F.col("least"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("least").alias("lo"))
            .distinct()
        )
        links = table(links, "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())

"""Connected components over a distributed list of links, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.util import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b: long); component is the smallest node of its component.

    Each round, every node points to its smallest neighbour or itself, pointers are followed to their roots, and links
    are rewritten between roots. A node that is no root takes its root's place, so the nodes left are at most half as
    many after each round. Nodes with very many links are no burden: minima have map-side partial aggregation, and the
    join that rewrites links reads stored tables, which adaptive execution can split. Null ends are left out.
    """
    links = links.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(links)
    place = None
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        root = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        while True:
            up = root.select(F.col("node").alias("root"), F.col("root").alias("above"))
            root = stored(root.join(up, "root").select("node", "above", (F.col("above") != F.col("root")).alias("moved")))
            moved = root.filter("moved").limit(1).count()
            root = root.select("node", F.col("above").alias("root"))
            if not moved:
                break
        if place is None:
            place = root.withColumnRenamed("root", "component")
        else:
            step = root.select(F.col("node").alias("component"), F.col("root").alias("next"))
            place = place.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        place = stored(place)
        left = root.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = root.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = links.join(left, "a").join(right, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        links = stored(links)
        if not links.limit(1).count():
            return place

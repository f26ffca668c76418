"""Connected components by contraction; links, nodes and labels stay in distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node with a link and the smallest node that it reaches.

    Each round every node points to its smallest neighbour or itself, pointers are followed twice,
    links are renamed to where their ends point, and loops and repeats go. A node only ever points
    to a smaller one of its component and the smallest points to itself, so what is left of a
    component is its smallest node. Rounds are logarithmic; each is written to the shared folder,
    which cuts lineage, and lets joins on a node with very many links split that node's rows.
    Empty links give no rows; null ends and loops are dropped.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    live = links.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    live = store(live, light=True)
    named: DataFrame | None = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("__m"))
        up = store(up.select("node", F.least("node", "__m").alias("root")), light=True)
        jump = up.select(F.col("node").alias("root"), F.col("root").alias("__next"))
        up = store(up.join(jump, "root").select("node", F.col("__next").alias("root")), light=True)
        to = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"__{c}"))
        moved = live.join(to("a"), "a").join(to("b"), "b").select(F.col("__a").alias("x"), F.col("__b").alias("y"))
        after = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        old, live = live, store(after, light=True)
        discard(old)
        if named is None:
            named = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("__next"))
            named = store(named.join(step, "root", "left").select("node", F.coalesce("__next", "root").alias("root")), light=True)
    if named is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return named

"""Connected components of a table of links, by contraction.

In each round every node points at the neighbour that comes first in a pseudorandom order, if that comes before the
node itself; links are renamed by the pointers and loops go.  A node and the one it points at are linked, so renamed
links join the same components, and the random order lets a constant share of the nodes vanish a round, whatever the
links' shape.  Links and names are cut from their lineage each round, in the shared folder, and the tables of
the round before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import cut, dropped


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that its links reach), for each node of links (a, b).

    Links need not be distinct or both ways; those from a node to itself and those with a null end count for nothing.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = edges.select(F.col("a").alias("node")).distinct().withColumn("name", F.col("node"))
    turn = 0
    while not edges.isEmpty():
        order = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: E731, B023
        ahead = edges.groupBy("a").agg(F.min(F.struct(order("b").alias("h"), F.col("b").alias("b"))).alias("to"))
        ahead = ahead.select("a", F.when(F.col("to.h") < order("a"), F.col("to.b")).otherwise(F.col("a")).alias("p"))
        # a pointer's own pointer, one step on
        onward = ahead.alias("x").join(ahead.alias("y"), F.col("x.p") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.p").alias("p"))
        onward = cut(onward)
        old = names, edges, onward
        names = cut(names.join(onward, names["name"] == onward["a"], "left").select("node", F.coalesce("p", "name").alias("name")))
        by_a = edges.join(onward, "a").select(F.col("p").alias("a"), F.col("b"))
        both = by_a.join(onward.select(F.col("a").alias("b"), F.col("p").alias("q")), "b").select("a", F.col("q").alias("b"))
        edges = cut(both.where("a <> b").distinct())
        dropped(*old)
        turn += 1
    least = names.groupBy("name").agg(F.min("node").alias("component"))
    return names.join(least, "name").select("node", "component")

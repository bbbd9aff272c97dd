"""Connected components of an edge table, by alternating star contraction.

Each round joins the edges with their nodes' smallest neighbours; the edge
table is written to the shared folder after every half round. Nothing but
two counters per round comes to the driver. Partial minima are combined
before the shuffle, and are stored, so that the joins have plain shuffles on
both sides and Spark can split the rows of a node with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.session import store


def _smallest(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours in ``pairs`` (u, v)."""
    return store(pairs.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "minima")


def _large_star(e: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour to its larger neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_smallest(both), "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _smallest(down)
    moved = down.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(m.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component label of every node that has an edge.

    edges: two columns of one orderable type, (u, v) in any direction;
    repeated edges, loops and null ends are allowed (loops and nulls add
    nothing). Returns (node, component): ``component`` is the smallest node
    of the component; the smallest node itself is listed too. No edges give
    an empty table.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v")
    e = store(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        sign = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sign["n"] == 0 or sign == seen:
            break
        seen = sign
        e = store(_small_star(_large_star(e)), "edges")
    else:
        raise RuntimeError("components did not converge")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))

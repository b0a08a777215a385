"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrid.session import discard, materialize

#: A node with more than this share of all ends of links is a hub; there are at most as many hubs as shares in the whole.
HUBS = 1000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (long columns a, b); the component is its smallest node.

    Alternates two steps until nothing changes: every node links its larger
    neighbours to its smallest one, then its smaller neighbours. Both take the
    smallest neighbour with partial sums and join it back. The links of the at
    most ``HUBS`` nodes that have very many stay where they are and meet a
    broadcast row, so a hub's links are no group in one task. Each round is
    written to the shared folder, which cuts the lineage, and the round before
    removed. Nodes with null are no nodes; an empty input gives an empty result.
    """

    def star(links: DataFrame, most: int) -> DataFrame:
        least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hubs = F.broadcast(least.filter(F.col("n") > most).select("u", "m"))
        others = least.filter(F.col("n") <= most).select("u", "m")
        return links.join(hubs, "u").unionByName(links.join(hubs.select("u"), "u", "left_anti").join(others, "u"))

    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        said = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if said["n"] == 0 or said == state:
            found = materialize(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct()), "components")
            discard(now)
            return found
        state, most = said, max(2 * said["n"] // HUBS, 1000)
        both = now.union(now.select("v", "u"))
        large = materialize(star(both, most).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "links")
        met = star(large, most)
        small = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", "m"))
        last, now = now, materialize(small.distinct(), "links")
        discard(last, large)

"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.sources.shared_folder import stored


def _state(links: DataFrame) -> tuple:
    """Number of links and two sums of their hashes, to see whether a round changed anything."""
    h = F.xxhash64("a", "b")
    row = links.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1 << 31))), F.sum(F.shiftrightunsigned(h, 34))).first()
    return tuple(row)


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) of every node of ``links(a, b)``; the component is its smallest node.

    Alternates two rounds. Large star: every node ties its greater neighbours
    to the least node it knows. Small star: every node ties itself and its
    lesser neighbours to the least of them. Both keep the components; after
    about log(n) rounds every node is tied to its smallest one only. Each round
    is two shuffles of the links, with the minimum pre-aggregated, and is
    written to the shared folder; only three numbers reach the driver.
    """
    now = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a")
        small = small.select("a", F.col("least").alias("b")).union(
            small.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        )
        now = stored(small.distinct(), name)
        before, state = state, _state(now)
        if before == state:
            break
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(pairs.select("component", "component").distinct())

"""Connected components of a link table by alternating star contractions.

Every step replaces links by links to the smallest neighbour, which the engine
finds by a partially aggregated minimum and an equi-join (whose hot keys
adaptive execution splits); a node's neighbours are never gathered.  The number
of rounds grows with the logarithm of a component's diameter.  Each round is
written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialize


def _to_smallest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) with the smallest of a's neighbours and itself as ``low``, and (a, low) alone."""
    lows = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return links.join(lows, "a"), lows


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = materialize(links, "links")
    seen = None
    while True:
        # All neighbours larger than a node are linked to its smallest neighbour ...
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined, _ = _to_smallest(both)
        large = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large-star")
        # ... then a node and its smaller neighbours to the smallest of them.
        joined, lows = _to_smallest(large)
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            lows.select("a", F.col("low").alias("b"))
        )
        links = materialize(small.where("a <> b").distinct(), "small-star")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

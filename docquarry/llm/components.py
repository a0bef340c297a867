"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import discard, materialize


#: Links from which on what a round looks up is written before it is joined.
WIDE = 1 << 20


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v: long) to (node, root): the smallest node of each linked group, for all nodes in links.

    Each round hangs every node's larger neighbours on its smallest neighbour (large star), then its
    smaller ones (small star); groups become stars in a number of rounds that grows with the logarithm
    of their size. A round is two times an aggregation with map-side minima and an equi-join with its
    result. In wide tables that result is written first: the join then stands on plain exchanges and the
    adaptive skew join splits it at a hub. Edges are written to the shared folder, so lineage stays short.
    Null ends and loops are dropped; an empty table gives an empty table.
    """
    edges = materialize(
        links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "links",
    )
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        wide = state[0] > WIDE
        smallest = materialize(smallest, "links-smallest") if wide else smallest
        large = (
            both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = materialize(large, "links-large") if wide else large
        # After the large star every edge points from a node u down to v < u.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        lowest = materialize(lowest, "links-lowest") if wide else lowest
        small = large.join(lowest, "u")
        made = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        after = materialize(made.where("u <> v").distinct(), "links")
        now = _state(after)
        discard(edges, *((smallest, large, lowest) if wide else ()))
        edges, settled = after, now == state
        if settled:
            break
        state = now
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

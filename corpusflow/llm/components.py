"""Connected components of a link table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.lineage import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of all nodes of ``links``.

    Alternates two contractions until nothing changes: every node hangs its larger neighbours
    on its smallest one, then its smaller neighbours. The rounds grow with the logarithm of
    the longest chain. No node's neighbours are gathered: a minimum per node is aggregated and
    joined back. Both sides of that join are shuffled tables, so a node with very many links
    is split by adaptive execution. Lineage is cut in the shared checkpoint folder.

    Links from a node to itself and with a null end count as none.
    """
    edges = cut_lineage(
        links.select(
            F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
        )
        .where((F.col(a) != F.col(b)))
        .distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut_lineage(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        )
        # Larger neighbours of u hang on the smallest of its neighbourhood.
        large = cut_lineage(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct()
        )
        low = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(low, "u")
        # Smaller neighbours of u, and u itself, hang on the smallest of them.
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = cut_lineage(
            small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number and digest of the edges, in any order."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")
    ).first()
    return row["n"], row["x"] or 0

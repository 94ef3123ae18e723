"""Connected components as a sequence of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import HOT, materialise, remove


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _hubs(edges: DataFrame, n: int) -> list[int]:
    """Nodes that more than one in HOT of the links' ends are, fewer than HOT."""
    rows = _both(edges).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") * HOT > 2 * n).select("u").collect()
    return sorted(r["u"] for r in rows)


def _large_star(edges: DataFrame, hubs: list[int]) -> DataFrame:
    """Each node's greater neighbours linked to the least of the node and its neighbours. Hubs' links stay where they are and meet the hubs' least, which are broadcast."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = both.where("v > u")
    if not hubs:
        met = up.join(least, "u")
    else:
        hub = F.col("u").isin(hubs)
        met = up.where(~hub).join(least.where(~hub), "u").unionByName(up.where(hub).join(F.broadcast(least.where(hub)), "u"))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v): undirected links between long ids. Returns (node, root) for every linked node, root the least id of its component.

    Alternating large-star and small-star rounds; a round keeps at most one row for each edge it gets, so a component
    never gathers in one task, and each round's edges are written to the shared folder, which cuts the lineage. Rounds go on
    until one changes nothing; there are about as many as the logarithm of the longest path. Self links and nulls link
    nothing; no edges give no rows.
    """
    spark = edges.sparkSession
    now = materialise(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = _signature(now)
    while seen[0]:
        before = now.inputFiles()[0].rsplit("/", 1)[0]
        now = materialise(_small_star(_large_star(now, _hubs(now, seen[0]))), "edges")
        after = _signature(now)
        remove(spark, before)
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

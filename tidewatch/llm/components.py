"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Workspace, lookup

#: Neighbours of a node that one task takes; nodes with more are dealt to several.
HUB = 20_000


def _star(edges: DataFrame, large: bool, work: Workspace, name: str, hub: int) -> DataFrame:
    """One step over rows (u, v), v < u.

    Large star: every neighbour above u is linked to u's least neighbour (or u itself).
    Small star: u and its lower neighbours are linked to the least of them.
    Only minima and degrees are aggregated, with map-side combine.  Nodes of more than
    ``hub`` neighbours, and no others, are dealt to as many tasks as that takes.
    """
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.unionByName(turned) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.ceil(F.count("*") / F.lit(hub)).cast("int").alias("parts"))
    least = work.save(least.select("u", F.least("u", "m").alias("m"), "parts"), name)
    hubs = least.where("parts > 1").select("u", "parts")
    if hubs.isEmpty():
        joined = near.join(least.drop("parts"), "u")
    else:
        dealt = lookup(near, hubs, ["u"], ["v"]).withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        copies = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        joined = dealt.join(copies, ["u", "part"]).drop("part")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, work: Workspace, rounds: int = 60, hub: int = HUB) -> DataFrame:
    """(node, component) for every node that has an edge; component is its least reachable node.

    ``edges``: columns a, b (long), any order, repeats and self links allowed; nulls are
    ignored.  Each round is written to the shared folder; the loop ends when a round
    changes nothing (checksum and count of the edges), which is the star form.
    An empty table gives an empty table.  Not converged within ``rounds``: an error.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = work.save(now, "edges0"), None
    for k in range(1, rounds + 1):
        tell = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tell[0] == 0 or tuple(tell) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = tuple(tell)
        half = work.save(_star(now, True, work, f"large{k}", hub), f"half{k}")
        now = work.save(_star(half, False, work, f"small{k}", hub), f"edges{k}")
        for name in (f"large{k}", f"small{k}", f"half{k}", f"edges{k - 1}"):
            work.drop(name)
    raise RuntimeError(f"components did not settle in {rounds} rounds")

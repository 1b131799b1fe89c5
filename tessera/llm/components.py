"""Connected components by alternating star contraction, on joins and pre-aggregated minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written


#: Vertices with over one in so many of the edges' ends are hubs; there are fewer of them than this.
HUBS = 1000


def _with_least(edges: DataFrame, least: DataFrame, ends: int, hubs: int) -> DataFrame:
    """(v, m) of edges (u, v), m from `least` (u, m, n), n adding up to `ends`. Hubs are sent to every task, so their
    edges stay where they are; the others meet their minimum by u."""
    heavy = least.filter(F.col("n") * hubs > ends)
    by_hub = edges.join(F.broadcast(heavy.select("u", "m")), "u")
    rest = edges.join(F.broadcast(heavy.select("u")), "u", "left_anti").join(least.select("u", "m"), "u")
    return by_hub.select("v", "m").union(rest.select("v", "m"))


def _larger(edges: DataFrame, many: int, hubs: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.filter("v > u"), least, 2 * many, hubs).toDF("u", "v")


def _smaller(edges: DataFrame, many: int, hubs: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    rest = _with_least(down, least, many, hubs).filter("v != m").toDF("u", "v")
    return rest.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60, hubs: int = HUBS) -> DataFrame:
    """(id, component) for every vertex of `edges` (a, b) that is not the smallest of its component.

    Loops and repeated edges do no harm; an empty table gives an empty result. A hub with any number of
    neighbours is never gathered: its minimum is aggregated partially and goes to its edges.
    """
    now = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v").distinct()
    now = written(now, "edges")
    many, before = now.count(), None
    for _ in range(rounds):
        now = written(_smaller(_larger(now, many, hubs), many, hubs).filter("u != v").distinct(), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        many, before = state[0], state
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))

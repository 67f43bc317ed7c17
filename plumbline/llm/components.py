"""Connected components of a links table, by contraction in rounds.

Each task joins its share of the links into trees and gives every vertex the least vertex it reaches there. A vertex with one
root over all tasks is settled; roots that meet in a vertex become links of the next round's smaller graph. Where that doesn't
halve the links (long chains, dealt at random), vertices are mated instead: by a bit of a hash that changes with the round, a
vertex without the bit joins its least neighbour with it, which takes a quarter of the vertices away in expectation. Nothing is
collected, and no task's share grows: a round is a map over links and aggregations and joins over vertices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table

#: Links a task joins.
LINKS = 500_000


def roots(pairs: Iterator[tuple]) -> dict:
    """Vertex -> least vertex of its tree."""
    up: dict = {}

    def find(v):
        top = v
        while up[top] != top:
            top = up[top]
        while up[v] != top:
            up[v], v = top, up[v]
        return top

    for a, b in pairs:
        up.setdefault(a, a)
        up.setdefault(b, b)
        x, y = find(a), find(b)
        if x < y:
            up[y] = x
        elif y < x:
            up[x] = y
    return {v: find(v) for v in up}


def forest(links: DataFrame, tasks: int) -> DataFrame:
    ship(links.sparkSession)
    kind = dict(links.dtypes)["a"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = roots(p for b in batches for p in zip(b["a"].tolist(), b["b"].tolist(), strict=True))
        yield pd.DataFrame({"v": list(r.keys()), "r": list(r.values())})

    return links.select("a", "b").coalesce(tasks).mapInPandas(run, f"v {kind}, r {kind}")


def mated(links: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """(links of the contracted graph, joins as u, into): one round of mating."""
    bit = lambda c: F.xxhash64(F.lit(number), F.col(c)).bitwiseAND(F.lit(1))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joins = table(both.filter((bit("a") == 0) & (bit("b") == 1)).groupBy(F.col("a").alias("u")).agg(F.min("b").alias("into")), "mates")
    for end in "ab":
        links = links.join(joins, F.col(end) == F.col("u"), "left").withColumn(end, F.coalesce("into", end)).select("a", "b")
    return table(links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "mated-links"), joins


def labels(links: DataFrame, most: int, number: int = 0) -> DataFrame:
    """(v, r): one and the same vertex for all of a component."""
    n = links.count()
    tasks = max(1, -(-n // most))
    f = table(forest(links, tasks), "forest")
    if tasks == 1:
        return f
    per = f.groupBy("v").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    meet = table(f.join(per.filter("lo <> hi"), "v").filter("r <> lo").select(F.col("lo").alias("a"), F.col("r").alias("b")).distinct(), "meeting-roots")
    found = per.select("v", F.col("lo").alias("r"))
    left = meet.count()
    if not left:
        return found
    if left * 2 <= n:
        up = labels(meet, most, number + 1)
    else:
        fewer, joins = mated(meet, number)
        rest = labels(fewer, most, number + 1).select(F.col("v").alias("x"), F.col("r").alias("y"))
        # those that joined another have its label; the others their own, or themselves if no link is left to them
        ends = meet.select(F.col("a").alias("v")).unionByName(meet.select(F.col("b").alias("v"))).distinct()
        up = ends.join(joins, F.col("v") == F.col("u"), "left").select("v", F.coalesce("into", "v").alias("z"))
        up = up.join(rest, F.col("z") == F.col("x"), "left").select("v", F.coalesce("y", "z").alias("r"))
    up = up.select(F.col("v").alias("p"), F.col("r").alias("q"))
    return table(found.join(up, F.col("r") == F.col("p"), "left").select("v", F.coalesce("q", "r").alias("r")), "labels")


def components(links: DataFrame, most: int = LINKS) -> DataFrame:
    """(v, component): the least vertex reachable, for every vertex of `links` (a, b)."""
    found = labels(links, most)
    least = found.groupBy(F.col("r").alias("s")).agg(F.min("v").alias("component"))
    return found.join(least, F.col("r") == F.col("s")).select("v", "component")

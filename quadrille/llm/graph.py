"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch

#: A key is hot when it has more than this share of the rows; fewer than its inverse are.
HOT_SHARE = 1 / 1000


def with_value(rows: DataFrame, values: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined to values (a row for each key of it, with the key's number of rows in size). Rows of hot keys stay where
    they are and meet their values by a broadcast of fewer than 1 / HOT_SHARE rows; the others are shuffled, so no task
    gets more of one key than that share. Where values are an aggregate, its exchange is planned once and used again."""
    hot = F.broadcast(values.where(F.col(size) > HOT_SHARE * total))
    rest = rows.join(hot.select(key), key, "left_anti").join(values.where(F.col(size) <= HOT_SHARE * total), key)
    return rows.join(hot, key).unionByName(rest)


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
    return tuple(r)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, comp) of every node of the edges (u, v): comp is the least node that it is linked to.

    Each step gives every node an edge to the least node near it. Edges never outnumber nodes plus the edges given;
    each step's tables lie in the shared folder until the search ends. The edges of a hub aren't gathered: its
    least neighbor comes from partial minima, and goes to them as with_value() says."""
    with scratch() as put:
        edges = put(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        before = _state(edges)
        for _ in range(most if before[0] else 0):
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
            large = with_value(both, least, "u", "n", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = put(large.distinct(), "large")
            least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            small = with_value(large, least, "u", "n", 2 * before[0])
            small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
            edges = put(small.where("u <> v").distinct(), "edges")
            after = _state(edges)
            if after == before:
                break
            before = after
        else:
            if before[0]:
                raise RuntimeError(f"components aren't settled after {most} steps")
        return materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select("v", "v").distinct()), "components")

"""Connected components by alternating large and small stars, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import discard, join_hot, written

_BUCKETS = 4096


def _state(edges: DataFrame) -> tuple:
    """Number of edges, two checksums of them, and a bound of the rows of any node: those of the fullest of _BUCKETS."""
    end = F.explode(F.array(F.struct(F.col("a").alias("of"), F.lit(1).alias("own")), F.struct(F.col("b").alias("of"), F.lit(0).alias("own"))))
    ends = edges.select("a", "b", end.alias("e"))
    own = lambda c: F.when(F.col("e.own") == 1, c)
    by = ends.groupBy(F.pmod(F.xxhash64("e.of"), F.lit(_BUCKETS)).alias("k")).agg(F.count("*").alias("n"), F.count(own(F.lit(1))).alias("m"), F.bit_xor(own(F.xxhash64("a", "b"))).alias("x"), F.sum(own(F.hash("a", "b").cast("long"))).alias("s"))
    return tuple(by.agg(F.sum("m"), F.bit_xor("x"), F.sum("s"), F.max("n")).first())


def _with_least(rows: DataFrame, least: DataFrame, total: int, most: int) -> DataFrame:
    """``rows`` with the least neighbour of a; hubs, if there may be any, are handled apart."""
    if most > max(common.HOT_ROWS, total // common.HOT_KEYS):
        return join_hot(rows, least, ["a"], total)
    return rows.join(least.drop("n"), "a")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); component is the smallest node reachable.

    Null ends, loops and repeated edges change nothing; no edges give no rows.
    Each round joins a node's neighbours to the least of them, those of hubs by
    broadcasting the hubs. The number of rounds grows with the logarithm of the
    longest chain; each ends in a table in the shared folder, and the last one stays.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e)
    state = _state(e)
    while state[0]:
        total, most = 2 * state[0], state[3]
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _with_least(both.where("b > a"), least, total, most).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        moved = _with_least(large, least, total, most).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, written(moved.union(least.select("a", F.col("m").alias("b"))).distinct())
        discard(old)
        before, state = state, _state(e)
        if state[:3] == before[:3]:
            break
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

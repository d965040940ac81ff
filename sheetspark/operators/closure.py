"""Connected components of a link table by alternating large-star and small-star steps; nothing reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, keep


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``edges(a, b)`` of comparable ids; returns ``(node, component)`` with the smallest reachable id, for every node
    that has an edge. Each round is written to the shared folder, so a lost executor costs one round at most.
    Nulls and self-loops are ignored; an empty table gives an empty table."""
    now = keep(_oriented(edges), "edges")
    state = None
    for _ in range(max_rounds):
        after = keep(_small_star(_large_star(now)), "edges")
        discard(now)
        now, before, state = after, state, _state(after)
        if state == before or not state[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1)))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("m"))  # every smaller neighbour is a row here
    joined = both.where("b > a").join(least.hint("merge"), "a", "left")
    return joined.select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

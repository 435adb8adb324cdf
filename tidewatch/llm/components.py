"""Connected components of an edge table: small graphs by the driver, others by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, stash

MOST_HELD = 1 << 18  # edges that the driver holds, 16 bytes each: a round of joins costs it more than these


def _plain(edges: DataFrame) -> DataFrame:
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct()
    return stash(e, "edges")


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges, and the smallest node of the component of each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:  # each round at least halves the roots of a component that has several
        least = np.minimum(root[a], root[b])
        lower = root.copy()
        np.minimum.at(lower, root[a], least)
        np.minimum.at(lower, root[b], least)
        while not np.array_equal(lower, lower[lower]):
            lower = lower[lower]
        if np.array_equal(lower, root):
            return nodes, nodes[root]
        root = lower


def components(edges: DataFrame, held: int = MOST_HELD) -> DataFrame:
    """As ``connected_components``; up to ``held`` distinct edges are joined by the driver, in one job and not several a round."""
    e = _plain(edges)
    n = e.count()
    if n > held:
        return _by_stars(e, 60)
    if not n:
        return e
    got = e.toArrow()
    u, v = least_nodes(got["u"].to_numpy(), got["v"].to_numpy())
    del got
    out = e.sparkSession.createDataFrame(pa.table({"u": u, "v": v}), schema=e.schema)
    give_back()
    return out


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(u, v): every node of ``edges`` (u, v) with the smallest node of its component, itself included if it is that.

    Each step groups by node with pre-aggregation and writes its edges to the shared folder; a node's neighbours never meet in
    one task. Ends when a round changes nothing, after a number of rounds that grows with the logarithm of the input; if
    ``most`` rounds don't suffice it raises, as its edges would then split components.
    """
    return _by_stars(_plain(edges), most)


def _by_stars(e: DataFrame, most: int) -> DataFrame:
    before = _mark(e)
    for _ in range(most):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stash(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {most} rounds")
    roots = e.select(F.col("v").alias("u")).distinct()
    return e.unionByName(roots.withColumn("v", F.col("u")))

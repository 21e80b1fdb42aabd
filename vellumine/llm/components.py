"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its group) that join what the links a-b join.

    A task that has found m nodes linked to each other sends m - 1 links on, not m * m.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node in a link; root is the smallest node that links reach.

    Null ends and links of a node to itself are ignored; an empty table gives no rows. Each
    round aggregates minima before it shuffles, joins them back (a hub's rows are split by
    adaptive execution) and is written to the shared folder, so a lost executor costs one
    round. Rounds grow with the logarithm of the longest chain.
    """
    edges = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links"
    )
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written, so that joins have exchanges of their own, whose hubs can be split
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large.where("u > v"), "large-star")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        pairs = large.join(low, "u")
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = pairs.select(F.explode(ends).alias("e"))
        small = cut(small.select("e.u", "e.v").where("u > v").distinct(), "small-star")
        then, now = (
            x.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first() for x in (edges, small)
        )
        edges = small
        if then == now:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.llm.common import attach, total_of
from curbline.session import cut

#: Links that one task takes at most, when no more are left.
LAST = 1 << 12


def _last(edges: DataFrame) -> DataFrame:
    """``node, to`` of at most LAST links: the smallest node that each reaches, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.column_stack([batch.column(c).to_numpy() for c in "ab"]) for batch in batches]
        node, at = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *ends]), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        to, before = np.arange(len(node)), None
        while before is None or (to != before).any():
            before = to.copy()
            least = np.minimum(to[a], to[b])
            for end in (a, b):
                np.minimum.at(to, to[end], least)  # the whole group of the larger end moves
                np.minimum.at(to, end, least)
            to = to[to]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[to])], names=["node", "to"])

    return edges.coalesce(1).mapInArrow(run, "node bigint, to bigint")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node it reaches) of every node of the links ``a, b`` (longs).

    Each round every node moves to its smallest neighbour, and the links between
    what is left are kept, once each. A star, however large, takes one round: its
    links meet by partial aggregation, and its centre is a hot key of ``attach``.
    Nodes should be hashes: their order is then random and about half go each round.
    The last LAST links are followed to their ends by one task: a round is half a dozen
    jobs, whose plans and threads cost the driver the same however few links are left.
    """
    edges = cut(links.where("a <> b").select("a", "b").distinct())
    moved = []
    while n_links := edges.count():
        if n_links <= LAST:
            moved.append(cut(_last(edges)))
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(
            both.groupBy("a").agg(F.min("b").alias("to"), F.count("*").alias("n"))
            .select(F.col("a").alias("node"), F.least("a", "to").alias("to"), "n")
        )
        total = total_of(step, "n")
        moved.append(step.select("node", "to"))
        ends = step.select("node", "n", F.col("to").alias("to_a"))
        left = attach(edges, ends.withColumnRenamed("node", "a"), "a", "n", total, ["a", "b"]).drop("n")
        right = attach(left, ends.select(F.col("node").alias("b"), "n", F.col("to_a").alias("to_b")), "b", "n", total, ["a", "b"])
        # A node's link to the place it moved to goes on as the link from there to where that one moved.
        again = right.select(F.col("to_a").alias("x"), F.col("to_b").alias("y")).where("x <> y")
        edges = cut(again.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not moved:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # Follow the moves from the last round back to the first.
    place = moved[-1].select("node", F.col("to").alias("component"))
    for step in reversed(moved[:-1]):
        sizes = step.groupBy("to").agg(F.count("*").alias("n"))
        ends = cut(sizes.join(place, sizes["to"] == place["node"], "left").select("to", "n", F.coalesce("component", "to").alias("component")))
        place = attach(step, ends, "to", "n", total_of(ends, "n"), ["node"]).select("node", "component")
    return cut(place) if len(moved) > 1 else place

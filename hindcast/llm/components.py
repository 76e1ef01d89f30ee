"""Connected components of a link table: blocks of links are contracted inside tasks, then alternating star
contractions join the blocks. No link leaves the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import stage

#: Contractions before the loop fails loudly; the number needed grows with the logarithm of the links.
MOST_ROUNDS = 60
#: Links that a task contracts at once.
BLOCK = 500_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that is not the least of its component among these links, and that least node."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            other = np.flatnonzero(label != np.arange(len(ids)))
            return ids[other], ids[label[other]]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch[0].to_numpy()]), np.concatenate([b, batch[1].to_numpy()])
        if len(a) > BLOCK:
            nodes, least = contracted(a, b)
            if 2 * len(nodes) > len(a):  # hardly smaller: hand on what there is
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["a", "b"])
                nodes, least = nodes[:0], least[:0]
            a, b = nodes, least
    nodes, least = contracted(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point every larger (``large``) or smaller neighbour of each node at the least node around it.

    Least nodes are aggregated before the shuffle and written, so that the join of a node with very many
    links is one that Spark can split.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    joined = both.join(least, "u")
    if large:
        pairs = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        pairs = joined.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return stage(pairs.where("a <> b").distinct())


def components(links: DataFrame) -> DataFrame:
    """``node`` and its ``component``, the least node reachable, for every node that is not the least itself.

    ``links`` has integer columns ``a`` and ``b``; direction, repetition and self-links do not matter. Ends
    when every node points at its least one.
    """
    edges = stage(links.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    n_blocks = edges.count() // BLOCK + 1
    edges = stage(edges.coalesce(n_blocks).mapInArrow(_block, "a long, b long"))
    if n_blocks == 1:  # one block knows all links
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state(edges)
    for _ in range(MOST_ROUNDS):
        edges = _star(_star(edges, large=True), large=False)
        now = state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
    raise RuntimeError("components did not settle")

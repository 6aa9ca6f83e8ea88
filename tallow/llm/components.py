"""Connected components of a large graph with joins and groupings; hot nodes are salted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.common import stage, unstage

SALTS = 8
HELD = 1_000_000


def local_forest(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars: (node, smallest node it reaches among HELD edges of the partition)."""

    def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        label = np.arange(len(node))
        while True:
            # The smaller label of an edge's ends goes to the labels of both, then labels jump.
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for end in (label[a], label[b], a, b):
                np.minimum.at(new, end, low)
            while (jump := new[new]).tobytes() != new.tobytes():
                new = jump
            if (new == label).all():
                far = label != np.arange(len(node))
                return node[far], node[label[far]]
            label = new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += b.num_rows
            if size > HELD:
                held = [stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                if len(held[0][0]) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["u", "v"])
                size = sum(len(x) for x, _ in held)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate(x) for x in zip(*held, strict=True)))], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u long, v long): component is its smallest reachable node.

    Labels start at the smallest neighbour, go along the edges and jump to the label of the label,
    until none changes: a number of rounds near the logarithm of the longest path. Each round's labels
    are a written table. A node with many edges meets its label in SALTS tasks.
    """
    # Edges fall to stars within partitions first: as they come, then dealt by the larger end, so that what a star's leaves share is seen.
    forest = stage(local_forest(local_forest(edges.where("u <> v")).repartition("u")), "cc-forest")
    both = forest.union(forest.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = stage(both.distinct().withColumn("salt", F.pmod(F.xxhash64("u", "v"), F.lit(SALTS)).cast("int")), "cc-edges")
    unstage(forest)
    labels = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "cc-labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == total:
            unstage(both)
            return labels
        total = now
        salted = labels.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        told = both.join(salted, (both["v"] == salted["node"]) & (both["salt"] == salted["salt"])).select(F.col("u").alias("node"), "component")
        least = stage(labels.unionByName(told).groupBy("node").agg(F.min("component").alias("component")), "cc-least")
        unstage(labels)
        up = least.select(F.col("node").alias("parent"), F.col("component").alias("jump"))
        # Many nodes share a parent, so the parent's own label is dealt out by salt as well.
        up = up.join(least.select(F.col("component").alias("parent")).distinct(), "parent").withColumn("s", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        child = least.withColumn("s", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        jumped = child.join(up, (child["component"] == up["parent"]) & (child["s"] == up["s"]), "left")
        labels = stage(jumped.select("node", F.coalesce("jump", "component").alias("component")), "cc-labels")
        unstage(least)

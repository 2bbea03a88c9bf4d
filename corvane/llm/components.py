"""Connected components of an edge table, without any collect: large-star / small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.cluster import ship_package, written


def min_labels(n: int, i: np.ndarray, j: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """For n nodes the smallest node index reachable over the edges (i, j); `labels` continues an earlier result."""
    lab = np.arange(n) if labels is None else labels
    while len(i):
        a, b = lab[i], lab[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := lab[lab], lab):
            lab = up
    return lab


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each batch's edges by (node, smallest node of its tree): never more rows, mostly far fewer."""
    for batch in batches:
        ends = np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        if not len(ends):
            continue
        nodes, at = np.unique(ends, return_inverse=True)
        half = len(at) // 2
        root = min_labels(len(nodes), at[:half], at[half:])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["u", "v"])


def _least(edges: DataFrame) -> DataFrame:
    """For each larger end its smallest neighbour among the smaller ones. Written, so that what joins it is two plain
    shuffles: adaptive execution can then split the partition of a node that many edges end in."""
    return written(edges.sparkSession, edges.groupBy("u").agg(F.min("v").alias("m")), "components-least")


def _round(edges: DataFrame) -> DataFrame:
    """A large star, then a small star, over edges u > v.

    Large star: every larger neighbour u of v is tied to the smallest node next to v, v itself included. That node can
    only come from edges in which v is the larger end, so v's many larger neighbours need not be gathered. Small star:
    the smaller neighbours of u are tied to the smallest of them, and so is u.
    """
    least = _least(edges).select(F.col("u").alias("v"), "m")
    large = written(edges.sparkSession, edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "components-large")
    least = _least(large)
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge: component is the smallest node id reachable.

    Repeated edges and self-loops are harmless (a node with only a self-loop does not appear); edges with a null end are
    ignored. Each round is written to the shared folder, so a lost executor costs one round.
    """
    spark = edges.sparkSession
    ship_package(spark)
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = written(spark, e.mapInArrow(_forest, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = mark(e)
    while before[0]:
        e = written(spark, _round(e), "components")
        now = mark(e)
        if now == before:
            break
        before = now
    own = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)

"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut

#: Edges that one task holds at once.
HELD = 1 << 21


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the least node of each one's component."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(names))
    while len(a):
        # Roots hang on the least root that an edge leads to, then all nodes on their roots.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return names, names[root]


def _stars(held: int, whole: bool):
    """Edges (a, b) become stars that connect the same; with ``whole`` a row for each node, roots too. So many edges at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def met() -> tuple[np.ndarray, np.ndarray]:
            return roots(*(np.concatenate(x) for x in zip(*parts, strict=True)))

        def out(nodes: np.ndarray, tops: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(nodes), 1 << 16):
                yield pa.record_batch([pa.array(nodes[lo : lo + (1 << 16)]), pa.array(tops[lo : lo + (1 << 16)])], ["node", "root"] if whole else ["a", "b"])

        for batch in batches:
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > held and not whole:
                nodes, tops = met()
                yield from out(nodes[nodes != tops], tops[nodes != tops])
                parts, size = [], 0
        if parts:
            nodes, tops = met()
            some = np.ones(len(nodes), bool) if whole else nodes != tops
            yield from out(nodes[some], tops[some])

    return run


def components(edges: DataFrame, held: int = HELD) -> DataFrame:
    """edges: (a, b) of one comparable type. Returns (node, root), root being the least node of its component.

    Edges of whole numbers are first reduced, each partition to stars that connect the same, then, if at most ``held`` are
    left, joined up in one task. More, and other types: large-star and small-star steps in turn (Kiveris et al. 2014) until a
    step changes nothing; each halves distances, so the number of rounds grows with the logarithm of a component's length. A
    node's neighbours are only reduced to their least, and joined to it again, never gathered. Self-loops are ignored.
    """
    edges = edges.select("a", "b").where("a <> b")
    kind = edges.dtypes[0][1]
    if kind in ("int", "bigint"):
        edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_stars(held, False), "a long, b long")
        edges = cut(edges)
        if edges.count() <= held:
            named = edges.coalesce(1).mapInArrow(_stars(held, True), "node long, root long")
            return named.select(F.col("node").cast(kind), F.col("root").cast(kind))
        edges = edges.select(F.col("a").cast(kind), F.col("b").cast(kind))
    now = cut(edges.distinct())
    marks = _marks(now)
    while True:
        # Large star: each node's larger neighbours go to its least neighbour or itself.
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least"))
        least = least.select("u", F.least("u", "least").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: each node's smaller neighbours and itself go to the least of them.
        large = cut(large)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        found = _marks(after)
        now = after
        if found == marks:
            break
        marks = found
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _marks(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)

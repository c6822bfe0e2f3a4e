"""Connected components of a link table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyproof.llm.staging import staged

MAX_ROUNDS = 60


def forest(pairs) -> dict[int, int]:
    """Node to smallest node of its tree, for nodes other than the smallest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while top in root:
            top = root[top]
        while x != top:
            root[x], x = top, root[x]
        return top

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _local(batches):
    """Links of a task as stars around the smallest node of each tree: at most one row per node."""
    held = forest(p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    nodes = list(held)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([held[x] for x in part], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node of its component.

    Links point from the larger node to the smaller one. In each round a link to a node that points further on is moved there,
    links are dealt by their larger node, and what meets in a task is made stars around its smallest node. A node that many
    others point to is never gathered: links are dealt by the node they start from, and adaptive execution can split the join.
    One table is written per round.
    """
    shape = "a bigint, b bigint"
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").mapInArrow(_local, shape)
    before = None
    for _ in range(MAX_ROUNDS):
        seen = Observation()
        stars = edges.repartition("a").mapInArrow(_local, shape)
        edges = staged(stars.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "links")
        if seen.get == before:
            break
        before = seen.get
        further = edges.select(F.col("a").alias("b"), F.col("b").alias("next"))
        edges = edges.join(further, "b", "left").select("a", F.coalesce("next", "b").alias("b"))
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())

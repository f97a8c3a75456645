"""Connected components on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import discard, materialize

#: Edges that one task may hold (some 300 MB of Python at most); more go through rounds of stars.
ALONE = 1_000_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of a partition's own edges: each node with its class's least node."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = find(up.setdefault(u, u)), find(up.setdefault(v, v))
            if a != c:
                up[max(a, c)] = min(a, c)
    nodes = list(up)
    for k in range(0, len(nodes), 50_000):
        own = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([find(x) for x in own], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", alone: int = ALONE) -> DataFrame:
    """``node, component`` for every node of an edge; the component is its least node.

    At most ``alone`` edges are united in one task.  Beyond that, alternating stars of larger and of lesser neighbours:
    each round joins edges with one minimum a node, so no neighbourhood is gathered in a task, and the rounds grow with
    the logarithm of the node count; as soon as few enough edges are left, one task ends it.  Null ends are ignored; a
    node whose edges all lead to itself is in no class.
    """
    now = materialize(edges.select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v")).where("u <> v").distinct(), "edges")
    known = None
    while True:
        count = now.count()
        if count <= alone:
            return materialize(now.coalesce(1).mapInArrow(_united, "node long, component long"), "components")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        upper = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = upper.groupBy("u").agg(F.min("v").alias("m"))
        lower = upper.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = materialize(lower.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        discard(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == known:
            break
        known = state
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

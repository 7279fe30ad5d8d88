"""Connected components of an edge table by contraction inside tasks and alternating large-star and small-star steps.

Every task contracts the edges that it holds, ``EDGES`` at most on average: a node is left with one edge, to the smallest
node that it reaches there. Where one task saw all that is left, that is the answer. Otherwise a round of star steps
brings the edges of a node together; each step is a grouped minimum and a join. Edges stay distributed, and each round
is written to the shared folder, so that plans stay short and lost executors recompute one round. A hub with many
neighbours meets its edges in one task's merge, which Spark splits where it is large.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise

#: Edges a task contracts at once, on average.
EDGES = 1 << 17


def _state(edges: DataFrame) -> tuple:
    row = edges.filter("a <> b").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(row)


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """(a, b) with each node of a task's edges once: the node and the smallest node that it reaches in them, maybe itself."""
    def run(batches):
        above: dict[int, int] = {}

        def top(node: int) -> int:
            up = above.setdefault(node, node)
            while up != node:
                above[node] = above[up]
                node, up = above[node], above[above[node]]
            return node

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = top(a), top(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
        nodes = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(n) for n in nodes], pa.int64())], ["a", "b"])

    return edges.select("a", "b").coalesce(tasks).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, edges_per_task: int = EDGES) -> DataFrame:
    """(a, b) long edges -> (node, component), written: the smallest node reachable. Nodes without edges do not appear."""
    edges = materialise(edges.filter(F.col("a") != F.col("b")).select(F.col("a").cast("long"), F.col("b").cast("long")), "edges")
    left, before = edges.count(), None
    while True:
        tasks = max(1, -(-left // edges_per_task))
        held, edges = edges, materialise(contracted(edges, tasks), "edges")
        discard(held)
        if tasks == 1:
            break
        now = _state(edges)
        if now == before:
            held, edges = edges, materialise(edges.distinct(), "edges")  # a component's own row comes from several tasks
            discard(held)
            break
        left, before = now[0], now
        apart = edges.filter("a <> b")
        both = apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large.filter(F.col("a") != F.col("b")), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = materialise(small.filter(F.col("a") != F.col("b")).distinct(), "edges")
        discard(edges, large)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))

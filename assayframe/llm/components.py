"""Connected components of a large edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm._spark import saved


BOUNDED = 50_000  # edges that one task may join up


def joined(edges: DataFrame) -> DataFrame:
    """node and root of a table of at most BOUNDED edges, in one task."""

    def run(batches):
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        found = [(x, find(x)) for x in list(root)]
        found = [r for r in found if r[0] != r[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.int64())], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, bounded: int = BOUNDED) -> DataFrame:
    """node and root (the smallest node it reaches) of ``edges(a, b)``.

    Alternating large-star and small-star steps; every step is one aggregation
    and one join over the edges, written to the shared folder, so neither a hot
    node nor a long chain gathers anywhere.  A table of at most ``bounded``
    edges is done in one task instead.  Nodes without edges are not listed.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = lambda: now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    last = size()
    if last[0] <= bounded:
        return joined(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # each larger neighbour is tied to the least of the neighbourhood
        now = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = now.groupBy("a").agg(F.min("b").alias("m"))
        tied = now.join(low, "a")
        now = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(tied.select("a", F.col("m").alias("b")))
        now = saved(now.distinct())
        state = size()
        if state == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = state

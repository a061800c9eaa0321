"""Connected components of an edge table, by alternating stars.

Every partition first replaces its edges by a spanning forest. Then, in turn, each
node links its larger neighbours to the smallest node it sees, and its smaller
neighbours likewise, until nothing changes: every edge then leads to the smallest
node of its component. Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thingroups.llm.common import map_batches, stored


class Forest:
    """Union-find with the smallest member as the root."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        path = []
        while (up := self.parent.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.parent[p] = x
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def forest(edges: DataFrame) -> DataFrame:
    """Edges with the same components, fewer than nodes in each partition."""

    def work(batches: Iterator[list[list]]) -> Iterator[dict]:
        seen = Forest()
        for left, right in batches:
            for a, b in zip(left, right, strict=True):
                if a is not None and b is not None:
                    seen.join(a, b)
        nodes = [x for x in seen.parent if seen.root(x) != x]
        for i in range(0, len(nodes), 10_000):
            part = nodes[i : i + 10_000]
            yield {"a": part, "b": [seen.root(x) for x in part]}

    kind = edges.schema["a"].dataType.simpleString()
    return map_batches(edges, ["a", "b"], work, f"a {kind}, b {kind}")


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each node's larger (or else smaller) neighbours to the smallest node it sees.
    Edges come as (a, b) with a > b and leave the same way."""
    if larger:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    linked = edges.join(least, "a")
    if larger:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        own = least.select("a", F.col("least").alias("b"))
        out = linked.select(F.col("b").alias("a"), F.col("least").alias("b")).where(F.col("a") > F.col("b")).unionByName(own)
    return out.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node that has an edge."""
    edges = stored(forest(edges), "forest")
    before = None
    while True:
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")
        ).first()
        if now == before or now[0] == 0:
            break
        before = now
        edges = stored(_star(_star(edges, True), False), "stars")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

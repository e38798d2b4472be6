"""Connected components of a link table, without collecting it.

Before each round, every task shrinks its own links to a spanning forest. In a round every node takes its smallest
neighbour (or itself) as parent; parents are then replaced by their own parents until none changes, which takes a
number of steps logarithmic in the longest chain of parents, and all links move to the parents so found. A node without a smaller
neighbour has a neighbour that merges, so a component's nodes at least halve a round. Rounds end when no link joins different
nodes, and the parents of all rounds are chained. A parent is never larger than its child, so a component ends at its
smallest node.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, stored

#: Links that one task's forest holds before it is emitted and begun anew.
FOREST_LINKS = 500_000


class Forest:
    """Union-find whose roots are the smallest nodes."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def root(self, node):
        path = []
        while (up := self.parent.setdefault(node, node)) != node:
            path.append(node)
            node = up
        for x in path:
            self.parent[x] = node
        return node

    def link(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple]:
        return [(root, node) for node in list(self.parent) if (root := self.root(node)) != node]


def _forest(pairs: DataFrame) -> DataFrame:
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), 0

        def emit() -> pa.RecordBatch:
            stars, of = forest.stars(), pairs_type
            return pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], of) for i in range(2)], names=["a", "b"])

        pairs_type = None
        for batch in batches:
            pairs_type = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.link(a, b)
            held += batch.num_rows
            if held >= FOREST_LINKS:
                yield emit()
                forest, held = Forest(), 0
        if held:
            yield emit()

    return pairs.mapInArrow(run, f"a {kind}, b {kind}")


def _jumped(parents: DataFrame) -> DataFrame:
    """``parents`` (node, parent) with every parent replaced by the root that its chain ends at."""
    while True:
        above = parents.select(F.col("node").alias("at"), F.col("parent").alias("top"))
        joined = parents.select("node", "parent").join(above, F.col("parent") == F.col("at"))
        higher = stored(joined.select("node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")), "parents")
        discard(parents)
        parents = higher
        if parents.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (src, dst); links with a null end or equal ends count as none.

    What a round leaves is stored and reread rather than checkpointed: a checkpoint keeps what the planner inferred of its rows, and
    over many rounds that grows without end."""
    pairs = links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    pairs = stored(_forest(pairs).distinct(), "pairs")
    levels: list[DataFrame] = []
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("b", "a")).toDF("node", "other")
        smallest = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent"))
        parents = _jumped(stored(smallest, "parents")).select("node", "parent")
        levels.append(parents)
        of_a, of_b = parents.toDF("a", "to_a"), parents.toDF("b", "to_b")
        moved = pairs.join(of_a, "a").join(of_b, "b").where("to_a <> to_b")
        moved = moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        fewer = stored(_forest(moved).distinct(), "pairs")
        discard(pairs)
        pairs = fewer
    if not levels:
        return pairs.toDF("node", "component")
    found = levels.pop().toDF("node", "component")
    while levels:
        later = found.toDF("at", "component")
        found = levels.pop().join(later, F.col("parent") == F.col("at"), "left").select("node", F.coalesce("component", "parent").alias("component"))
    return found

"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors of a label become one class first, so copies are never compared. Each tree splits unit
vectors by the median of a random projection; those within a margin of a split go to both sides (the
spill), so that neighbours stay together. All vectors that share label, tree and leaf are compared with
double-precision cosine; links found in any tree are united.

``shape`` chooses the trees and the margin for a depth: random projections of unit vectors spread like 1 / sqrt(length), and so
does the difference of two vectors at the threshold, which gives the chance that a split parts them. Of all trees
and margins that miss at most ``MISS`` of such pairs it takes those with the fewest copies. Depth follows the largest label, so leaves hold about ``LEAF``
classes at any size.

A pair can share several leaves. The first of them (by tree, then leaf) owns it: each task works out
the trees' leaves of its own vectors again and skips pairs owned elsewhere, so links are counted once and no pairs leave a task,
only each vector's count and one edge to its leaf's smallest linked vector. Leaves of over ``BLOCK``
classes are compared block against block, each pair of blocks in a task of its own. Vectors travel as they are stored, in 32 bits where
they are.

Fit: hyperplanes are seeded; medians come from at most ``FIT_VECTORS`` classes (smallest seeded id hash), and where a node has fewer than
``FIT_NODE`` of them, from the whole sample. Every vector is indexed. Tests measure recall against brute force, and of pairs at the threshold at
depths of large tables.

Defined cases: a null label, or a vector that is null, empty, zero or holds null or non-finite parts,
links with nothing and is its own component; vectors of different lengths don't link; repeated rows are
vectors of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_sample, cut, discard, map_batches, small_batches, stored
from sparkloom.llm.components import Forest, components

THRESHOLD = 0.93
LEAF = 1_024
BLOCK = 2_048
FIT_VECTORS = 20_000
#: Vectors of the sample that a node's own median needs.
FIT_NODE = 32
#: Share of pairs at the threshold that all trees together may part.
MISS = 0.0005
#: Fewest trees.
TREES = 3
SEED = 20
#: Rows compared with a whole block at once.
STRIPE = 256


def parted(margin: float, threshold: float) -> float:
    """Chance that a split at the median, with ``margin`` in units of the projections' deviation, parts two vectors at the threshold.

    They are parted if the split lies between them, farther than the margin from either: their projections differ by a normal of
    deviation sqrt(2 - 2 * threshold), and the median meets a gap with the normal's density at its middle."""
    spread = math.sqrt(2 - 2 * threshold)
    z = 2 * margin / spread
    beyond = 2 * (math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - z * math.erfc(z / math.sqrt(2)) / 2)
    return spread * beyond / math.sqrt(2 * math.pi)


def shape(depth: int, threshold: float = THRESHOLD, miss: float = MISS, least_trees: int = TREES) -> tuple[int, float]:
    """(trees, margin times sqrt of the length): fewest copies a vector with at most ``miss`` of the pairs at the threshold lost."""
    best = None
    for step in range(1, 61):
        margin = step / 50
        lost = 1 - (1 - parted(margin, threshold)) ** depth
        trees = least_trees if lost <= 0 else max(least_trees, math.ceil(math.log(miss) / math.log(lost)))
        copies = trees * (1 + math.erf(margin / math.sqrt(2))) ** depth
        if best is None or copies < best[0]:
            best = (copies, trees, margin)
    return best[1], best[2]


class Trees:
    """Per vector length: hyperplanes (trees x levels x length) and medians of each level's nodes."""

    def __init__(self, sample: dict[int, np.ndarray], trees: int, depth: int, margin: float):
        self.trees, self.depth, self.margin = trees, depth, margin
        self.planes: dict[int, np.ndarray] = {}
        self.medians: dict[int, list[list[np.ndarray]]] = {}
        for length, rows in sample.items():
            planes = np.random.default_rng([SEED, length]).normal(size=(trees, max(depth, 1), length))
            self.planes[length] = planes = planes / np.linalg.norm(planes, axis=2, keepdims=True)
            self.medians[length] = [self._fitted(rows, planes[t]) for t in range(trees)]

    def _fitted(self, rows: np.ndarray, planes: np.ndarray) -> list[np.ndarray]:
        """A level's medians, one a node; a level where no node has sample enough has one for all."""
        found, nodes = [], np.zeros(len(rows), dtype=np.int64)
        for level in range(self.depth):
            cast = rows @ planes[level]
            whole = float(np.median(cast))
            medians = np.array([whole])
            if len(rows) >= FIT_NODE << level:
                order = np.argsort(nodes, kind="stable")
                starts = np.searchsorted(nodes[order], np.arange((1 << level) + 1))
                medians = np.full(1 << level, whole)
                for node in range(1 << level):
                    if starts[node + 1] - starts[node] >= FIT_NODE // 2:
                        medians[node] = np.median(cast[order[starts[node] : starts[node + 1]]])
            found.append(medians)
            nodes = 2 * nodes + (cast > medians[nodes if len(medians) > 1 else 0])
        return found

    def places(self, unit: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that unit vectors are in."""
        rows, nodes = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64)
        length = unit.shape[1]
        if length not in self.planes:
            return rows, nodes
        margin = self.margin / math.sqrt(length)
        for level, medians in enumerate(self.medians[length][tree]):
            off = (unit @ self.planes[length][tree, level])[rows] - medians[nodes if len(medians) > 1 else 0]
            left, right = off <= margin, off >= -margin
            rows, nodes = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
        return rows, nodes

    def shared(self, unit: np.ndarray, tree: int, below: int | None = None) -> np.ndarray:
        """Bits of each row for the tree's leaves (those ``below`` a leaf) that more than one of the rows is in."""
        rows, nodes = self.places(unit, tree)
        if below is not None:
            rows, nodes = rows[nodes < below], nodes[nodes < below]
        _, at, times = np.unique(nodes, return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1
        met = times[at] > 1
        found = np.zeros((len(unit), int((times > 1).sum())), dtype=bool)
        found[rows[met], column[at[met]]] = True
        return np.packbits(found, axis=1)


def usable(vector: Column) -> Column:
    """Whether a vector can link at all."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of very small or large parts stay finite
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def near_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    leaf: int = LEAF,
    miss: float = MISS,
    block: int = BLOCK,
    fit_vectors: int = FIT_VECTORS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    small_batches(spark, 2_000)
    part = vectors.schema["embedding"].dataType.elementType.simpleString()
    wide = "float" if part == "float" else "double"  # other numbers are compared as doubles
    rows = vectors.select("vec_id", vectors["embedding"].cast(f"array<{wide}>").alias("embedding"), "label")
    label_kind, id_kind = rows.schema["label"].dataType.simpleString(), rows.schema["vec_id"].dataType.simpleString()
    can = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    classes = stored(
        can.groupBy("label", "embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("members")), "vector-classes"
    )

    most = classes.groupBy("label", F.size("embedding").alias("length")).count().agg(F.max("count")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, most / leaf))))
    trees, margin = shape(depth, threshold, miss)
    by_length: dict[int, list] = {}
    for row in bounded_sample(classes.select("class_id", "embedding"), ["class_id"], fit_vectors, "forest").select("embedding").collect():
        by_length.setdefault(len(row["embedding"]), []).append(np.array(row["embedding"], dtype=np.float64))
    forest = spark.sparkContext.broadcast(Trees({k: _unit(np.array(v)) for k, v in by_length.items()}, trees, depth, margin))

    kind = np.dtype(np.float32 if wide == "float" else np.float64)

    def grouped(batch: pa.RecordBatch):
        """(row numbers, stored vectors, unit vectors) of each length in a batch."""
        lists = batch.column(0)
        flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        lengths = np.diff(starts)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            stack = np.stack([flat[starts[i] : starts[i] + length] for i in at]).astype(kind)
            yield at, stack, _unit(stack.astype(np.float64))

    def place(batch: pa.RecordBatch):
        labels, ids, members = (batch.column(i) for i in range(1, 4))
        for at, stack, unit in grouped(batch):
            packed = [x.tobytes() for x in stack]
            for tree in range(trees):
                of, leaves = forest.value.places(unit, tree)
                take = pa.array(at[of])
                yield pa.RecordBatch.from_arrays(
                    [labels.take(take), ids.take(take), members.take(take), pa.array(np.full(len(of), unit.shape[1], np.int32)), pa.array(np.full(len(of), tree, np.int32)), pa.array(leaves), pa.array([packed[i] for i in of], pa.binary())],
                    names=["label", "class_id", "members", "length", "tree", "leaf", "vector"],
                )

    def count(batch: pa.RecordBatch):
        labels = batch.column(1)
        names = labels.dictionary_encode()
        codes = names.indices.to_numpy(zero_copy_only=False)
        for at, _, unit in grouped(batch):
            for tree in range(trees):
                of, leaves = forest.value.places(unit, tree)
                found, times = np.unique(np.stack([codes[at[of]], leaves]), axis=1, return_counts=True)
                n = found.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [names.dictionary.take(pa.array(found[0])), pa.array(np.full(n, unit.shape[1], np.int32)), pa.array(np.full(n, tree, np.int32)), pa.array(found[1]), pa.array(times)],
                    names=["label", "length", "tree", "leaf", "times"],
                )

    source = classes.select("embedding", "label", "class_id", "members")
    placed = map_batches(source, place, f"label {label_kind}, class_id {id_kind}, members long, length int, tree int, leaf long, vector binary")
    keys = ["label", "length", "tree", "leaf"]
    counts = map_batches(source, count, f"label {label_kind}, length int, tree int, leaf long, times long").groupBy(*keys).agg(F.sum("times").alias("count"))
    crowded = counts.where(F.col("count") > block).withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count")
    blocked = (
        placed.join(crowded, keys, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "class_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )

    def compare(table: pa.Table) -> pa.Table:
        ids, members = table["class_id"].to_pylist(), table["members"].to_numpy()
        unit = _unit(np.frombuffer(b"".join(table["vector"].to_pylist()), dtype=kind).reshape(len(ids), -1).astype(np.float64))
        blocks = table["block"].to_numpy()
        tree, leaf_no, low, high = (table[c][0].as_py() for c in ("tree", "leaf", "low", "high"))
        left = np.flatnonzero(blocks == low)
        right = left if low == high else np.flatnonzero(blocks == high)
        before = np.hstack([forest.value.shared(unit, t) for t in range(tree)] + [forest.value.shared(unit, tree, leaf_no)])
        links = np.zeros(len(ids), dtype=np.int64)
        joined = Forest()
        for top in range(0, len(left), STRIPE):
            some = left[top : top + STRIPE]
            i, j = np.nonzero(unit[some] @ unit[right].T >= threshold)
            i, j = some[i], right[j]
            if low == high:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 100_000):
                a, b = i[at : at + 100_000], j[at : at + 100_000]
                own = ~(before[a] & before[b]).any(axis=1)
                a, b = a[own], b[own]
                np.add.at(links, a, members[b])
                np.add.at(links, b, members[a])
                fresh = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else []
                for x, y in fresh:
                    joined.link(ids[x], ids[y])
        linked = np.flatnonzero(links)
        return pa.table(
            {"class_id": table["class_id"].take(pa.array(linked)), "links": pa.array(links[linked]), "root": pa.array([joined.root(ids[x]) for x in linked], table["class_id"].type)}
        )

    found = stored(
        blocked.groupBy(*keys, "low", "high").applyInArrow(compare, f"class_id {id_kind}, links long, root {id_kind}"), "vector-links"
    )
    joined = components(found.select(F.col("class_id").alias("src"), F.col("root").alias("dst")))
    sums = cut(found.groupBy(F.col("class_id").alias("sum_id")).agg(F.sum("links").alias("links")))
    discard(found)
    told = (
        classes.join(sums, F.col("class_id") == F.col("sum_id"), "left")
        .join(joined, F.col("class_id") == F.col("node"), "left")
        .select(
            F.col("label").alias("of_label"),
            F.col("embedding").alias("of_vector"),
            (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "class_id").alias("component_id"),
        )
    )
    whole = rows.join(told, (rows["label"] == told["of_label"]) & (rows["embedding"] == told["of_vector"]), "left")
    return whole.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").cast("long").alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(node, seen) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.dst FROM reach r JOIN links l ON r.seen = l.src)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id::BIGINT AS component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) c ON c.node = e.vec_id
LEFT JOIN (SELECT src, count(*) AS n FROM links GROUP BY src) n ON n.src = e.vec_id
"""

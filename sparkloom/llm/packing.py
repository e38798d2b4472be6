"""Best-fit packing of documents into bins of ``capacity`` words, under conflicts.

A document longer than a bin is cut into full pieces, each a bin of its own, and a rest. Rests are packed
in shards of about ``SHARD`` documents, dealt by a hash of the id; a shard is one task's work, and its
number follows the input. Within a shard, pieces go by falling size into the fullest bin that they fit
and that is compatible: bins are kept in order of residual space, the search starts at the residual that fits exactly
and goes on upwards until a bin's bitmaps allow the piece. Bins carry a bitmap of duplicate clusters (no bin holds two
documents of a cluster) and bitmaps of sources, one for each time a source may come (``per_source``).

Equal texts (A-Z lower-cased, blanks apart) are a cluster unless ``cluster`` names a column; a null there is no cluster.

Defined cases: null texts and texts without words come once, with no bin; a null source is a source of
its own; repeated rows are documents of one cluster; ties of size go by id, then cluster; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.mixing import word_count

CAPACITY = 2_048
PER_SOURCE = 4
SHARD = 5_000


class Packer:
    """Bins of one shard."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin), ascending
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a piece; ``cluster`` is 0 or a bit."""
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            residual, bin_no = self.order[at]
            if not self.clusters[bin_no] & cluster and not self.sources[bin_no][-1] & source:
                del self.order[at]
                break
            at += 1
        else:
            residual, bin_no = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
        self.clusters[bin_no] |= cluster
        planes = self.sources[bin_no]
        for i, plane in enumerate(planes):
            if not plane & source:
                planes[i] |= source
                break
        if residual > size:
            insort(self.order, (residual - size, bin_no))
        return bin_no, self.capacity - residual


def pack_shard(rows: list[tuple], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each row (size, source, cluster), which come in packing order; a bit stands for each source, and for each cluster met twice."""
    packer = Packer(capacity, per_source)
    times: dict = {}
    for _, _, cluster in rows:
        times[cluster] = times.get(cluster, 0) + 1
    shared = [c for c, n in times.items() if n > 1 and c is not None]
    cluster_bit = {c: 1 << i for i, c in enumerate(shared)}
    source_bit: dict = {}
    for _, source, _ in rows:
        source_bit.setdefault(source, 1 << len(source_bit))
    return [packer.place(size, source_bit[source], cluster_bit.get(cluster, 0)) for size, source, cluster in rows]


def text_cluster(text: Column) -> Column:
    """A hash of the words, A-Z lower-cased."""
    return F.xxhash64(F.translate(F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD, cluster: str | None = None) -> DataFrame:
    """(doc_id, piece, start_word, n_words, bin_id, offset) of each piece of ``docs`` (doc_id, text, source)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shards = max(1, -(-docs.count() // shard))
    own = docs[cluster] if cluster else text_cluster(docs["text"])
    sized = docs.select(docs["doc_id"], docs["source"].cast("string").alias("source"), own.cast("string").alias("cluster"), word_count(docs["text"]).alias("size"))
    dealt = F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "cluster"), F.lit(shards)).cast("int")

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rest", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        ids, sizes, base = table["doc_id"], table["size"].to_pylist(), table["shard"][0].as_py() << 32
        rest = table["rest"].to_pylist()
        some = [i for i, n in enumerate(rest) if n]
        sources, clusters = table["source"].to_pylist(), table["cluster"].to_pylist()
        found = dict(zip(some, pack_shard([(rest[i], sources[i], clusters[i]) for i in some], capacity, per_source), strict=True))
        full_bin = 1 + max((b for b, _ in found.values()), default=-1)
        out: list[tuple] = []
        for i, size in enumerate(sizes):
            full = size // capacity
            for piece in range(full):
                out.append((i, piece, piece * capacity, capacity, base + full_bin, 0))
                full_bin += 1
            if i in found:
                out.append((i, full, full * capacity, rest[i], base + found[i][0], found[i][1]))
            elif not full:
                out.append((i, 0, 0, 0, None, None))
        columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(6)]
        return pa.table([ids.take(columns[0]), columns[1].cast(pa.int32()), *columns[2:]], names=["doc_id", "piece", "start_word", "n_words", "bin_id", "offset"])

    pieces = sized.withColumn("rest", F.col("size") % capacity).withColumn("shard", dealt)
    return pieces.groupBy("shard").applyInArrow(work, f"doc_id {kind}, piece int, start_word long, n_words long, bin_id long, offset long")

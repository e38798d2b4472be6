"""Dense vectors: norms, cosine, exact and approximate neighbours, PCA, TF-IDF distinctiveness."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import exploded, kept


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    length = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / length)


def bad_norms(rows: DataFrame, vector: str, tolerance: float = 1e-2) -> DataFrame:
    return rows.where(F.abs(norm(F.col(vector)) - 1) > tolerance)


#: Rows of the corpus, and of the queries, that meet in one task.
BLOCK = 8_192


def _best_in_blocks(corpus: DataFrame, queries: DataFrame, place: list[str], k: int) -> DataFrame:
    """(query_id, id, similarity, place): the best k of each query over all blocks where both sides have the same ``place``.

    corpus (place, id, v) and queries (place, id, v) with vectors as doubles. A block's similarities are one product of matrices; of each
    block, a query's best k go on."""
    import numpy as np
    import pyarrow as pa

    kind = queries.schema["id"].dataType.simpleString()
    both = corpus.select(*place, "id", "v", F.lit(False).alias("asks")).union(queries.select(*place, "id", "v", F.lit(True).alias("asks")))

    def meet(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy(zero_copy_only=False)
        vectors, ids = table["v"].to_pylist(), table["id"].to_pylist()
        parts: list[list] = [[], [], []]
        lengths = np.array([-1 if v is None else len(v) for v in vectors])
        for length in np.unique(lengths[lengths > 0]):
            own, other = np.flatnonzero(asks & (lengths == length)), np.flatnonzero(~asks & (lengths == length))
            if not len(own) or not len(other):
                continue
            unit = np.array([vectors[i] for i in np.concatenate([own, other])], dtype=np.float64)
            unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
            for at in range(0, len(own), 256):
                some = own[at : at + 256]
                near = np.round(unit[at : at + len(some)] @ unit[len(own) :].T, 9)
                keep = min(k + 1, len(other))
                edge = -np.partition(-near, keep - 1, axis=1)[:, keep - 1]
                for i, row, least in zip(some, near, edge, strict=True):
                    best = sorted((-row[j], ids[other[j]]) for j in np.flatnonzero(row >= least) if ids[other[j]] != ids[i])[:k]
                    parts[0] += [ids[i]] * len(best)
                    parts[1] += [x for _, x in best]
                    parts[2] += [-s for s, _ in best]
        return pa.table({"query_id": pa.array(parts[0], table["id"].type), "id": pa.array(parts[1], table["id"].type), "similarity": pa.array(parts[2], pa.float64())})

    met = both.groupBy(*place).applyInArrow(meet, f"query_id {kind}, id {kind}, similarity double").distinct()
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("id"))
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _sides(corpus: DataFrame, queries: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    return tuple(side.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")) for side in (corpus, queries))


def neighbours(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, key, similarity, place): exact cosine top k of a stated query set, itself excluded.

    Both sides are dealt into blocks by a hash of the key; each block of queries meets each block of the corpus in a task of its own. Nothing is
    broadcast, and what leaves a task is k rows a query."""
    c, q = _sides(corpus, queries, key, vector)
    parts, asked = max(1, -(-c.count() // block)), max(1, -(-q.count() // block))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    found = _best_in_blocks(c.select("*", dealt(parts).alias("part"), every(asked).alias("ask")), q.select("*", every(parts).alias("part"), dealt(asked).alias("ask")), ["part", "ask"], k)
    return found.withColumnRenamed("id", key)


def approximate_neighbours(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int, cells: int | None = None, probes: int | None = None, fit: int = 20_000, block: int = BLOCK, seed: int = 42, wanted: float = 0.97) -> DataFrame:
    """Like ``neighbours``, by an index of cells: each vector belongs to the nearest of ``cells`` centres, and a query asks the
    ``probes`` nearest cells, in full vectors.

    Centres are fitted on at most ``fit`` vectors (smallest hash of the key); every vector is indexed. By default there are about sqrt(n)
    cells, and as many are asked as hold ``wanted`` of the nearest neighbours that vectors of the sample have in it. Cells of more than ``block`` vectors are dealt into parts, and queries meet each part."""
    import numpy as np
    import pyarrow as pa

    c, q = _sides(corpus, queries, key, vector)
    n = c.count()
    cells = cells or max(1, int(n**0.5))
    draw = F.xxhash64(F.lit(seed), "id")
    sample = np.array([r["v"] for r in c.where("v IS NOT NULL").orderBy(draw, "id").limit(fit).select("v").collect()], dtype=np.float64)
    if not len(sample):
        return _best_in_blocks(c.withColumn("cell", F.lit(0)), q.withColumn("cell", F.lit(0)), ["cell"], k).withColumnRenamed("id", key)
    sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    centres = sample[np.random.default_rng(seed).choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(8):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    if probes is None:
        near = sample[:200] @ sample.T
        near[np.arange(len(near)), np.arange(len(near))] = -2.0
        best = np.argpartition(-near, min(k, len(sample)) - 1, axis=1)[:, :k]
        cell = np.argmax(sample @ centres.T, axis=1)
        turn = np.argsort(np.argsort(-(sample[:200] @ centres.T), axis=1, kind="stable"), axis=1)
        probes = int(np.quantile(np.take_along_axis(turn, cell[best], axis=1), wanted)) + 1
    probes = min(len(centres), probes)
    shared = corpus.sparkSession.sparkContext.broadcast(centres)
    kind = c.schema["id"].dataType.simpleString()

    def asked(frame: DataFrame, most: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                ids, vectors = batch.column(0), batch.column(1).to_pylist()
                good = [i for i, v in enumerate(vectors) if v is not None and len(v) == shared.value.shape[1]]
                if not good:
                    continue
                near = np.array([vectors[i] for i in good], dtype=np.float64) @ shared.value.T
                top = np.argsort(-near, axis=1, kind="stable")[:, :most].ravel().astype(np.int32)
                take = pa.array(np.repeat(good, min(most, near.shape[1])))
                yield pa.RecordBatch.from_arrays([ids.take(take), batch.column(1).take(take), pa.array(top)], names=["id", "v", "cell"])

        return frame.mapInArrow(run, f"id {kind}, v array<double>, cell int")

    indexed = asked(c, 1)
    sizes = indexed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    own = indexed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    asking = asked(q, probes).join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return _best_in_blocks(own, asking, ["cell", "part"], k).withColumnRenamed("id", key)


def principal_components(rows: DataFrame, sample: DataFrame, vector: str, k: int) -> DataFrame:
    """``rows`` with ``pca``: centred on the sample's means, projected on its components, at most one fewer than the sample has rows.

    A sample of fewer than two rows has no components: ``pca`` is then empty."""
    sample = sample.where(F.col(vector).isNotNull())
    first = sample.select(vector).limit(k + 1).collect()
    if len(first) < 2:
        return rows.withColumn("pca", F.array().cast("array<double>"))
    dims = min(len(first[0][0]), len(first) - 1)
    fitted = sample.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = PCA(k=min(k, dims), inputCol="v", outputCol="p").fit(fitted)
    means = fitted.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray().tolist()
    centre = F.array(*[F.lit(float(x)) for x in means])
    centred = rows.withColumn("v", array_to_vector(F.zip_with(F.col(vector).cast("array<double>"), centre, lambda x, m: x - m)))
    return model.transform(centred).withColumn("pca", vector_to_array("p")).drop("v", "p")


def _lengths(counts: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """(key, length): lengths of the TF-IDF vectors of ``counts`` (key, term, tf) in the terms of ``idf`` (term, idf)."""
    w = F.col("tf") * F.col("idf")
    return counts.join(idf, "term").groupBy(key).agg(F.sqrt(F.sum(w * w)).alias("length"))


def _centroid(counts: DataFrame, key: str, idf: DataFrame, lengths: DataFrame) -> DataFrame:
    """(term, idf, c): sums of unit vectors; a vector's share of them is tf / length, and a term's idf is one factor of all."""
    shares = counts.join(lengths, key).groupBy("term").agg(F.sum(F.col("tf") / F.col("length")).alias("share"))
    return shares.join(idf, "term").select("term", "idf", (F.col("share") * F.col("idf")).alias("c"))


def _along(counts: DataFrame, key: str, centroid: DataFrame, lengths: DataFrame) -> DataFrame:
    """(key, d): products of unit vectors and ``centroid``; lengths are divided by last, so no vector is made unit row by row."""
    d = counts.join(centroid, "term").groupBy(key).agg(F.sum(F.col("tf") * F.col("idf") * F.col("c")).alias("d"))
    return d.join(lengths, key).select(key, (F.col("d") / F.col("length")).alias("d"))


def _term_counts(docs: DataFrame, key: str, terms: str) -> DataFrame:
    """(key, term, tf), stored: terms are derived from texts, which is the dear part, and counts are asked for several times."""
    return kept(exploded(docs, terms, "term", key).groupBy(key, "term").agg(F.count("*").alias("tf")), "term-counts")


def _idf(counts: DataFrame, n: DataFrame, min_df: int, features: int | None) -> DataFrame:
    """(term, idf) with idf = ln((1 + n)/(1 + df)) + 1, of terms in ``min_df`` documents; of these the ``features`` most frequent."""
    known = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    if features is not None:
        known = known.orderBy(F.desc("total"), "term").limit(features)
    return known.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_similarity(docs: DataFrame, key: str, terms: str, min_df: int = 2) -> DataFrame:
    """(key, centroid_similarity): cosine of each document to the mean of all unit TF-IDF vectors."""
    n = docs.agg(F.count("*").alias("n"))
    counts = _term_counts(docs, key, terms)
    idf = kept(_idf(counts, n, min_df, None), "idf")
    lengths = kept(_lengths(counts, key, idf), "lengths")
    centroid = kept(_centroid(counts, key, idf, lengths).crossJoin(F.broadcast(n)).select("term", "idf", (F.col("c") / F.col("n")).alias("c")), "centroid")
    size = centroid.agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("size"))
    return _along(counts, key, centroid, lengths).crossJoin(F.broadcast(size)).select(key, (F.col("d") / F.col("size")).alias("centroid_similarity"))


def recent_similarity(docs: DataFrame, key: str, terms: str, month: int, months: int = 6, min_df: int = 2, features: int = 20_000, least: int = 50) -> DataFrame:
    """(key, similarity) of documents (key, terms, t) of ``month`` to the mean of the ``months`` before it, whose terms alone count.

    0 for a document without such terms, and for all where the months before have ``least`` documents or fewer."""
    before = docs.where((F.col("t") >= month - months) & (F.col("t") < month))
    n = before.agg(F.count("*").alias("n"))
    counts = _term_counts(before, key, terms)
    idf = kept(_idf(counts, n, min_df, features), "idf")
    centroid = kept(_centroid(counts, key, idf, _lengths(counts, key, idf)), "centroid")
    size = centroid.agg(F.greatest(F.sqrt(F.sum(F.col("c") * F.col("c"))), F.lit(1e-9)).alias("size"))
    now = docs.where(F.col("t") == month)
    own = _term_counts(now, key, terms)
    scored = _along(own, key, centroid, _lengths(own, key, idf)).withColumnRenamed(key, "_key").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(n))
    told = scored.select("_key", F.when(F.col("n") > least, F.col("d") / F.col("size")).otherwise(0.0).alias("s"))
    return now.select(key).join(told, F.col(key) == F.col("_key"), "left").select(key, F.coalesce("s", F.lit(0.0)).alias("similarity"))

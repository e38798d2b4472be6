"""Tables laid out for what is asked of them: buckets that meet without an exchange, and texts found by an index of their trigrams.

``bucketed`` writes a table in sorted buckets of its key; two such tables with equally many buckets join by reading bucket against bucket. ``TextIndex``
keeps postings of lower-cased character trigrams beside the texts, which are partitioned by a hash of their id: a search reads the postings of the
needle's rarest trigrams, intersects them, and verifies the candidates in the partitions that they lie in. Needles under three characters have no
trigram; they are searched in the texts themselves.

Defined cases: null keys meet nothing; null texts are never found; an empty needle finds every text that isn't null; repeated rows are found each; an empty table finds nothing;
characters count by code point, and a trigram may hold blanks and line ends.
"""

from __future__ import annotations

import atexit
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sparkloom.operators.publishing import read_text, write_text
from sparkloom.session import exploded

#: Partitions of an index's texts, and of its postings.
BLOCKS = 16
#: Trigrams of a needle whose postings are intersected: the rarest tell nearly as much as all.
RAREST = 4


def bucketed(rows: DataFrame, key: str, buckets: int, name: str | None = None) -> str:
    """The name of a table of ``rows`` in sorted buckets, in the warehouse; one without a given name goes with the session."""
    own = name or f"sparkloom_{uuid.uuid4().hex}"
    # One task a bucket, so that a bucket is one sorted file.
    rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(own)
    if name is None:
        atexit.register(_dropped, rows.sparkSession, own)
    return own


def _dropped(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the session is gone, and its catalog with it
        return


def buckets_of(table: DataFrame) -> set[int]:
    """Numbers of the buckets that a table has files for; bounded by its buckets."""
    return {int(f.rsplit("_", 1)[1].split(".")[0]) for f in table.inputFiles()}


def aligned_join(spark: SparkSession, documents: str, vectors: str, key: str) -> DataFrame:
    """Rows of two tables of ``bucketed`` that share a key, without an exchange of either; vectors in a bucket that no document is in are an error."""
    left, right = spark.table(documents), spark.table(vectors)
    lacking = buckets_of(right) - buckets_of(left)
    if lacking:
        raise ValueError(f"vector shards without documents: {', '.join(map(str, sorted(lacking)[:5]))}")
    return left.hint("merge").join(right, key)


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-cased text.

    The text is cut into its characters once, and bound as the one element of an array: a call that names the text inside a lambda would
    lower it, and count its characters from the first on, for every place of it."""
    runs = lambda chars: F.transform(F.slice(chars, 1, F.greatest(F.size(chars) - 2, F.lit(0))), lambda c, i: F.concat(c, F.get(chars, i + 1), F.get(chars, i + 2)))
    return F.array_distinct(F.flatten(F.transform(F.array(F.split(F.lower(text), "")), runs)))


def _block(value: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(blocks)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """An index in a folder: texts/block=n, postings/block=n, and the counts of trigrams."""

    path: str
    key: str
    texts: tuple[str, ...]
    blocks: int
    schema: StructType | None = None  #: of the rows; without it, it is inferred from the files, which an index of no rows hasn't

    @classmethod
    def build(cls, rows: DataFrame, key: str, texts: list[str], path: str, blocks: int = BLOCKS) -> TextIndex:
        """Writes an index of the columns ``texts`` of ``rows``. A text's trigrams are few against its length, so postings take one shuffle of ids."""
        rows.withColumn("block", _block(F.col(key), blocks)).repartition("block").write.mode("overwrite").partitionBy("block").parquet(f"{path}/texts")
        grams = F.array_distinct(F.flatten(F.array(*[F.coalesce(trigrams(F.col(c)), F.array().cast("array<string>")) for c in texts])))
        postings = exploded(rows.where(F.col(key).isNotNull()), grams, "gram", key).withColumnRenamed(key, "id")
        # A common trigram's postings are dealt over the tasks by id; each task writes them to the trigram's partition.
        dealt = postings.withColumn("block", _block(F.col("gram"), blocks)).repartition(F.col("block"), _block(F.col("id"), 8))
        dealt.sortWithinPartitions("block", "gram").write.mode("overwrite").partitionBy("block").parquet(f"{path}/postings")
        spark, index = rows.sparkSession, cls(path, key, tuple(texts), blocks, rows.schema)
        index._postings(spark).groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")
        write_text(spark, f"{path}/index.txt", "whole")  # the last: an index without it isn't whole
        return index

    def _read(self, spark: SparkSession, part: str, schema: StructType | None) -> DataFrame:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(f"{self.path}/{part}")

    def _rows(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "texts", None if self.schema is None else StructType([*self.schema.fields, StructField("block", IntegerType())]))

    def _postings(self, spark: SparkSession) -> DataFrame:
        """(gram, id, block)."""
        kind = None if self.schema is None else self.schema[self.key].dataType
        return self._read(spark, "postings", None if kind is None else StructType().add("gram", "string").add("id", kind).add("block", IntegerType()))

    def candidates(self, spark: SparkSession, needle: str) -> DataFrame | None:
        """(id) of texts that hold the needle's rarest trigrams; None where it has none."""
        low = needle.lower()
        grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        if not grams:
            return None
        counts = {r["gram"]: r["n"] for r in spark.read.schema("gram string, n long").parquet(f"{self.path}/counts").where(F.col("gram").isin(grams)).collect()}  # a row a trigram of the needle
        postings = self._postings(spark)
        if len(counts) < len(grams):
            return postings.select("id").limit(0)
        rarest = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
        places = sorted(set(spark.range(1).select(*[_block(F.lit(g), self.blocks).alias(f"b{i}") for i, g in enumerate(rarest)]).first()))
        held = postings.where(F.col("block").isin(places) & F.col("gram").isin(rarest))
        return held.groupBy("id").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(rarest)).select("id")

    def search(self, spark: SparkSession, needle: str) -> DataFrame:
        """Rows with a text that holds ``needle`` literally, whatever its case; only the candidates' partitions of texts are read."""
        if read_text(spark, f"{self.path}/index.txt") != "whole":
            raise ValueError(f"{self.path} holds no whole index")
        rows, found = self._rows(spark), self.candidates(spark, needle)
        holds = F.lit(False)
        for c in self.texts:
            holds = holds | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(needle.lower())), F.lit(False))
        if found is not None:
            places = [r[0] for r in found.select(_block(F.col("id"), self.blocks).alias("block")).distinct().collect()]  # at most so many as blocks
            rows = rows.where(F.col("block").isin(places) if places else F.lit(False)).join(found.withColumnRenamed("id", "_found"), F.col(self.key) == F.col("_found"), "left_semi")
        return rows.where(holds).drop("block")

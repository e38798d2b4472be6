"""The driver's tables seen as records of a literature corpus, in DataFrame form and as SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scalars
from sparkloom.session import table

#: Papers out of documents: the first line is the title, the whole text the abstract.
PAPERS_SQL = """papers AS (
  SELECT doc_id AS paper_id, split_part(text, chr(10), 1) AS title, text AS abstract, substr(text, 1, 480) AS abstract_preview, source, lang,
         TIMESTAMP '2020-01-01' + to_hours((doc_id % 20000)::INT) AS submitted_at,
         CASE doc_id % 5 WHEN 0 THEN ['cs.LG', 'stat.ML'] WHEN 1 THEN ['cs.CV', 'cs.LG'] WHEN 2 THEN ['hep-th'] WHEN 3 THEN ['math.CO', 'cs.DM'] ELSE ['q-bio.NC', 'physics.bio-ph', 'econ'] END AS categories
  FROM documents)"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lists = [["cs.LG", "stat.ML"], ["cs.CV", "cs.LG"], ["hep-th"], ["math.CO", "cs.DM"], ["q-bio.NC", "physics.bio-ph", "econ"]]
    categories = F.lit(None)
    for i, names in reversed(list(enumerate(lists))):
        categories = F.when(F.col("doc_id") % 5 == i, F.array(*[F.lit(x) for x in names])).otherwise(categories)
    return docs.select(
        F.col("doc_id").alias("paper_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("abstract"),
        scalars.abstract_preview(F.col("text")).alias("abstract_preview"),
        "source",
        "lang",
        (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("doc_id") % 20000).cast("int"))).alias("submitted_at"),
        categories.alias("categories"),
    )


#: Versions of papers out of order lines: not unique by (paper_id, version).
VERSIONS_SQL = """versions AS (
  SELECT l_orderkey AS paper_id, l_linenumber AS version, l_partkey, l_extendedprice AS price, l_shipdate AS updated_at FROM lineitem)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("version"), "l_partkey", F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("updated_at"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    s, d = F.col("l_orderkey"), F.col("l_partkey")
    pairs = lines.select(s.alias("src"), d.alias("dst")).where("src <> dst").distinct()  # months follow from keys, so they needn't be told apart
    return pairs.select("src", "dst", _month(F.col("src")).alias("t_src"), _month(F.col("dst")).alias("t_dst"))


def _month(key: Column) -> Column:
    """A paper's month, 0 to 79."""
    return (key * 37 % 80).cast("int")


#: A dated citation graph out of order lines: papers are all keys of orders and parts, each with a month of its own.
EDGES_SQL = """edges AS (
  SELECT DISTINCT l_orderkey AS src, l_partkey AS dst, (l_orderkey * 37 % 80)::INT AS t_src, (l_partkey * 37 % 80)::INT AS t_dst
  FROM lineitem WHERE l_orderkey <> l_partkey)"""

#: Authored papers out of orders: the customer and the suppliers of an order wrote it.
AUTHORED_SQL = """authored AS (
  SELECT o_orderkey AS paper_id, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS t,
         list_concat(['c' || o_custkey], coalesce(s.names, [])) AS authors
  FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT 's' || l_suppkey)) AS names FROM lineitem GROUP BY 1) s ON s.l_orderkey = o_orderkey)"""


def authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    names = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(name("s", "l_suppkey"))).alias("names"))  # an order has few lines
    joined = orders.join(names, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    own = F.array(name("c", "o_custkey"))
    authors = F.when(F.col("names").isNull(), own).otherwise(F.concat(own, "names"))
    return joined.select(F.col("o_orderkey").alias("paper_id"), scalars.month_index(F.col("o_orderdate")).alias("t"), authors.alias("authors"))


#: Map points out of embeddings.
POINTS_SQL = """points AS (
  SELECT vec_id AS doc_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, (2015 + vec_id % 10)::INT AS year,
         'point ' || vec_id AS title, TIMESTAMP '2024-01-01' + to_hours((vec_id % 1000)::INT) AS submitted_at FROM embeddings)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(
        F.col("vec_id").alias("doc_id"),
        F.get("embedding", F.lit(0)).cast("double").alias("x"),
        F.get("embedding", F.lit(1)).cast("double").alias("y"),
        (2015 + F.col("vec_id") % 10).cast("int").alias("year"),
        F.concat(F.lit("point "), F.col("vec_id").cast("string")).alias("title"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("vec_id") % 1000).cast("int"))).alias("submitted_at"),
    )


#: Cohort rows out of customers: a score with ties, a value known for some, a flag for newcomers, a hit label.
COHORT_SQL = """cohort AS (
  SELECT c_custkey AS id, c_mktsegment AS field, floor(c_acctbal / 100)::DOUBLE AS score, CASE WHEN c_custkey % 3 = 0 THEN floor(c_acctbal)::DOUBLE END AS known,
         c_custkey % 4 = 0 AS newcomer, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS hit, (c_custkey % 11)::DOUBLE AS label FROM customer)"""


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"),
        F.col("c_mktsegment").alias("field"),
        F.floor(F.col("c_acctbal") / 100).cast("double").alias("score"),
        F.when(k % 3 == 0, F.floor("c_acctbal").cast("double")).alias("known"),
        (k % 4 == 0).alias("newcomer"),
        F.when(k % 7 == 0, 1).otherwise(0).alias("hit"),
        (k % 11).cast("double").alias("label"),
    )

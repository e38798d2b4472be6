"""Queries of ingest, publishing and the views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scalars
from sparkloom.operators import grid, publishing, ranking, records
from sparkloom.plans import shapes
from sparkloom.plans.catalog import _A, _GRID, _R, _AVG
from sparkloom.plans.registry import register
from sparkloom.session import table
from sparkloom.streaming import incremental

# --- ingest ---------------------------------------------------------------------------------------


@register("papers_in_window", f"WITH {shapes.PAPERS_SQL} SELECT paper_id FROM papers WHERE submitted_at BETWEEN TIMESTAMP '2020-01-05' AND TIMESTAMP '2020-01-20' AND len(list_filter(categories, lambda c: c = 'math' OR starts_with(c, 'math.') OR c = 'cs.LG')) > 0")
def papers_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.in_window(shapes.papers(spark, sf_dir), "submitted_at", datetime(2020, 1, 5), datetime(2020, 1, 20), "categories", ["math", "cs.LG"])
    return found.select("paper_id")


@register("first_published_between", "WITH v AS (SELECT l_orderkey AS paper_id, arg_min(year(l_shipdate), (l_linenumber, l_shipdate))::INT AS y FROM lineitem GROUP BY 1) SELECT paper_id, y AS first_year FROM v WHERE y BETWEEN 1994 AND 1995")
def first_published_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    papers = lines.groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("version"), F.col("l_shipdate").alias("created"))).alias("versions"))
    return records.first_published_between(papers, "versions", 1995, 1994).select("paper_id", records.first_version_year(F.col("versions")).alias("first_year"))


_DRAFTS = """drafts AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE lang END AS title, text AS abstract, CASE WHEN doc_id % 5 = 0 THEN [] WHEN doc_id % 5 = 1 THEN NULL ELSE ['cs.LG'] END AS categories FROM documents)"""


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    categories = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.lit(None)).otherwise(F.array(F.lit("cs.LG")))
    return d.select(k.alias("id"), F.when(k % 7 == 0, " ").otherwise(F.col("lang")).alias("title"), F.col("text").alias("abstract"), categories.alias("categories"))


@register("missing_fields", f"WITH {_DRAFTS} SELECT id, concat_ws(',', CASE WHEN coalesce(trim(title), '') = '' THEN 'title' END, CASE WHEN coalesce(trim(abstract), '') = '' THEN 'abstract' END, CASE WHEN coalesce(len(categories), 0) = 0 THEN 'categories' END) AS missing FROM drafts")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.missing_fields(_drafts(spark, sf_dir).withColumn("id", F.col("id").cast("string")), lists=("categories",))
    return found.select(F.col("id").cast("long").alias("id"), F.array_join("missing", ",").alias("missing"))


@register("category_tokens", "SELECT p_partkey, array_to_string(list_filter(['cs.LG', 'stat', CASE WHEN p_size % 2 = 0 THEN 'math.CO' END], lambda x: x IS NOT NULL), ',') AS tokens FROM part")
def category_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("cs.LG, stat cs.LG, 9bad "), F.lit("x" * 40), F.when(F.col("p_size") % 2 == 0, ",math.CO").otherwise(" "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(records.category_tokens(text), ",").alias("tokens"))


@register("split_categories", "SELECT p_partkey, list_filter(list_transform(string_split(replace(p_type || '; a ,' || p_brand, ';', ','), ','), lambda x: trim(x)), lambda x: x <> '') AS categories FROM part")
def split_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", records.split_categories(F.concat("p_type", F.lit("; a ,"), "p_brand")).alias("categories"))


@register("recently_enriched", "SELECT DISTINCT o_custkey AS paper FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY")
def recently_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paper"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("updated_at"))
    return records.recently_enriched(done, "paper", "1-URGENT", datetime(1998, 1, 1), 30)


@register("newest_unenriched", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_unenriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.newest_unenriched(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), done, "o_orderkey", "o_orderdate", 50)


@register("filtered_search", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'web' AND contains(lower(text), 'the ')")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("field"), "source", F.col("text").alias("abstract"), F.lit("").alias("title"))
    return d.where(records.search_filters(field="en", source="web", text="The ")).select("doc_id")


@register("runs_of", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT')")
def runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("mode"))
    return records.runs_of(o, ["F", "P"], ["1-URGENT"]).select("o_orderkey")


@register("focused_feed", f"WITH {shapes.PAPERS_SQL} SELECT paper_id FROM papers WHERE categories[1] = 'cs.CV'")
def focused_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shapes.papers(spark, sf_dir).withColumn("primary", F.get("categories", F.lit(0)))
    return records.focused(p, "primary", "cs.CV").select("paper_id")


@register("papers_in_scope", f"WITH {shapes.PAPERS_SQL} SELECT paper_id FROM papers WHERE list_has_any(categories, ['stat.ML', 'econ'])")
def papers_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.in_scope(shapes.papers(spark, sf_dir), "categories", ["stat.ML", "econ"]).select("paper_id")


@register("marked_hits", "SELECT doc_id, (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))::INT AS is_hit FROM documents")
def marked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.marked_hits(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@register(
    "resolved_works",
    """WITH p AS (SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 3 = 0 THEN '10.1/' || p_partkey END AS doi, p_name AS title FROM part),
    w AS (SELECT p_partkey * 10 AS work_id, CASE WHEN p_partkey % 2 = 0 THEN '10.1/' || p_partkey END AS doi, p_name AS title, p_partkey AS paper_id FROM part WHERE p_partkey % 5 <> 0)
    SELECT p.paper_id, coalesce(d.work_id, t.work_id) AS work_id, CASE WHEN d.work_id IS NOT NULL THEN 'doi' WHEN t.work_id IS NOT NULL THEN 'title' END AS how
    FROM p LEFT JOIN w d ON d.doi = p.doi LEFT JOIN w t ON t.paper_id = p.paper_id""",
)
def resolved_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    papers = p.select(k.alias("paper_id"), F.when(k % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), k.cast("string"))).alias("doi"), F.concat(F.upper("p_name"), F.lit("  ")).alias("title"))
    works = p.where(k % 5 != 0).select((k * 10).alias("work_id"), F.when(k % 2 == 0, F.concat(F.lit("10.1/"), k.cast("string"))).alias("doi"), F.col("p_name").alias("title"), k.alias("paper_id"))
    return records.resolved_works(papers, works)


@register("indexed_endpoints", f"WITH RECURSIVE {shapes.EDGES_SQL}, n AS (SELECT p_partkey AS id, p_partkey * 3 AS number, p_size AS t FROM part) SELECT a.number AS src, b.number AS dst, a.t AS t_src, b.t AS t_dst FROM edges e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst")
def indexed_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 3).alias("number"), F.col("p_size").alias("t"))
    return records.indexed_endpoints(shapes.edges(spark, sf_dir), nodes)


@register("category_lists", "SELECT l_orderkey AS paper, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS categories FROM lineitem GROUP BY 1")
def category_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.concat("l_returnflag", "l_linestatus").alias("category"))
    return records.category_lists(pairs, "paper", "category")


@register("multi_version_papers", "SELECT count(*) AS papers FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1)")
def multi_version_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = shapes.versions(spark, sf_dir).groupBy("paper_id").agg(F.countDistinct("version").alias("n"))
    return each.where("n > 1").agg(F.count("*").alias("papers"))


# --- publishing -----------------------------------------------------------------------------------


@register("joined_vectors", "SELECT d.doc_id, d.lang, e.embedding FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id")
def joined_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    shard = lambda c: F.floor(F.col(c) / 100).alias("shard")
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", shard("doc_id"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", shard("vec_id"))
    vectors = vectors.join(documents.select("shard").distinct(), "shard", "left_semi")  # there are more vectors than documents here
    return publishing.joined_vectors(documents, vectors).select("doc_id", "lang", "embedding")


@register("attached_pulses", f"{_R} SELECT c.id, l.quality AS quality FROM cohort c LEFT JOIN labels l ON l.doc_id = c.id")
def attached_pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pulses = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return publishing.attached_pulses(shapes.cohort(spark, sf_dir).select("id"), pulses, "id").select("id", "pulse.quality")


@register("shard_status", "WITH e AS (SELECT DISTINCT doc_id // 50 AS shard FROM documents), p AS (SELECT DISTINCT doc_id // 50 AS shard FROM labels WHERE quality = 1) SELECT CASE WHEN count(p.shard) < count(*) THEN 'partial' ELSE 'complete' END AS status, count(*) AS expected, count(p.shard) AS produced, coalesce(list(e.shard ORDER BY e.shard) FILTER (WHERE p.shard IS NULL), []) AS missing FROM e LEFT JOIN p ON p.shard = e.shard")
def shard_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    shard = F.floor(F.col("doc_id") / 50).alias("shard")
    return publishing.shard_status(table(spark, sf_dir, "documents").select(shard), table(spark, sf_dir, "labels").where("quality = 1").select(shard), "shard")


@register(
    "display_order",
    f"""{_R}, x AS (SELECT *, ({_AVG.format('score')}) / (count(*) OVER (PARTITION BY field) + 1) AS p FROM cohort), t AS (SELECT *, CASE WHEN id % 10 = 0 THEN 4 WHEN p >= 0.95 THEN 1 WHEN p >= 0.8 THEN 2 ELSE 3 END AS band FROM x),
    j AS (SELECT *, row_number() OVER (PARTITION BY field, band, newcomer ORDER BY score DESC, id) - 1 AS j, sum(CASE WHEN newcomer THEN 0 ELSE 1 END) OVER (PARTITION BY field, band) AS e FROM t),
    k AS (SELECT *, CASE WHEN band = 4 THEN 0 WHEN newcomer THEN least(greatest(floor((j + 0.5) / 0.3) - j, 0), e) ELSE j END AS key, CASE WHEN band = 4 THEN 0 WHEN newcomer THEN 0 ELSE 1 END AS lane, CASE WHEN band = 4 THEN 0 ELSE j END AS j2 FROM j)
    SELECT id, row_number() OVER (PARTITION BY field ORDER BY band, key, lane, j2, id)::INT AS place FROM k""",
)
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ranking.percentile_rank(shapes.cohort(spark, sf_dir), "score", ["field"], "pct")
    tiers = F.when(F.col("id") % 10 != 0, ranking.tier(F.col("pct")))
    return publishing.display_order(c.withColumn("tier", tiers), "tier", "newcomer", "score", "id", ["field"]).select("id", "place")


@register("active_lanes", f"{_R} SELECT field, list_filter(['signals', CASE WHEN count(known) > 0 THEN 'references' END, CASE WHEN count(CASE WHEN id < 0 THEN 1 END) > 0 THEN 'none' END], lambda x: x IS NOT NULL) AS lanes FROM cohort GROUP BY 1")
def active_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = shapes.cohort(spark, sf_dir).withColumn("absent", F.when(F.col("id") < 0, 1))
    return publishing.active_lanes(c, {"signals": "score", "references": "known", "none": "absent"}, ["field"])


@register("category_snapshots", f"WITH {shapes.PAPERS_SQL}, r AS (SELECT lang, paper_id, row_number() OVER (PARTITION BY lang ORDER BY submitted_at DESC, paper_id) AS r FROM papers) SELECT lang, string_agg(paper_id::VARCHAR, ',' ORDER BY r) AS ids FROM r WHERE r <= 20 GROUP BY 1")
def category_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shapes.papers(spark, sf_dir).select("paper_id", "lang", "submitted_at")
    found = publishing.category_snapshots(p, "lang", "2026-01-01T00:00:00Z", [F.col("submitted_at").desc(), F.col("paper_id")], 20)
    ids = F.from_json("snapshot", "papers array<struct<paper_id:long>>")["papers"]["paper_id"]
    return found.select("lang", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


# --- views ----------------------------------------------------------------------------------------


@register("point_density", f"WITH {shapes.POINTS_SQL}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points), b AS (SELECT least(floor((x - x0) / ((x1 - x0) / 120)), 119)::INT AS bin_x, least(floor((y - y0) / ((y1 - y0) / 120)), 119)::INT AS bin_y FROM points, e) SELECT bin_x, bin_y, count(*) AS doc_count FROM b GROUP BY 1, 2")
def point_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shapes.points(spark, sf_dir)
    return grid.density(p, grid.whole_edges(p), 120).select("bin_x", "bin_y", "doc_count")


@register("viewport_ranges", f"WITH {shapes.POINTS_SQL} SELECT round(min(x) - 0.03 * (max(x) - min(x)), 9) AS x_min, round(max(x) + 0.03 * (max(x) - min(x)), 9) AS x_max, round(min(y) - 0.03 * (max(y) - min(y)), 9) AS y_min, round(max(y) + 0.03 * (max(y) - min(y)), 9) AS y_max FROM points")
def viewport_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = publishing.viewport_ranges(shapes.points(spark, sf_dir))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@register("dashboard_counts", "SELECT p_partkey, CASE WHEN v >= 1e9 THEN CASE WHEN v / 1e9 < 10 THEN printf('%.1fB', v / 1e9) ELSE printf('%.0fB', v / 1e9) END WHEN v >= 1e6 THEN CASE WHEN v / 1e6 < 10 THEN printf('%.1fM', v / 1e6) ELSE printf('%.0fM', v / 1e6) END WHEN v >= 1e3 THEN CASE WHEN v / 1e3 < 10 THEN printf('%.1fK', v / 1e3) ELSE printf('%.0fK', v / 1e3) END ELSE v::BIGINT::VARCHAR END AS label FROM (SELECT p_partkey, (p_partkey * p_partkey * p_size * 700 + 7)::DOUBLE AS v FROM part)")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.dashboard_count(k * k * F.col("p_size") * 700 + 7).alias("label"))


_TOP = f"WITH {_GRID}, d AS (SELECT bin_x, bin_y, count(*) AS n FROM b GROUP BY 1, 2), r AS (SELECT b.doc_id, b.title, b.year, b.submitted_at, 1 / greatest(d.n, 1)::DOUBLE AS raw, greatest(0, least(1, 1 - (epoch(max(b.submitted_at) OVER ()) - epoch(b.submitted_at)) / 86400.0 / 10)) AS rec, max(b.submitted_at) OVER () AS newest FROM b JOIN d ON b.bin_x = d.bin_x AND b.bin_y = d.bin_y), k AS (SELECT * FROM r WHERE submitted_at >= newest - INTERVAL 10 DAY), z AS (SELECT *, min(raw) OVER () AS lo, max(raw) OVER () AS hi FROM k), s AS (SELECT *, greatest(0, least(1, 0.6 * rec + 0.4 * CASE WHEN hi <= lo THEN 0 ELSE (raw - lo) / (hi - lo) END)) AS score FROM z)"


@register("latest_rows", f"{_TOP} SELECT doc_id, 'cs.LG, stat.ML' AS category_text FROM s WHERE year BETWEEN 2016 AND 2020 AND contains(title, 'point') ORDER BY round(score, 4) DESC, submitted_at DESC, doc_id LIMIT 25")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shapes.points(spark, sf_dir).withColumn("categories", F.array(F.lit("cs.LG"), F.lit("stat.ML")))
    own = grid.edges(p)
    feed = grid.latest_feed(grid.binned(p, own, 20), grid.density(p, own, 20), "submitted_at", 10)
    return publishing.latest_rows(feed, ["ai-ml"], (2020, 2016), "Point", 25).select("doc_id", "category_text")


@register("most_cited_first", f"WITH RECURSIVE {shapes.EDGES_SQL} SELECT dst AS paper, count(*) AS cites FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def most_cited_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = shapes.edges(spark, sf_dir).groupBy(F.col("dst").alias("paper")).agg(F.count("*").alias("cites"))
    return counted.orderBy(F.desc("cites"), "paper").limit(50)


# --- memory ---------------------------------------------------------------------------------------

_MEMORY = """, first AS (SELECT * FROM authored WHERE t < 50), second AS (SELECT * FROM authored WHERE t >= 50),
 s1 AS (SELECT a AS author, count(*) AS n, max(t) AS last FROM (SELECT DISTINCT paper_id, t, unnest(authors) AS a FROM first) GROUP BY 1 HAVING max(t) >= 49 - 24),
 s2 AS (SELECT a AS author, count(*) AS n, max(t) AS last FROM (SELECT DISTINCT paper_id, t, unnest(authors) AS a FROM second) GROUP BY 1),
 m AS (SELECT author, sum(n)::BIGINT AS n, max(last)::INT AS last FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY 1 HAVING max(last) >= (SELECT max(t) FROM authored) - 24)"""


def _memory(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    papers = shapes.authored(spark, sf_dir).withColumn("terms", F.transform("authors", lambda a: F.substring(a, 1, 2)))
    first, second = papers.where("t < 50"), papers.where("t >= 50")
    return incremental.folded(incremental.folded(None, first, 49), second, papers.agg(F.max("t")).first()[0])


@register("memory_authors", f"{_A}{_MEMORY} SELECT author, n, last FROM m")
def memory_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memory(spark, sf_dir)["authors"].select("author", "n", "last")


@register("memory_volume", f"{_A} SELECT t::INT AS month, count(*) AS n FROM authored WHERE t >= (SELECT max(t) FROM authored) - 24 GROUP BY 1")
def memory_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memory(spark, sf_dir)["volume"]


@register("memory_terms", f"{_A}, x AS (SELECT paper_id, t, unnest(list_distinct(list_transform(authors, lambda a: substr(a, 1, 2)))) AS term FROM authored) SELECT term, t::INT AS month, count(*) AS df FROM x WHERE t >= (SELECT max(t) FROM authored) - 24 GROUP BY 1, 2")
def memory_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memory(spark, sf_dir)["terms"]

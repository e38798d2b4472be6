"""Queries over the driver's tables, one or more for each operator of the library, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fixed, scalars
from sparkloom.operators import graph, grid, ordering, ranking, serving, tables, vectors
from sparkloom.plans import shapes
from sparkloom.plans.registry import register
from sparkloom.session import table
from sparkloom.streaming import incremental


@register(
    "q1_pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_discount), 6) AS avg_disc,
              count(*) AS n_lines
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n_lines")
    )


# --- versions, merges, set operations -----------------------------------------------------------


@register(
    "latest_versions_all_ties",
    f"""WITH {shapes.VERSIONS_SQL} SELECT v.paper_id, v.version, round(sum(v.price), 2) AS price, count(*) AS n FROM versions v
    JOIN (SELECT paper_id, max(version) AS m FROM versions GROUP BY 1) t ON t.paper_id = v.paper_id AND t.m = v.version GROUP BY 1, 2""",
)
def latest_versions_all_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = tables.latest_versions(shapes.versions(spark, sf_dir), "paper_id", "version")
    return top.groupBy("paper_id", "version").agg(F.round(F.sum("price"), 2).alias("price"), F.count("*").alias("n"))


@register(
    "latest_version_one_row",
    f"""WITH {shapes.VERSIONS_SQL} SELECT paper_id, version, l_partkey, price, updated_at FROM versions
    QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY version DESC, updated_at DESC, l_partkey, price) = 1""",
)
def latest_version_one_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("version").desc(), F.col("updated_at").desc(), F.col("l_partkey"), F.col("price")]
    return tables.last_by(shapes.versions(spark, sf_dir), ["paper_id"], order)


@register(
    "latest_then_since",
    f"""WITH {shapes.VERSIONS_SQL}, top AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY version DESC, updated_at DESC, l_partkey, price) = 1)
    SELECT paper_id, version, updated_at FROM top WHERE updated_at >= TIMESTAMP '1998-01-01'""",
)
def latest_then_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_version_one_row(spark, sf_dir).where(F.col("updated_at") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("paper_id", "version", "updated_at")


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"))
    old = c.where("k % 3 <> 0")
    new = c.where("k % 2 = 0").select("k", F.upper("name").alias("name"), F.when(F.col("k") % 4 == 0, F.col("v") + 1).alias("v"))
    return old, new


_MERGE = """WITH old AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0),
 new AS (SELECT c_custkey AS k, upper(c_name) AS name, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 END AS v FROM customer WHERE c_custkey % 2 = 0)"""


@register("upsert_overwrite", _MERGE + " SELECT coalesce(o.k, n.k) AS k, coalesce(o.name, n.name) AS name, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v FROM old o FULL JOIN new n ON o.k = n.k")
def upsert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.upsert(*_old_and_new(spark, sf_dir), ["k"], ["v"])


@register("upsert_keep_known", _MERGE + " SELECT coalesce(o.k, n.k) AS k, coalesce(n.name, o.name) AS name, coalesce(n.v, o.v) AS v FROM old o FULL JOIN new n ON o.k = n.k")
def upsert_keep_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.upsert(*_old_and_new(spark, sf_dir), ["k"], ["name", "v"], keep_known=True)


@register("change_kinds", _MERGE + " SELECT n.k, CASE WHEN o.name IS NULL THEN 'inserted' WHEN o.name <> n.name THEN 'updated' ELSE 'same' END AS change FROM new n LEFT JOIN old o ON o.k = n.k")
def change_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_and_new(spark, sf_dir)
    return tables.change_kinds(old, new, ["k"], "name").select("k", "change")


@register(
    "replace_children",
    """WITH target AS (SELECT DISTINCT l_orderkey AS p, l_suppkey AS c, l_linenumber AS o FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 2 = 0),
    incoming AS (SELECT l_orderkey AS p, l_suppkey AS c, l_linenumber AS o FROM lineitem WHERE l_orderkey % 6 = 0)
    SELECT p, c, o FROM target WHERE p NOT IN (SELECT p FROM incoming) UNION ALL SELECT p, c, max(o) AS o FROM incoming GROUP BY p, c""",
)
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("p"), F.col("l_suppkey").alias("c"), F.col("l_linenumber").alias("o"))
    return tables.replace_children(lines.where("o <= 2 AND p % 2 = 0").distinct(), lines.where("p % 6 = 0"), "p", "c", "o")


@register("insert_if_absent", "SELECT c_custkey AS k, c_name AS name, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, upper(c_name), CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 END FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.insert_if_absent(*_old_and_new(spark, sf_dir), ["k"])


@register("missing_labels", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@register(
    "not_enriched_by_all",
    "SELECT c_custkey FROM customer c WHERE (SELECT count(DISTINCT o_orderpriority) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority IN ('1-URGENT', '2-HIGH')) < 2",
)
def not_enriched_by_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return tables.not_in_every_source(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH"])


@register(
    "hash_sample",
    "SELECT doc_id, substr(sha1(doc_id::VARCHAR), 1, 16) AS sample_key FROM documents ORDER BY 2, 1 LIMIT 200",
)
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 200)


@register("export_shards", f"WITH {shapes.PAPERS_SQL} SELECT paper_id, ((row_number() OVER (ORDER BY year(submitted_at), paper_id) - 1) // 200)::INT AS shard FROM papers")
def export_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = shapes.papers(spark, sf_dir).select("paper_id", F.year("submitted_at").alias("y"))
    return tables.shards(own, ["y", "paper_id"], 200).select("paper_id", "shard")


@register("striped_batches", "SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) % ((SELECT count(*) FROM customer) + 399)  // 1 % (((SELECT count(*) FROM customer) + 399) // 400))::INT AS batch FROM customer")
def striped_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.stripes(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 400)


@register(
    "merge_indexes",
    """WITH l AS (SELECT p_partkey AS id, p_size AS cites, p_partkey % 7 AS refs FROM part WHERE p_partkey % 2 = 0),
    r AS (SELECT p_partkey AS id, p_size * 2 - 20 AS cites, p_partkey % 5 AS refs FROM part WHERE p_partkey % 3 = 0)
    SELECT coalesce(l.id, r.id) AS id, greatest(l.cites, r.cites) AS cites, coalesce(CASE WHEN r.refs > 0 THEN r.refs END, l.refs) AS refs FROM l FULL JOIN r ON l.id = r.id""",
)
def merge_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    left = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("cites"), (F.col("p_partkey") % 7).alias("refs"))
    right = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 2 - 20).alias("cites"), (F.col("p_partkey") % 5).alias("refs"))
    return tables.merge_max_known(left, right, "id", "cites", "refs")


@register("quality_report", """SELECT count(*) AS n, count(DISTINCT text) AS distinct_texts, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS blank,
    (SELECT count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)) AS repeated FROM documents""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "documents").groupBy("text").agg(F.count("*").alias("c"))
    blank = F.sum(F.when(F.col("text").isNull() | (F.trim("text") == ""), F.col("c")).otherwise(0))
    return per.agg(F.sum("c").alias("n"), F.count("text").alias("distinct_texts"), blank.alias("blank"), F.sum((F.col("c") > 1).cast("long")).alias("repeated"))


@register("top_sources", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@register("years_of_orders", "SELECT year(o_orderdate)::INT AS y, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def years_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@register("feed_page", f"WITH {shapes.PAPERS_SQL} SELECT paper_id, submitted_at FROM papers ORDER BY submitted_at DESC, paper_id OFFSET 20 LIMIT 30")
def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page(shapes.papers(spark, sf_dir).select("paper_id", "submitted_at"), [F.col("submitted_at").desc(), F.col("paper_id")], 20, 30)


# --- categories, text and identifiers ------------------------------------------------------------


@register("taxonomy_match", f"WITH {shapes.PAPERS_SQL} SELECT paper_id FROM papers WHERE len(list_filter(categories, lambda c: c = 'cs' OR starts_with(c, 'cs.') OR c = 'hep-th')) > 0")
def taxonomy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.papers(spark, sf_dir).where(scalars.has_category(F.col("categories"), ["cs", "hep-th"])).select("paper_id")


@register(
    "topic_facets",
    f"""WITH {shapes.PAPERS_SQL}, k AS (SELECT DISTINCT paper_id, CASE WHEN c IN ('cs.lg', 'stat.ml') THEN 'ai-ml' WHEN c = 'cs.cv' THEN 'vision-language' WHEN c = 'cs.dm' OR starts_with(c, 'math.') THEN 'math-stats'
      WHEN starts_with(c, 'q-bio.') OR c = 'physics.bio-ph' THEN 'bio-complex' WHEN c = 'hep-th' THEN 'space-high-energy' ELSE 'other' END AS facet
      FROM (SELECT paper_id, lower(unnest(categories)) AS c FROM papers))
    SELECT facet, count(*) AS n, list_position(['ai-ml', 'vision-language', 'systems-software', 'robotics-control', 'math-stats', 'bio-complex', 'space-high-energy', 'physics-quantum', 'econ-finance', 'other'], facet)::INT AS place FROM k GROUP BY facet""",
)
def topic_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.facets(shapes.papers(spark, sf_dir), scalars.topic_keys(F.col("categories")), [g[0] for g in fixed.TOPIC_GROUPS])


@register("topic_filter", f"WITH {shapes.PAPERS_SQL} SELECT paper_id FROM papers WHERE len(list_filter(list_transform(categories, lambda c: lower(c)), lambda c: c IN ('cs.ai', 'cs.lg', 'stat.ml', 'cs.ne') OR c = 'q-bio' OR starts_with(c, 'q-bio.'))) > 0")
def topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.papers(spark, sf_dir).where(scalars.in_topic(F.col("categories"), ["ai-ml", "Q-Bio"])).select("paper_id")


@register("content_hash", f"WITH {shapes.PAPERS_SQL} SELECT paper_id, sha256(lower(trim(title)) || '||' || lower(trim(abstract)) || '||' || array_to_string(list_sort(list_transform(categories, lambda c: lower(trim(c)))), '|')) AS content_hash FROM papers")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shapes.papers(spark, sf_dir)
    return p.select("paper_id", scalars.content_hash(F.col("title"), F.col("abstract"), F.col("categories")).alias("content_hash"))


@register("author_uid", "SELECT c_custkey, 'name:' || substr(sha1(lower(trim(regexp_replace(c_name || '  X ', '\\s+', ' ', 'g')))), 1, 24) AS uid FROM customer")
def author_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.author_uid(F.concat("c_name", F.lit("  X "))).alias("uid"))


@register(
    "paper_identifiers",
    """WITH i AS (SELECT p_partkey, 'http://arxiv.org/abs/' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') || '.' || lpad(p_size::VARCHAR, 5, '0') || CASE WHEN p_partkey % 2 = 0 THEN 'v' || (p_partkey % 9 + 1) ELSE '' END AS id FROM part)
    SELECT p_partkey, lpad((p_partkey % 10000)::VARCHAR, 4, '0') || '.' || regexp_extract(id, '\\.(\\d{5})', 1) AS base, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 9 + 1)::INT ELSE 1 END AS version FROM i""",
)
def paper_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    tail = F.when(k % 2 == 0, F.concat(F.lit("v"), (k % 9 + 1).cast("string"))).otherwise("")
    own = F.concat(F.lit("http://arxiv.org/abs/"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad(F.col("p_size").cast("string"), 5, "0"), tail)
    return table(spark, sf_dir, "part").select("p_partkey", scalars.paper_id(own).alias("base"), scalars.paper_version(own).alias("version"))


@register(
    "text_shape",
    f"""WITH {shapes.PAPERS_SQL}, c AS (SELECT paper_id, abstract, trim(regexp_replace(abstract, '\\s+', ' ', 'g')) AS own FROM papers)
    SELECT paper_id, CASE WHEN own = '' THEN 0 ELSE len(string_split(own, ' ')) END::INT AS abstract_words,
      ((length(abstract) - length(replace(abstract, '. ', ''))) // 2 + 1)::INT AS abstract_sentences, contains(abstract, ':') AS has_colon,
      regexp_matches(abstract, '^[A-Z][A-Za-z0-9\\-]{{2,}}\\s*:') AS has_named_system, regexp_matches(abstract, '\\d+\\.?\\d*\\s*%') AS has_numbers FROM c""",
)
def text_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("abstract")
    return shapes.papers(spark, sf_dir).select(
        "paper_id",
        scalars.word_number(a).alias("abstract_words"),
        scalars.sentence_number(a).alias("abstract_sentences"),
        F.contains(a, F.lit(":")).alias("has_colon"),
        scalars.has_named_system(a).alias("has_named_system"),
        scalars.has_percentage(a).alias("has_numbers"),
    )


#: Term lists of the counts, and words that invented prose holds more of.
_LISTS = {"claims": fixed.CLAIM_TERMS, "hedges": fixed.HEDGE_TERMS, "common": ("the", "and", "in ")}
_COUNTS = ", ".join("(" + " + ".join(f"(length(x) - length(replace(x, '{t}', ''))) // {len(t)}" for t in terms) + f")::INT AS {name}" for name, terms in _LISTS.items())


@register("term_counts", f"SELECT doc_id, {_COUNTS} FROM (SELECT doc_id, lower(text) AS x FROM documents)")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[scalars.term_count(F.col("text"), terms).alias(name) for name, terms in _LISTS.items()])


_STOP = "[" + ", ".join(f"'{x}'" for x in sorted(set(fixed.STOPWORDS.split()))) + "]"
_TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]+'), lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x))"


@register("topic_tokens", f"SELECT doc_id, len({_TOKENS})::INT AS n_tokens, array_to_string({_TOKENS}[1:5], ' ') AS first_tokens FROM documents")
def topic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scalars.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", own.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.array_join(F.slice("t", 1, 5), " ").alias("first_tokens"))


@register(
    "text_search",
    f"WITH {shapes.PAPERS_SQL} SELECT paper_id, title FROM papers WHERE contains(lower(title), 'the') OR contains(lower(abstract_preview), 'que ')",
)
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shapes.papers(spark, sf_dir)
    return p.where(F.contains(F.lower("title"), F.lit("the")) | F.contains(F.lower("abstract_preview"), F.lit("que "))).select("paper_id", "title")


@register("compact_counts", "SELECT p_partkey, CASE WHEN v >= 1000000 THEN printf('%.1fM', v / 1000000) WHEN v >= 10000 THEN floor(v / 1000 + 0.5)::BIGINT || 'k' WHEN v >= 1000 THEN printf('%.1fk', v / 1000) ELSE v::BIGINT::VARCHAR END AS label FROM (SELECT p_partkey, (p_partkey * p_size * 7)::DOUBLE AS v FROM part)")
def compact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.compact_count(F.col("p_partkey") * F.col("p_size") * 7).alias("label"))


@register("calibrated", f"""WITH g AS (SELECT {list(fixed.CALIBRATION)} AS g), c AS (SELECT c_custkey, (c_custkey % 1001) / 1000.0 AS p FROM customer),
    i AS (SELECT *, least(floor(p * 40), 39)::INT AS i FROM c)
    SELECT c_custkey, round(g[i + 1] + (p * 40 - i) * (g[i + 2] - g[i + 1]), 8) AS probability FROM i, g""")
def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("c_custkey") % 1001) / 1000.0
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(scalars.calibrate(p), 8).alias("probability"))


@register("xml_and_bibtex", "SELECT s_suppkey, replace(replace(s_name || ' <&>', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;') AS xml, regexp_replace(s_name || ' 5% & #', '([%&#])', '\\\\\\1', 'g') AS bib FROM supplier")
def xml_and_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", scalars.xml_escape(F.concat("s_name", F.lit(" <&>"))).alias("xml"), scalars.bib_escape(F.concat("s_name", F.lit(" 5% & #"))).alias("bib"))


# --- maps ------------------------------------------------------------------------------------------

_GRID = shapes.POINTS_SQL + """, q AS (SELECT quantile_cont(x, 0.005) AS xl, quantile_cont(x, 0.995) AS xh, quantile_cont(y, 0.005) AS yl, quantile_cont(y, 0.995) AS yh FROM points),
 g AS (SELECT xl - 0.03 * greatest(xh - xl, 1e-6) AS x_lo, xl + 1.03 * greatest(xh - xl, 1e-6) AS x_hi, yl - 0.03 * greatest(yh - yl, 1e-6) AS y_lo, yl + 1.03 * greatest(yh - yl, 1e-6) AS y_hi FROM q),
 b AS (SELECT points.*, g.*, greatest(0, least(19, floor((x - x_lo) / ((x_hi - x_lo) / 20))))::INT AS bin_x, greatest(0, least(19, floor((y - y_lo) / ((y_hi - y_lo) / 20))))::INT AS bin_y FROM points, g)"""


@register("density_grid", f"WITH {_GRID} SELECT bin_x, bin_y, count(*) AS doc_count, round(any_value(x_lo + (bin_x + 0.5) * (x_hi - x_lo) / 20), 9) AS x_center, round(any_value(y_lo + (bin_y + 0.5) * (y_hi - y_lo) / 20), 9) AS y_center FROM b GROUP BY 1, 2")
def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shapes.points(spark, sf_dir)
    return grid.density(p, grid.edges(p), 20).withColumn("x_center", F.round("x_center", 9)).withColumn("y_center", F.round("y_center", 9))


@register(
    "latest_feed",
    f"""WITH {_GRID}, d AS (SELECT bin_x, bin_y, count(*) AS n FROM b GROUP BY 1, 2), r AS (SELECT b.doc_id, b.submitted_at, 1 / greatest(coalesce(d.n, 1), 1)::DOUBLE AS raw,
      greatest(0, least(1, 1 - (epoch(max(b.submitted_at) OVER ()) - epoch(b.submitted_at)) / 86400.0 / 10)) AS rec, max(b.submitted_at) OVER () AS newest FROM b LEFT JOIN d ON b.bin_x = d.bin_x AND b.bin_y = d.bin_y),
      k AS (SELECT * FROM r WHERE submitted_at >= newest - INTERVAL 10 DAY), z AS (SELECT *, min(raw) OVER () AS lo, max(raw) OVER () AS hi FROM k)
    SELECT doc_id, round(rec, 9) AS recency_score, round(CASE WHEN hi <= lo THEN 0 ELSE (raw - lo) / (hi - lo) END, 9) AS novelty_score,
      round(greatest(0, least(1, 0.6 * rec + 0.4 * CASE WHEN hi <= lo THEN 0 ELSE (raw - lo) / (hi - lo) END)), 9) AS score FROM z""",
)
def latest_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shapes.points(spark, sf_dir)
    own = grid.edges(p)
    placed = grid.binned(p, own, 20)
    feed = grid.latest_feed(placed, grid.density(p, own, 20), "submitted_at", 10)
    return feed.select("doc_id", *[F.round(c, 9).alias(c) for c in ("recency_score", "novelty_score", "score")])


@register("map_viewport", f"WITH {shapes.POINTS_SQL} SELECT doc_id, x, y, year FROM points WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AND year BETWEEN 2017 AND 2022 AND contains(lower(title), 'point 1')")
def map_viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.viewport(shapes.points(spark, sf_dir), (0.1, -0.1), (-0.1, 0.1), (2022, 2017), "POINT 1")
    return found.select("doc_id", "x", "y", "year")


# --- ranks and evaluation -------------------------------------------------------------------------

_R = "WITH " + shapes.COHORT_SQL
_AVG = "rank() OVER (PARTITION BY field ORDER BY {0}) + (count(*) OVER (PARTITION BY field, {0}) - 1) / 2"


@register("percentile_ranks", f"{_R} SELECT id, round(({_AVG.format('score')}) / (count(*) OVER (PARTITION BY field) + 1), 9) AS pct, round(({_AVG.format('score')}) / count(*) OVER (PARTITION BY field), 9) AS share FROM cohort")
def percentile_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = shapes.cohort(spark, sf_dir)
    ranked = ranking.share_rank(ranking.percentile_rank(c, "score", ["field"], "pct"), "score", ["field"], "share")
    return ranked.select("id", F.round("pct", 9).alias("pct"), F.round("share", 9).alias("share"))


_LANES = """, l AS (SELECT *, rank() OVER (PARTITION BY field ORDER BY score DESC) + (count(*) OVER (PARTITION BY field, score) - 1) / 2 AS r1,
  count(known) OVER (PARTITION BY field) AS kn, min(known) OVER (PARTITION BY field) AS lo, max(known) OVER (PARTITION BY field) AS hi,
  rank() OVER (PARTITION BY field, known IS NULL ORDER BY known DESC) + (count(*) OVER (PARTITION BY field, known) - 1) / 2 AS kr FROM cohort),
 m AS (SELECT *, CASE WHEN kn >= 8 AND lo <> hi THEN CASE WHEN known IS NULL THEN (kn + 1) / 2 ELSE kr END END AS r2 FROM l),
 f AS (SELECT *, 1 / (20 + r1) + coalesce(1 / (20 + r2), 0) AS fused FROM m),
 s AS (SELECT *, (rank() OVER (PARTITION BY field, newcomer ORDER BY round(fused, 12)) + (count(*) OVER (PARTITION BY field, newcomer, round(fused, 12)) - 1) / 2) / (count(*) OVER (PARTITION BY field, newcomer) + 1) AS pct FROM f)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = shapes.cohort(spark, sf_dir)
    ranked = ranking.average_rank(c, "score", ["field"], "r1", descending=True)
    ranked = ranking.partial_lane(ranked, "known", ["field"], "r2")
    ranked = ranked.withColumn("fused", F.round(ranking.fused([F.col("r1"), F.col("r2")]), 12))
    return ranking.percentile_rank(ranked, "fused", ["field", "newcomer"], "pct")


@register("cohort_ranking", f"{_R}{_LANES} SELECT id, round(fused, 9) AS fused, round(pct, 9) AS pct, floor(100 * pct + 0.5)::BIGINT AS score, CASE WHEN pct >= 0.95 THEN 'headline' WHEN pct >= 0.8 THEN 'notable' ELSE 'rest' END AS tier FROM s")
def cohort_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return s.select("id", F.round("fused", 9).alias("fused"), F.round("pct", 9).alias("pct"), scalars.half_up(100 * F.col("pct")).alias("score"), ranking.tier(F.col("pct")).alias("tier"))


@register(
    "quota_interleave",
    f"""{_R}, j AS (SELECT id, field, newcomer, row_number() OVER (PARTITION BY field, newcomer ORDER BY score DESC, id) - 1 AS j, sum(CASE WHEN newcomer THEN 0 ELSE 1 END) OVER (PARTITION BY field) AS e FROM cohort),
    k AS (SELECT *, CASE WHEN newcomer THEN least(greatest(floor((j + 0.5) / 0.3) - j, 0), e) ELSE j END AS key FROM j)
    SELECT id, row_number() OVER (PARTITION BY field ORDER BY key, CASE WHEN newcomer THEN 0 ELSE 1 END, j)::INT AS position FROM k""",
)
def quota_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = shapes.cohort(spark, sf_dir)
    return ranking.interleave(c, "newcomer", ["field"], [F.col("score").desc(), F.col("id")]).select("id", "position")


@register("small_cohorts", "SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY k) < 12 THEN '(small fields)' ELSE k END AS cohort FROM (SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_custkey % 50 < 2 THEN ' ' ELSE (o_custkey % 977)::VARCHAR END), ''), 'unknown') AS k FROM orders)")
def small_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("o_custkey") % 50 < 2, " ").otherwise((F.col("o_custkey") % 977).cast("string"))
    return ranking.cohort(table(spark, sf_dir, "orders").select("o_orderkey", k.alias("k")), F.col("k"), "cohort").select("o_orderkey", "cohort")


@register("auc_by_cohort", f"{_R}, r AS (SELECT *, {_AVG.format('score')} AS r FROM cohort) SELECT field, count(*) AS n, sum(hit)::BIGINT AS positives, round((sum(CASE WHEN hit = 1 THEN r END) - sum(hit) * (sum(hit) + 1) / 2) / (sum(hit) * (count(*) - sum(hit))), 9) AS auc FROM r GROUP BY field")
def auc_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.auc(shapes.cohort(spark, sf_dir), "score", "hit", ["field"]).withColumn("auc", F.round("auc", 9))


@register("ndcg_by_cohort", f"{_R}, r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, id) AS r, row_number() OVER (PARTITION BY field ORDER BY label DESC, id) AS i, ln(1 + label) AS g FROM cohort) SELECT field, round(sum(CASE WHEN r <= 10 THEN g / log2(r + 1) END) / sum(CASE WHEN i <= 10 THEN g / log2(i + 1) END), 9) AS ndcg FROM r GROUP BY field")
def ndcg_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ndcg(shapes.cohort(spark, sf_dir), "score", "label", "id", ["field"], 10).withColumn("ndcg", F.round("ndcg", 9))


@register("top_k_quality", f"{_R}, r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, id) AS r, ({_AVG.format('score')}) / count(*) OVER (PARTITION BY field) AS p FROM cohort) SELECT field, round(sum(CASE WHEN r <= 25 THEN hit ELSE 0 END) / sum(hit), 9) AS recall, round((sum(CASE WHEN r <= 25 THEN hit ELSE 0 END) / least(25, count(*))) / (sum(hit) / count(*)), 9) AS lift, round(quantile_cont(CASE WHEN hit = 1 THEN p END, 0.5), 9) AS median_percentile FROM r GROUP BY field")
def top_k_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.top_k_quality(shapes.cohort(spark, sf_dir), "score", "hit", "id", ["field"], 25)
    return found.select("field", *[F.round(c, 9).alias(c) for c in ("recall", "lift", "median_percentile")])


@register("spearman_by_cohort", f"{_R}, r AS (SELECT *, {_AVG.format('score')} AS a, {_AVG.format('label')} AS b FROM cohort) SELECT field, round(corr(a, b), 9) AS spearman FROM r GROUP BY field")
def spearman_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.spearman(shapes.cohort(spark, sf_dir), "score", "label", ["field"]).withColumn("spearman", F.round("spearman", 9))


@register("overlap_at_k", f"{_R}, r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, id) AS a, row_number() OVER (PARTITION BY field ORDER BY label DESC, id) AS b FROM cohort) SELECT field, sum(CASE WHEN a <= 50 AND b <= 50 THEN 1 ELSE 0 END) / 50 AS overlap FROM r GROUP BY field")
def overlap_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.overlap_at_k(shapes.cohort(spark, sf_dir), "score", "label", "id", ["field"], 50)


@register("tier_gaps", f"{_R}{_LANES}, t AS (SELECT id, field, CASE WHEN pct >= 0.95 THEN 'headline' WHEN pct >= 0.8 THEN 'notable' ELSE 'rest' END AS tier, pct FROM s) SELECT id, coalesce(tier <> lag(tier) OVER (PARTITION BY field ORDER BY round(pct, 9) DESC, id), true) AS heading FROM t")
def tier_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).withColumn("tier", ranking.tier(F.col("pct")))
    before = ordering.lagged(s, ["field"], [F.round("pct", 9).desc(), F.col("id")], "tier", "above")
    return before.select("id", F.coalesce(F.col("tier") != F.col("above"), F.lit(True)).alias("heading"))


# --- graphs, authors and terms ------------------------------------------------------------------------

_E = "WITH RECURSIVE " + shapes.EDGES_SQL


@register("causal_edges", f"{_E} SELECT src, dst, t_src, t_dst FROM edges WHERE t_src >= t_dst")
def causal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.causal_edges(shapes.edges(spark, sf_dir))


@register(
    "pagerank_three_rounds",
    f"""{_E}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), n AS (SELECT count(*)::DOUBLE AS n FROM nodes), o AS (SELECT src, count(*)::DOUBLE AS k FROM edges GROUP BY 1),
    r0 AS (SELECT node, 1 / n AS rank FROM nodes, n)"""
    + "".join(
        f""", r{i} AS (SELECT d.node, 0.15 / n.n + 0.85 * (coalesce(g.got, 0) + l.loose / n.n) AS rank FROM r{i - 1} d CROSS JOIN n
      CROSS JOIN (SELECT coalesce(sum(r.rank), 0) AS loose FROM r{i - 1} r WHERE r.node NOT IN (SELECT src FROM o)) l
      LEFT JOIN (SELECT e.dst, sum(r.rank / o.k) AS got FROM edges e JOIN r{i - 1} r ON r.node = e.src JOIN o ON o.src = e.src GROUP BY 1) g ON g.dst = d.node)"""
        for i in range(1, 4)
    )
    + " SELECT node, round(rank, 9) AS rank FROM r3",
)
def pagerank_three_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(shapes.edges(spark, sf_dir), 3).withColumn("rank", F.round("rank", 9))


@register("citations_by_month", f"{_E} SELECT dst AS paper, t_src AS month, count(*) AS cites, sum(count(*)) OVER (PARTITION BY dst ORDER BY t_src)::BIGINT AS upto FROM edges GROUP BY 1, 2")
def citations_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cumulative_citations(shapes.edges(spark, sf_dir))


@register("citation_state", f"{_E} SELECT dst AS paper, count(*) AS degree, sum((t_src BETWEEN 28 AND 39)::INT)::BIGINT AS vel12, sum((t_src BETWEEN 34 AND 39)::INT)::BIGINT AS recent6, sum((t_src BETWEEN 28 AND 33)::INT)::BIGINT AS prior6 FROM edges WHERE t_src < 40 GROUP BY 1")
def citation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.citation_state(shapes.edges(spark, sf_dir), 40)


@register("future_citations", f"{_E}, p AS (SELECT DISTINCT dst AS paper, t_dst AS t FROM edges) SELECT p.paper, count(e.dst) AS label FROM p LEFT JOIN edges e ON e.dst = p.paper AND e.t_src > p.t + 2 AND e.t_src <= p.t + 24 GROUP BY 1")
def future_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = shapes.edges(spark, sf_dir)
    return graph.future_citations(e, e.select(F.col("dst").alias("paper"), F.col("t_dst").alias("t")).distinct(), 2, 24)


@register(
    "reference_features",
    f"""{_E}, s AS (SELECT dst AS paper, count(*) AS degree, sum((t_src BETWEEN 28 AND 39)::INT) AS vel12 FROM edges WHERE t_src < 40 GROUP BY 1)
    SELECT e.src AS paper, count(*) AS n_refs, round(avg(e.t_src - e.t_dst), 9) AS age_mean, min(e.t_src - e.t_dst) AS age_min, round(stddev_pop(e.t_src - e.t_dst), 9) AS age_std, round(avg((e.t_src - e.t_dst <= 6)::INT), 9) AS share_6,
    round(ln(1 + sum(coalesce(s.degree, 0))), 9) AS degree_sum, round(avg(ln(1 + coalesce(s.degree, 0))), 9) AS degree_mean, round(ln(1 + max(coalesce(s.degree, 0))), 9) AS degree_max FROM edges e LEFT JOIN s ON s.paper = e.dst GROUP BY 1""",
)
def reference_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.reference_features(shapes.edges(spark, sf_dir), 40)
    return found.select("paper", "n_refs", "age_min", *[F.round(c, 9).alias(c) for c in ("age_mean", "age_std", "share_6", "degree_sum", "degree_mean", "degree_max")])


@register(
    "cocitation_novelty",
    f"""{_E}, history AS (SELECT src, dst FROM edges WHERE t_src < 60), cited AS (SELECT dst, count(*) AS k FROM history GROUP BY 1),
    citing AS (SELECT src, count(*) AS s FROM history GROUP BY 1), slots AS (SELECT sum(s)::DOUBLE AS m, sum(s * (s - 1))::DOUBLE AS sk FROM citing),
    met AS (SELECT x.dst AS a, y.dst AS b, count(*) AS obs FROM history x JOIN history y ON x.src = y.src AND x.dst < y.dst GROUP BY 1, 2),
    placed AS (SELECT src AS paper, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS i, count(*) OVER (PARTITION BY src) AS n FROM edges WHERE t_src = 60),
    own AS (SELECT paper, dst FROM placed WHERE n <= 40 OR i IN (SELECT (j * n) // 40 FROM range(0, 40) r(j))),
    z AS (SELECT p.paper, coalesce(met.obs, 0) AS obs, greatest(sk * coalesce(ka.k, 0) * coalesce(kb.k, 0) / (m * m), 1e-6) AS ex
      FROM own p JOIN own q ON p.paper = q.paper AND p.dst < q.dst CROSS JOIN slots LEFT JOIN met ON met.a = p.dst AND met.b = q.dst LEFT JOIN cited ka ON ka.dst = p.dst LEFT JOIN cited kb ON kb.dst = q.dst),
    scored AS (SELECT paper, quantile_cont((obs - ex) / sqrt(ex), 0.5) AS z_median, quantile_cont((obs - ex) / sqrt(ex), 0.1) AS z_low, avg(((obs - ex) / sqrt(ex) <= 0)::INT) AS share_new FROM z GROUP BY 1)
    SELECT o.paper, round(coalesce(z_median, 0), 6) AS z_median, round(coalesce(z_low, 0), 6) AS z_low, round(coalesce(share_new, 0), 9) AS share_new FROM (SELECT DISTINCT paper FROM own) o LEFT JOIN scored s ON s.paper = o.paper""",
)
def cocitation_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.cocitation_novelty(shapes.edges(spark, sf_dir), 60, 40)
    return found.select("paper", F.round("z_median", 6).alias("z_median"), F.round("z_low", 6).alias("z_low"), F.round("share_new", 9).alias("share_new"))


_A = "WITH " + shapes.AUTHORED_SQL
_STATE = """, f AS (SELECT DISTINCT paper_id, t, unnest(authors) AS author FROM authored), own AS (SELECT author, count(*) AS n, max(t) AS last FROM f WHERE t < 60 GROUP BY 1),
 co AS (SELECT x.author, count(DISTINCT y.author) AS deg FROM f x JOIN f y ON x.paper_id = y.paper_id AND x.author <> y.author WHERE x.t < 60 GROUP BY 1),
 state AS (SELECT own.author, n, last, coalesce(deg, 0) AS deg FROM own LEFT JOIN co ON co.author = own.author)"""


@register("author_state", f"{_A}{_STATE} SELECT author, n, last::INT AS last, deg FROM state")
def author_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.author_state(shapes.authored(spark, sf_dir), 60)


@register(
    "author_features",
    f"""{_A}{_STATE} SELECT f.paper_id, count(*) AS team_size, round(avg((coalesce(n, 0) = 0)::INT), 9) AS author_new_frac, max(coalesce(n, 0)) AS author_prior_max, round(ln(1 + avg(coalesce(n, 0))), 9) AS author_prior_mean, (60 - max(coalesce(last, -999)))::INT AS author_recency,
    round(ln(1 + max(coalesce(deg, 0))), 9) AS author_degree_max, round(ln(1 + sum(coalesce(deg, 0))), 9) AS author_reach FROM f LEFT JOIN state s ON s.author = f.author WHERE f.t = 60 GROUP BY 1""",
)
def author_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = shapes.authored(spark, sf_dir)
    found = graph.author_features(p.where("t = 60"), graph.author_state(p, 60), 60, "paper_id")
    return found.select("paper_id", "team_size", "author_prior_max", "author_recency", *[F.round(c, 9).alias(c) for c in ("author_new_frac", "author_prior_mean", "author_degree_max", "author_reach")])


_TERMS = f"terms AS (SELECT doc_id AS paper_id, (doc_id % 40)::INT AS t, {_TOKENS} AS terms FROM documents)"


def _term_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("paper_id"), (F.col("doc_id") % 40).cast("int").alias("t"), scalars.tokens(F.col("text")).alias("terms"))


@register(
    "term_bursts",
    f"""WITH {_TERMS}, c AS (SELECT sum((t BETWEEN 30 AND 35)::INT) AS nr, sum((t BETWEEN 12 AND 29)::INT) AS nb FROM terms WHERE t < 36),
    f AS (SELECT t, unnest(list_distinct(terms)) AS term FROM terms WHERE t < 36), s AS (SELECT term, count(*) AS df, sum((t BETWEEN 30 AND 35)::INT)::BIGINT AS df_recent, sum((t BETWEEN 12 AND 29)::INT)::BIGINT AS df_base FROM f GROUP BY 1)
    SELECT term, df, df_recent, df_base, round(ln((df_recent + 0.5) / greatest(nr, 1)) - ln((df_base + 0.5) / greatest(nb, 1)), 9) AS burst FROM s, c""",
)
def term_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.term_state(_term_papers(spark, sf_dir), 36).withColumn("burst", F.round("burst", 9))


@register(
    "tfidf_centroid",
    f"""WITH {_TERMS}, n AS (SELECT count(*) AS n FROM terms), tf AS (SELECT paper_id, term, count(*) AS tf FROM (SELECT paper_id, unnest(terms) AS term FROM terms) GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2), w AS (SELECT tf.paper_id, tf.term, tf.tf * (ln((1 + n) / (1 + df)) + 1) AS w, n FROM tf JOIN df ON df.term = tf.term CROSS JOIN n),
    l AS (SELECT paper_id, sqrt(sum(w * w)) AS len FROM w GROUP BY 1), u AS (SELECT w.paper_id, w.term, w.w / l.len AS u, n FROM w JOIN l ON l.paper_id = w.paper_id), c AS (SELECT term, sum(u) / any_value(n) AS c FROM u GROUP BY 1)
    SELECT u.paper_id, round(sum(u.u * c.c) / (SELECT sqrt(sum(c * c)) FROM c), 7) AS centroid_similarity FROM u JOIN c ON c.term = u.term GROUP BY 1""",
)
def tfidf_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.tfidf_similarity(_term_papers(spark, sf_dir), "paper_id", "terms").withColumn("centroid_similarity", F.round("centroid_similarity", 7))


# --- vectors -----------------------------------------------------------------------------------------


@register(
    "nearest_vectors",
    """SELECT query_id, vec_id, similarity, place FROM (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC, c.vec_id)::INT AS place
    FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) WHERE place <= 10""",
)
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return vectors.neighbours(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)


@register("vector_norms", "SELECT label, count(*) AS n, bool_and(abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 0.01) AS unit FROM embeddings GROUP BY 1")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.bool_and(F.abs(vectors.norm(F.col("embedding")) - 1) <= 0.01).alias("unit"))


@register("principal_components")
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    sample = tables.hash_sample(v.select("vec_id", "embedding"), "vec_id", 5_000)
    return vectors.principal_components(v.select("vec_id", "embedding"), sample, "embedding", 8).select("vec_id", "pca")


@register("approximate_neighbours")
def approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return vectors.approximate_neighbours(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)


# --- incremental ----------------------------------------------------------------------------------------


@register(
    "incremental_since",
    "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR",
)
def incremental_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("newest"))
    return events.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.expr("INTERVAL 48 HOURS")).select("event_id", "ts")


@register(
    "fold_author_memory",
    "SELECT 'u' || user_id AS author, count(*) AS n, max(month(ts))::INT AS last FROM events GROUP BY 1 HAVING max(month(ts)) >= 1",
)
def fold_author_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"), F.lit(1).cast("long").alias("n"), F.month("ts").alias("last"), "event_id")
    state = incremental.fold_authors(each.limit(0), each.where("event_id % 2 = 0"), 13, 12)
    return incremental.fold_authors(state, each.where("event_id % 2 = 1"), 13, 12)


@register("event_windows", "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return counted.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


# --- views -----------------------------------------------------------------------------------------------


@register("controls", f"WITH {shapes.POINTS_SQL} SELECT count(*) AS papers, min(year) AS first_year, max(year) AS last_year FROM points")
def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.controls(shapes.points(spark, sf_dir))


@register("author_search", f"WITH {shapes.AUTHORED_SQL} SELECT paper_id, t::INT AS t FROM authored WHERE list_contains(authors, 's17')")
def author_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.search(shapes.authored(spark, sf_dir), 'author: "S17"', (), "authors").select("paper_id", "t")


@register(
    "new_since_visit",
    f"""WITH {shapes.PAPERS_SQL}, m AS (SELECT paper_id, lang, strftime(submitted_at, '%Y-%m-%d') > '2020-01-20' AS is_new, submitted_at FROM papers)
    SELECT paper_id, is_new, coalesce(lag(is_new) OVER (PARTITION BY lang ORDER BY submitted_at DESC, paper_id) AND NOT is_new, false) AS caught_up FROM m""",
)
def new_since_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = shapes.papers(spark, sf_dir).withColumn("day", F.date_format("submitted_at", "yyyy-MM-dd"))
    return serving.new_since(feed, "day", "2020-01-20", ["lang"], [F.col("submitted_at").desc(), F.col("paper_id")]).select("paper_id", "is_new", "caught_up")


@register(
    "enrichment_health",
    """SELECT o_orderpriority AS source, CASE WHEN sum((o_orderkey % 3 = 0)::INT) = 0 THEN 'no-candidates' WHEN sum((o_orderkey % 6 = 0)::INT) = 0 THEN 'unreachable'
    WHEN sum((o_orderkey % 96 = 0)::INT) < 0.05 * sum((o_orderkey % 3 = 0)::INT) THEN 'no-match' ELSE 'ok' END AS status FROM orders GROUP BY 1""",
)
def enrichment_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), (k % 3 == 0).alias("q"), (k % 6 == 0).alias("a"), (k % 96 == 0).alias("m"))
    return serving.enrichment_health(rows, "source", "q", "a", "m")


@register("recent_searches", "SELECT user_id, event_type, ts, place FROM (SELECT user_id, event_type, max(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type)::INT AS place FROM events GROUP BY 1, 2) WHERE place <= 3")
def recent_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.recent_searches(table(spark, sf_dir, "events").select("user_id", "event_type", "ts"), "user_id", "event_type", "ts", 3)

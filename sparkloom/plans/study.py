"""Queries of the study's operators: as-of graph features, evaluation, baselines, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fixed
from sparkloom.operators import evaluation, graph, ranking, vectors
from sparkloom.plans import shapes
from sparkloom.plans.catalog import _A, _AVG, _E, _R, _TERMS, _term_papers
from sparkloom.plans.registry import register
from sparkloom.session import kept, table


def _rounded(frame: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    return frame.withColumns({c: F.round(c, places) for c in columns})


# --- graphs ---------------------------------------------------------------------------------------

_NODES = "nodes AS (SELECT DISTINCT src AS paper, t_src AS t FROM edges UNION SELECT dst, t_dst FROM edges)"
_ASOF = """refs AS (SELECT src, dst AS paper, t_src AS obs FROM edges),
 state AS (SELECT r.src, r.paper, r.obs, count(e.src) AS degree, coalesce(sum((e.t_src >= r.obs - 12)::INT), 0)::BIGINT AS vel12, coalesce(sum((e.t_src >= r.obs - 6)::INT), 0)::BIGINT AS recent6,
   coalesce(sum((e.t_src >= r.obs - 12 AND e.t_src < r.obs - 6)::INT), 0)::BIGINT AS prior6 FROM refs r LEFT JOIN edges e ON e.dst = r.paper AND e.t_src < r.obs GROUP BY 1, 2, 3)"""


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("paper"), F.col("t_src").alias("t")).union(edges.select("dst", "t_dst")).distinct()


@register("reference_state_as_of", f"{_E}, {_ASOF} SELECT src, paper, obs, degree, vel12, recent6, prior6 FROM state")
def reference_state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = shapes.edges(spark, sf_dir)
    return graph.state_as_of(e.select("src", F.col("dst").alias("paper"), F.col("t_src").alias("obs")), e)


_HUBS = f"""{_NODES}, deg AS (SELECT n.paper, n.t, count(e.src) AS k FROM nodes n LEFT JOIN edges e ON e.dst = n.paper AND e.t_src < 60 GROUP BY 1, 2),
 cut AS (SELECT greatest(quantile_cont(k, 0.99), 1) AS c FROM deg WHERE t < 60), hub AS (SELECT paper FROM deg, cut WHERE k >= c)"""


@register("hub_papers", f"{_E}, {_HUBS} SELECT paper FROM hub")
def hub_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = shapes.edges(spark, sf_dir)
    return graph.hubs(_nodes(e), e, 60)


@register("elite_attention", f"{_E}, {_HUBS} SELECT dst AS paper, count(*) AS attention FROM edges WHERE t_src < 60 AND src IN (SELECT paper FROM hub) GROUP BY 1")
def elite_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = shapes.edges(spark, sf_dir)
    hub = kept(graph.hubs(_nodes(e), e, 60), "hubs")  # few: stored, their size is known, and only their lines are told apart
    return graph.elite_attention(e, hub, 60)


@register(
    "reference_momentum",
    f"""{_E}, {_ASOF}, {_HUBS}, el AS (SELECT dst AS paper, count(*) AS a FROM edges WHERE t_src < 60 AND src IN (SELECT paper FROM hub) GROUP BY 1)
    SELECT s.src AS paper, round(avg(ln(1 + vel12)), 9) AS vel_mean, round(ln(1 + max(vel12)), 9) AS vel_max, round(ln(1 + sum(recent6)) - ln(1 + sum(prior6)), 9) AS acceleration,
      round(max((recent6 + 1) / (prior6 + 1)), 9) AS burst_ratio, round(avg((s.paper IN (SELECT paper FROM hub))::INT), 9) AS hub_share, round(ln(1 + avg(coalesce(el.a, 0))), 9) AS elite_attention
    FROM state s LEFT JOIN el ON el.paper = s.paper WHERE s.obs = 60 GROUP BY 1""",
)
def reference_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = shapes.edges(spark, sf_dir)
    found = graph.reference_momentum(e, _nodes(e), 60)
    return _rounded(found, "vel_mean", "vel_max", "acceleration", "burst_ratio", "hub_share", "elite_attention")


@register(
    "coauthor_pagerank",
    f"""{_A}, f AS (SELECT DISTINCT paper_id, unnest(authors) AS a FROM authored WHERE t < 60), w AS (SELECT x.a AS src, y.a AS dst, count(*)::DOUBLE AS w FROM f x JOIN f y ON x.paper_id = y.paper_id AND x.a <> y.a GROUP BY 1, 2),
    o AS (SELECT src, sum(w) AS total FROM w GROUP BY 1), every AS (SELECT DISTINCT a AS node FROM f), n AS (SELECT count(*)::DOUBLE AS n FROM every), r0 AS (SELECT node, 1 / n AS rank FROM every, n)"""
    + "".join(f", r{i} AS (SELECT d.node, 0.15 / n.n + 0.85 * coalesce(g.got, 0) AS rank FROM r{i - 1} d CROSS JOIN n LEFT JOIN (SELECT w.dst, sum(r.rank * w.w / o.total) AS got FROM w JOIN r{i - 1} r ON r.node = w.src JOIN o ON o.src = w.src GROUP BY 1) g ON g.dst = d.node)" for i in range(1, 4))
    + " SELECT node AS author, round(rank * n, 9) AS rank FROM r3, n",
)
def coauthor_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coauthor_pagerank(shapes.authored(spark, sf_dir), 60, 3).withColumn("rank", F.round("rank", 9))


_TITLES = "titles AS (SELECT paper_id, t, list_distinct(terms[1:12]) AS terms FROM terms)"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_papers(spark, sf_dir).select("paper_id", "t", F.array_distinct(F.slice("terms", 1, 12)).alias("terms"))


@register(
    "unseen_term_pairs",
    f"""WITH {_TERMS}, {_TITLES}, flat AS (SELECT paper_id, t, unnest(terms) AS w FROM titles), seen AS (SELECT DISTINCT x.w AS a, y.w AS b FROM flat x JOIN flat y ON x.paper_id = y.paper_id AND x.w < y.w WHERE x.t < 36),
    p AS (SELECT x.paper_id, x.w AS a, y.w AS b FROM flat x JOIN flat y ON x.paper_id = y.paper_id AND x.w < y.w WHERE x.t = 36)
    SELECT t.paper_id, count(p.a) AS pairs, coalesce(sum((p.a IS NOT NULL AND s.a IS NULL)::INT), 0)::BIGINT AS unseen FROM titles t LEFT JOIN p ON p.paper_id = t.paper_id LEFT JOIN seen s ON s.a = p.a AND s.b = p.b WHERE t.t = 36 GROUP BY 1""",
)
def unseen_term_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unseen_term_pairs(_titles(spark, sf_dir), 36, "paper_id")


@register(
    "term_features",
    f"""WITH {_TERMS}, c AS (SELECT count(*) AS total, sum((t BETWEEN 30 AND 35)::INT) AS nr, sum((t BETWEEN 12 AND 29)::INT) AS nb FROM terms WHERE t < 36),
    f AS (SELECT t, unnest(list_distinct(terms)) AS term FROM terms WHERE t < 36), s AS (SELECT term, count(*) AS df, sum((t BETWEEN 30 AND 35)::INT) AS dr, sum((t BETWEEN 12 AND 29)::INT) AS db FROM f GROUP BY 1),
    b AS (SELECT term, df, ln((dr + 0.5) / greatest(nr, 1)) - ln((db + 0.5) / greatest(nb, 1)) AS burst FROM s, c), own AS (SELECT paper_id, unnest(terms) AS term FROM terms WHERE t = 36),
    j AS (SELECT own.paper_id, coalesce(burst, 0) AS burst, ln(total / (coalesce(df, 0) + 1)) AS rarity FROM own CROSS JOIN c LEFT JOIN b ON b.term = own.term)
    SELECT t.paper_id, round(coalesce(avg(burst), 0), 8) AS term_burst_mean, round(coalesce(max(burst), 0), 8) AS term_burst_max, round(coalesce(avg(rarity), 0), 8) AS term_rarity FROM terms t LEFT JOIN j ON j.paper_id = t.paper_id WHERE t.t = 36 GROUP BY 1""",
)
def term_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _term_papers(spark, sf_dir)
    total = p.where("t < 36").count()
    found = graph.term_features(p.where("t = 36"), graph.term_state(p, 36), total, "paper_id")
    return _rounded(found, "term_burst_mean", "term_burst_max", "term_rarity", places=8)


@register("slot_totals", f"{_E}, s AS (SELECT src, t_src AS t, count(*) AS k FROM edges GROUP BY 1, 2), m AS (SELECT t, sum(k) AS k1, sum(k * (k - 1)) AS k2 FROM s GROUP BY 1) SELECT t AS month, sum(k1) OVER (ORDER BY t)::BIGINT AS slots, sum(k2) OVER (ORDER BY t)::BIGINT AS slot_pairs FROM m")
def slot_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.slot_totals(shapes.edges(spark, sf_dir))


@register(
    "recent_similarity",
    f"""WITH {_TERMS}, w AS (SELECT * FROM terms WHERE t >= 24 AND t < 36), n AS (SELECT count(*) AS n FROM w), c AS (SELECT paper_id, term, count(*) AS tf FROM (SELECT paper_id, unnest(terms) AS term FROM w) GROUP BY 1, 2),
    k AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf, sum(tf) AS total FROM c, n GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 20000),
    v AS (SELECT paper_id, c.term, tf * idf AS w FROM c JOIN k ON k.term = c.term), u AS (SELECT paper_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY paper_id)) AS u FROM v), m AS (SELECT term, sum(u) AS c FROM u GROUP BY 1),
    oc AS (SELECT paper_id, term, count(*) AS tf FROM (SELECT paper_id, unnest(terms) AS term FROM terms WHERE t = 36) GROUP BY 1, 2), ov AS (SELECT paper_id, oc.term, tf * idf AS w FROM oc JOIN k ON k.term = oc.term),
    ou AS (SELECT paper_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY paper_id)) AS u FROM ov), s AS (SELECT paper_id, sum(u * c) / (SELECT sqrt(sum(c * c)) FROM m) AS s FROM ou JOIN m ON m.term = ou.term GROUP BY 1)
    SELECT t.paper_id, round(CASE WHEN (SELECT n FROM n) > 50 THEN coalesce(s, 0) ELSE 0 END, 7) AS similarity FROM terms t LEFT JOIN s ON s.paper_id = t.paper_id WHERE t.t = 36""",
)
def recent_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vectors.recent_similarity(_term_papers(spark, sf_dir), "paper_id", "terms", 36, 12, features=20_000, least=50), "similarity", places=7)


# --- evaluation -----------------------------------------------------------------------------------


@register(
    "cutoff_quality",
    f"""{_R}, r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, id) AS r, quantile_cont(label, 0.9) OVER (PARTITION BY field) AS q FROM cohort)
    SELECT field, round(sum((r <= 10 AND label >= greatest(q, 1))::INT) / least(10, count(*)), 9) AS "precision", round((sum(CASE WHEN r <= 10 THEN label END) / least(10, count(*))) / avg(label), 9) AS lift,
      (max(CASE WHEN r <= 10 THEN label END) >= max(label))::INT::DOUBLE AS top1 FROM r GROUP BY field""",
)
def cutoff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.cutoff_quality(shapes.cohort(spark, sf_dir), "score", "label", "id", ["field"], 10), "precision", "lift")


@register("label_summary", f"{_R} SELECT field, count(label) AS n, round(avg(label), 9) AS mean, quantile_cont(label, 0.5) AS median, quantile_cont(label, 0.9) AS p90, max(label) AS largest, round(avg((label = 0)::INT), 9) AS zeros FROM cohort GROUP BY 1")
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.label_summary(shapes.cohort(spark, sf_dir), "label", ["field"]), "mean", "zeros")


@register("known_summary", f"{_R} SELECT field, 'known' AS value, count(known) AS known, sum((known > 0)::INT)::BIGINT AS positive, max(known) AS largest FROM cohort GROUP BY 1 UNION ALL SELECT field, 'label', count(label), sum((label > 0)::INT)::BIGINT, max(label) FROM cohort GROUP BY 1")
def known_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.known_summary(shapes.cohort(spark, sf_dir), ["field"], ["known", "label"])


@register("team_bands", f"{_A}, b AS (SELECT CASE WHEN len(authors) >= 6 THEN 6 WHEN len(authors) >= 4 THEN 4 WHEN len(authors) >= 2 THEN 2 ELSE 0 END AS band, list_contains(authors, 's1') AS m FROM authored) SELECT band::INT AS band, count(*) AS n, round(avg(m::INT), 9) AS rate FROM b GROUP BY 1")
def team_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.length_bands(shapes.authored(spark, sf_dir), "authors", [2, 4, 6], F.array_contains("authors", "s1")), "rate")


@register("orientations", f"{_R}, l AS (SELECT hit, 'score' AS feature, score AS v FROM cohort UNION ALL SELECT hit, 'label', label FROM cohort), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS r FROM l), a AS (SELECT feature, (sum(CASE WHEN hit = 1 THEN r END) - sum(hit) * (sum(hit) + 1) / 2) / (sum(hit) * (count(*) - sum(hit))) - 0.5 AS s FROM r GROUP BY 1) SELECT feature, round(s, 9) AS strength, CASE WHEN s < 0 THEN -1 ELSE 1 END::INT AS sign FROM a")
def orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.orientations(shapes.cohort(spark, sf_dir), ["score", "label"], "hit"), "strength")


_DRAWS = """numbered AS (SELECT {key} AS k, {value} AS v, row_number() OVER (ORDER BY {key}) - 1 AS number, count(*) OVER () AS n FROM {source} WHERE {value} IS NOT NULL),
 picks AS (SELECT d, ('0x' || substr(md5('boot-' || d || '-' || i), 1, 8))::BIGINT % n AS number FROM range(0, {draws}) x(d), (SELECT number AS i, n FROM numbered)),
 drawn AS (SELECT d, avg(v) AS m FROM picks p JOIN numbered b ON b.number = p.number GROUP BY 1)"""
_BALANCES = "balances AS (SELECT c_nationkey AS nation, avg(c_acctbal) AS a, avg(c_acctbal * (c_custkey % 3)) AS b FROM customer GROUP BY 1)"


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("a"), F.avg(F.col("c_acctbal") * (F.col("c_custkey") % 3)).alias("b"))


@register("bootstrap_interval", f"WITH {_BALANCES}, {_DRAWS.format(key='nation', value='a', source='balances', draws=4000)} SELECT (SELECT round(avg(a), 6) FROM balances) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, (SELECT count(a) FROM balances) AS n FROM drawn")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.bootstrap_interval(_balances(spark, sf_dir), "nation", "a", 4_000), "mean", "low", "high", places=6)


@register("paired_bootstrap", f"WITH {_BALANCES}, diffs AS (SELECT nation, a - b AS d FROM balances), {_DRAWS.format(key='nation', value='d', source='diffs', draws=4000)} SELECT (SELECT round(avg(d), 6) FROM diffs) AS delta, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg((m > 0)::INT), 9) AS p_better, (SELECT count(d) FROM diffs) AS n FROM drawn")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.paired_bootstrap(_balances(spark, sf_dir), "nation", "a", "b", 4_000), "delta", "low", "high", "p_better", places=6)


@register("tier_agreement", f"{_R}, x AS (SELECT field, id, ({_AVG.format('score')}) / (count(*) OVER (PARTITION BY field) + 1) AS a, ({_AVG.format('label')}) / (count(*) OVER (PARTITION BY field) + 1) AS b FROM cohort) SELECT field, count(*) AS n, sum((CASE WHEN a >= 0.95 THEN 2 WHEN a >= 0.8 THEN 1 ELSE 0 END = CASE WHEN b >= 0.95 THEN 2 WHEN b >= 0.8 THEN 1 ELSE 0 END)::INT)::BIGINT AS same FROM x GROUP BY 1")
def tier_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = shapes.cohort(spark, sf_dir)
    ranked = [ranking.percentile_rank(c, v, ["field"], "pct").select("field", "id", ranking.tier(F.col("pct")).alias("tier")) for v in ("score", "label")]
    return evaluation.tier_agreement(*ranked, "id", "tier", ["field"])


@register("tier_tallies", f"{_R}, x AS (SELECT *, ({_AVG.format('score')}) / (count(*) OVER (PARTITION BY field) + 1) AS a FROM cohort) SELECT field, CASE WHEN a >= 0.95 THEN 'headline' WHEN a >= 0.8 THEN 'notable' ELSE 'rest' END AS tier, count(*) AS n, sum(newcomer::INT)::BIGINT AS newcomers, sum((known IS NOT NULL)::INT)::BIGINT AS known FROM x GROUP BY 1, 2")
def tier_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ranking.percentile_rank(shapes.cohort(spark, sf_dir), "score", ["field"], "pct").withColumn("tier", ranking.tier(F.col("pct")))
    return evaluation.tallies(c, ["field", "tier"], {"newcomers": F.col("newcomer"), "known": F.col("known").isNotNull()})


@register("random_baseline", f"{_R} SELECT id, round(('0x' || substr(md5('seed' || id), 1, 8))::BIGINT / 4294967296.0, 12) AS score FROM cohort")
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.random_scores(shapes.cohort(spark, sf_dir), "id", "seed").select("id", F.round("score", 12).alias("score"))


@register("outsider_recall", f"{_R}, x AS (SELECT *, ({_AVG.format('score')}) / (count(*) OVER (PARTITION BY field) + 1) AS p FROM cohort) SELECT field, newcomer, count(*) AS hits, round(quantile_cont(p, 0.5), 9) AS percentile FROM x WHERE hit = 1 GROUP BY 1, 2")
def outsider_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.outsider_recall(shapes.cohort(spark, sf_dir), "score", "hit", "newcomer", ["field"]), "percentile")


@register("position_fade", f"{_R} SELECT id, round(1.0 - 0.8 * (row_number() OVER (PARTITION BY field ORDER BY score DESC, id) - 1) / greatest(count(*) OVER (PARTITION BY field) - 1, 1), 9) AS fade FROM cohort")
def position_fade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.position_fade(shapes.cohort(spark, sf_dir), [F.col("score").desc(), F.col("id")], ["field"])
    return found.select("id", F.round("fade", 9).alias("fade"))


@register("evaluable_months", f"{_A} SELECT t::INT AS t, count(*) AS n FROM authored WHERE t >= 12 AND t < 80 - 24 GROUP BY 1")
def evaluable_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluable_months(shapes.authored(spark, sf_dir), "t", 12, 24, 80).groupBy("t").agg(F.count("*").alias("n"))


@register("boards", f"{_A}, b AS (SELECT unnest([23, 35, 47]) AS board) SELECT board::INT AS board, (board - t)::INT AS age, count(*) AS n FROM authored JOIN b ON t <= board AND t > board - 6 GROUP BY 1, 2")
def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.boards(shapes.authored(spark, sf_dir), "t", 6, [23, 35, 47])
    return found.groupBy("board", F.col("age").cast("int").alias("age")).agg(F.count("*").alias("n"))


@register(
    "label_sweep",
    f"{_E}, p AS (SELECT DISTINCT dst AS paper, t_dst AS t FROM edges), s AS (SELECT * FROM (VALUES (0, 12), (6, 24), (12, 36)) v(w, h))"
    " SELECT s.w::INT AS window_months, s.h::INT AS horizon, count(DISTINCT p.paper) AS papers, count(e.dst) AS citations FROM s CROSS JOIN p LEFT JOIN edges e ON e.dst = p.paper AND e.t_src > p.t + s.w AND e.t_src <= p.t + s.h GROUP BY 1, 2",
)
def label_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = shapes.edges(spark, sf_dir)
    papers = e.select(F.col("dst").alias("paper"), F.col("t_dst").alias("t")).distinct()

    def run(window_months: int, horizon: int) -> DataFrame:
        return graph.future_citations(e, papers, window_months, horizon).agg(F.count("*").alias("papers"), F.sum("label").alias("citations"))

    return evaluation.sweep([{"window_months": w, "horizon": h} for w, h in ((0, 12), (6, 24), (12, 36))], run)


# --- the twelve signals ---------------------------------------------------------------------------

_SIGNALS = """signals AS (SELECT c_custkey AS id, c_mktsegment AS field, {columns} FROM customer)"""
_SIGNAL_COLUMNS = {name: f"((c_custkey * {17 + 6 * i}) % {23 + 2 * i})::DOUBLE" for i, name in enumerate(fixed.SIGNAL_WEIGHTS)}


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    values = [((F.col("c_custkey") * (17 + 6 * i)) % (23 + 2 * i)).cast("double").alias(name) for i, name in enumerate(fixed.SIGNAL_WEIGHTS)]
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("field"), *values)


_SIGNALS_SQL = "WITH " + _SIGNALS.format(columns=", ".join(f"{sql} AS {name}" for name, sql in _SIGNAL_COLUMNS.items()))
_LONG_SQL = " UNION ALL ".join(f"SELECT id, field, '{name}' AS signal, {weight} AS w, {name} AS v FROM signals" for name, weight in fixed.SIGNAL_WEIGHTS.items())
_PARTS_SQL = f"""{_SIGNALS_SQL}, l AS ({_LONG_SQL}),
 p AS (SELECT *, (rank() OVER (PARTITION BY field, signal ORDER BY v) + (count(*) OVER (PARTITION BY field, signal, v) - 1) / 2) / (count(*) OVER (PARTITION BY field, signal) + 1) AS pct FROM l)"""


@register("all_signals", f"{_PARTS_SQL}, g AS (SELECT id, field, sum(w * pct) AS total FROM p GROUP BY 1, 2), b AS (SELECT id, signal, row_number() OVER (PARTITION BY id ORDER BY round(w * (pct - 0.5), 12) DESC, signal) AS r FROM p WHERE w * (pct - 0.5) > 0) SELECT g.field, g.id, round(total + 1.23e-8, 6) AS signal_total, coalesce((SELECT string_agg(signal, ',' ORDER BY r) FROM b WHERE b.id = g.id AND r <= 3), '') AS reasons FROM g")
def all_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sums of short decimals end in ties of rounding, where engines differ by their order of adding; a shift keeps them off the border.
    found = ranking.signal_scores(_signals(spark, sf_dir), fixed.SIGNAL_WEIGHTS, ["field"], "id")
    return found.select("field", "id", F.round(F.col("signal_total") + 1.23e-8, 6).alias("signal_total"), F.array_join("reasons", ",").alias("reasons"))

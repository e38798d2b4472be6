"""Citation and co-author graphs: PageRank, time-sliced citation counts, co-citation novelty, author state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ordering import selected
from sparkloom.session import exploded, kept

#: Rounds between looks at the tolerance.
LOOK_EVERY = 5


def pagerank(edges: DataFrame, iterations: int, damping: float = 0.85, weight: str | None = None, tolerance: float | None = None, spread: bool = True, nodes: DataFrame | None = None) -> DataFrame:
    """(node, rank) of ``edges`` (src, dst) and of ``nodes`` (node) without links.

    What nodes without out-links hold is spread over all, or lost where ``spread`` is false. At most ``iterations`` rounds; with a
    ``tolerance`` they end once ranks change by less in sum, which is looked at every few rounds. Links and each round's ranks are stored in the shared folder."""
    w = [F.col(weight).cast("double").alias("w")] if weight else []
    links = kept(edges.select("src", "dst", *w), "links")
    each = links.select(F.col("src").alias("node"), (F.col("w") if weight else F.lit(1.0)).alias("w"))
    others = links.select("dst") if nodes is None else links.select("dst").union(nodes.select("node"))
    # A node's links out are summed where nodes are told apart; nodes without any have no total.
    every = kept(each.union(others.select("*", F.lit(None).cast("double"))).groupBy("node").agg(F.sum("w").alias("total")), "nodes")
    n = every.count()
    if not n:
        return every.select("node", F.lit(0.0).alias("rank"))
    state = looked_at = every.withColumn("rank", F.lit(1.0 / n))
    for i in range(1, iterations + 1):
        loose = (state.where("total IS NULL").agg(F.sum("rank")).first()[0] or 0.0) if spread else 0.0
        part = F.col("rank") / F.col("total") * (F.col("w") if weight else 1.0)
        # Parts meet by node before they are summed: sums by task would hold a row for nearly every link.
        parts = links.join(state, links["src"] == state["node"]).select("dst", part.alias("part")).repartition("dst")
        given = parts.groupBy("dst").agg(F.sum("part").alias("got"))
        joined = state.join(given, state["node"] == given["dst"], "left")
        rank = F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)
        # A round's ranks are asked for several times by the next: stored, no round derives the ones before it.
        state = kept(joined.select("node", "total", rank.alias("rank")), "ranks")
        if tolerance is not None and i % LOOK_EVERY == 0:
            moved = state.join(looked_at.select("node", F.col("rank").alias("before")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("before"))))
            if (moved.first()[0] or 0.0) < tolerance:
                break
            looked_at = state
    return state.select("node", "rank")


def causal_edges(edges: DataFrame) -> DataFrame:
    """Edges that don't cite the future."""
    return edges.where("t_src >= t_dst")


def cumulative_citations(edges: DataFrame) -> DataFrame:
    """(paper, month, cites, upto): citations by month and their running sum."""
    monthly = edges.groupBy(F.col("dst").alias("paper"), F.col("t_src").alias("month")).agg(F.count("*").alias("cites"))
    return monthly.withColumn("upto", F.sum("cites").over(Window.partitionBy("paper").orderBy("month")))


def citation_state(edges: DataFrame, month: int) -> DataFrame:
    """(paper, degree, vel12, recent6, prior6) as of ``month``, from earlier citations only."""
    within = lambda a, b: F.sum(F.col("t_src").between(month - a, month - b).cast("long"))
    return edges.where(F.col("t_src") < month).groupBy(F.col("dst").alias("paper")).agg(F.count("*").alias("degree"), within(12, 1).alias("vel12"), within(6, 1).alias("recent6"), within(12, 7).alias("prior6"))


def future_citations(edges: DataFrame, papers: DataFrame, window: int, horizon: int) -> DataFrame:
    """(paper, label): citations in (t + window, t + horizon]."""
    e = edges.select("dst", "t_src")
    joined = papers.join(e, (papers["paper"] == e["dst"]) & e["t_src"].between(papers["t"] + window + 1, papers["t"] + horizon), "left")
    return joined.groupBy(papers["paper"]).agg(F.count("dst").alias("label"))


def reference_features(edges: DataFrame, month: int) -> DataFrame:
    """Per citing paper: statistics of its references' age and standing as of ``month``."""
    state = citation_state(edges, month)
    refs = edges.join(state, edges["dst"] == state["paper"], "left").select("src", (F.col("t_src") - F.col("t_dst")).alias("age"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("vel12", F.lit(0)).alias("vel12"))
    # References meet by paper before they are summed: sums by task would hold a row of a dozen numbers for nearly every reference.
    return refs.repartition("src").groupBy(F.col("src").alias("paper")).agg(
        F.count("*").alias("n_refs"),
        F.avg("age").alias("age_mean"),
        F.min("age").alias("age_min"),
        F.stddev_pop("age").alias("age_std"),
        F.avg((F.col("age") <= 6).cast("double")).alias("share_6"),
        F.avg((F.col("age") <= 12).cast("double")).alias("share_12"),
        F.log1p(F.sum("degree")).alias("degree_sum"),
        F.avg(F.log1p("degree")).alias("degree_mean"),
        F.log1p(F.max("degree")).alias("degree_max"),
        F.log1p(F.sum("vel12")).alias("vel_sum"),
    )


def pairs_of(items: Column) -> Column:
    """Ordered pairs (a < b) of an array's distinct items, within the row."""
    own = F.array_sort(F.array_distinct(items))
    return F.flatten(F.transform(own, lambda a, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def thinned(items: Column, most: int) -> Column:
    """At most ``most`` items at a fixed stride."""
    n = F.size(items)
    return F.when(n <= most, items).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(items, F.floor(i * n / most).cast("int"))))


def reference_lists(edges: DataFrame) -> DataFrame:
    """(paper, t, refs), whole and without repeats; a reference list is as long as one paper's, so the list fits a row."""
    return edges.groupBy(F.col("src").alias("paper"), F.col("t_src").alias("t")).agg(F.array_sort(F.collect_set("dst")).alias("refs"))


def cocitation_novelty(edges: DataFrame, month: int, most: int = 40) -> DataFrame:
    """(paper, z_median, z_low, share_new) over pairs of references: observed against expected co-citations before ``month``.

    History is counted over whole reference lists; only the list of a paper that is scored is thinned to ``most``. A paper
    with fewer than two references has no pairs and gets 0 for all three.
    Pairs of history are made of references that a scored paper has, since no other pair is looked up."""
    before = edges.where(F.col("t_src") < month)
    scored_lists = reference_lists(edges.where(F.col("t_src") == month)).select("paper", thinned(F.col("refs"), most).alias("refs"))
    wanted = scored_lists.select(F.explode("refs").alias("dst")).distinct()
    seen = reference_lists(before.join(wanted, "dst", "left_semi")).select(F.inline(pairs_of(F.col("refs")))).groupBy("a", "b").agg(F.count("*").alias("obs"))
    degree = before.groupBy(F.col("dst").alias("paper")).agg(F.count("*").alias("k"))
    slots = before.groupBy("src", "t_src").agg(F.count("*").alias("s"))
    totals = slots.agg(F.sum("s").alias("m"), F.sum(F.col("s") * (F.col("s") - 1)).alias("sk"))
    now = scored_lists.select("paper", F.inline(pairs_of(F.col("refs"))))
    ka, kb = degree.toDF("a", "ka"), degree.toDF("b", "kb")
    joined = now.join(seen, ["a", "b"], "left").join(ka, "a", "left").join(kb, "b", "left").crossJoin(F.broadcast(totals))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    expected = F.greatest(F.try_divide(zero("sk") * zero("ka") * zero("kb"), zero("m") * zero("m")), F.lit(1e-6))
    scored = joined.withColumn("z", (zero("obs") - expected) / F.sqrt(expected))
    told = scored.groupBy(F.col("paper").alias("of_paper")).agg(F.percentile("z", 0.5).alias("z_median"), F.percentile("z", 0.1).alias("z_low"), F.avg((F.col("z") <= 0).cast("double")).alias("share_new"))
    every = scored_lists.select("paper").join(told, F.col("paper") == F.col("of_paper"), "left")
    return every.select("paper", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("z_median", "z_low", "share_new")])


def author_state(papers: DataFrame, month: int) -> DataFrame:
    """(author, n, last, deg) from papers (authors, t) before ``month``: papers, last month, distinct collaborators."""
    before = papers.where(F.col("t") < month).select("t", F.array_distinct("authors").alias("authors"))
    own = before.select(F.explode("authors").alias("author"), "t").groupBy("author").agg(F.count("*").alias("n"), F.max("t").alias("last"))
    pairs = before.select(F.inline(pairs_of(F.col("authors"))))
    both = pairs.union(pairs.select("b", "a")).toDF("author", "other").distinct().groupBy("author").agg(F.count("*").alias("deg"))
    return own.join(both, "author", "left").select("author", "n", "last", F.coalesce("deg", F.lit(0)).alias("deg"))


def author_features(papers: DataFrame, state: DataFrame, month: int, key: str, rank: DataFrame | None = None) -> DataFrame:
    """Per paper: team size, share of new authors, prior papers (largest, and log of the mean), recency, degree and reach, and with ``rank``
    (author, rank) the largest rank."""
    each = papers.select(key, F.explode_outer(F.array_distinct("authors")).alias("author"))
    joined = each.join(state, "author", "left")
    more = []
    if rank is not None:
        joined = joined.join(rank, "author", "left")
        more = [F.log1p(F.max(F.coalesce("rank", F.lit(0.0)))).alias("author_pagerank_max")]
    n = F.coalesce("n", F.lit(0))
    return joined.groupBy(key).agg(
        F.count("author").alias("team_size"),
        F.coalesce(F.avg(F.when(F.col("author").isNotNull(), (n == 0).cast("double"))), F.lit(1.0)).alias("author_new_frac"),
        F.max(n).alias("author_prior_max"),
        F.coalesce(F.log1p(F.avg(F.when(F.col("author").isNotNull(), n))), F.lit(0.0)).alias("author_prior_mean"),
        (F.lit(month) - F.max(F.coalesce("last", F.lit(-999)))).alias("author_recency"),
        F.log1p(F.max(F.coalesce("deg", F.lit(0)))).alias("author_degree_max"),
        F.log1p(F.sum(F.coalesce("deg", F.lit(0)))).alias("author_reach"),
        *more,
    )


def term_state(papers: DataFrame, month: int, recent: int = 6, base: int = 24) -> DataFrame:
    """(term, df, df_recent, df_base, burst) of papers (terms, t) before ``month``."""
    before = papers.where(F.col("t") < month)
    span = lambda a, b: F.sum(F.col("t").between(month - a, month - b - 1).cast("long"))
    counts = before.agg(span(recent, 0).alias("n_recent"), span(base, recent).alias("n_base"))
    terms = exploded(before, F.array_distinct("terms"), "term", "t").groupBy("term").agg(F.count("*").alias("df"), span(recent, 0).alias("df_recent"), span(base, recent).alias("df_base"))
    rate = lambda df, n: F.log((F.col(df) + 0.5) / F.greatest(F.coalesce(n, F.lit(0)), F.lit(1)))
    return terms.crossJoin(F.broadcast(counts)).withColumn("burst", rate("df_recent", "n_recent") - rate("df_base", "n_base")).drop("n_recent", "n_base")


def term_features(papers: DataFrame, state: DataFrame, total: int, key: str) -> DataFrame:
    """(key, term_burst_mean, term_burst_max, term_rarity); papers without terms get 0."""
    each = papers.select(key, F.explode_outer("terms").alias("term")).join(state, "term", "left")
    known = F.col("term").isNotNull()
    burst = F.when(known, F.coalesce("burst", F.lit(0.0)))
    rarity = F.when(known, F.log(F.lit(float(max(total, 1))) / (F.coalesce("df", F.lit(0)) + 1)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return each.groupBy(key).agg(zero(F.avg(burst)).alias("term_burst_mean"), zero(F.max(burst)).alias("term_burst_max"), zero(F.avg(rarity)).alias("term_rarity"))


def coauthor_pagerank(papers: DataFrame, month: int, iterations: int = 30) -> DataFrame:
    """(author, rank) over pairs of authors before ``month``, weighted by common papers; ranks are multiples of the mean.

    Authors without a co-author hold what their rounds leave them; nothing is spread."""
    before = kept(papers.where(F.col("t") < month).select(F.array_distinct("authors").alias("authors")), "authors")
    pairs = before.select(F.inline(pairs_of(F.col("authors")))).groupBy("a", "b").agg(F.count("*").alias("w"))  # each pair once, then both ways
    both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
    authors = before.select(F.explode("authors").alias("node"))
    ranks = pagerank(pairs.select(F.inline(both)), iterations, weight="w", spread=False, nodes=authors)
    return ranks.crossJoin(F.broadcast(ranks.agg(F.count("*").alias("_n")))).select(F.col("node").alias("author"), (F.col("rank") * F.col("_n")).alias("rank"))


def state_as_of(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """``wanted`` (paper, obs, and more) with degree, vel12, recent6 and prior6 of ``paper`` as of its own month ``obs``.

    Citations are counted by paper and month first; a paper's months, with those that are asked for, then pass one window, so no row meets more than its own."""
    monthly = edges.groupBy(F.col("dst").alias("paper"), F.col("t_src").alias("obs")).agg(F.count("*").alias("_cites"))
    asked = wanted.select("paper", "obs").where("paper IS NOT NULL AND obs IS NOT NULL").distinct().withColumn("_cites", F.lit(0).cast("long"))
    months = monthly.union(asked).groupBy("paper", "obs").agg(F.sum("_cites").alias("_cites"))
    w = Window.partitionBy("paper").orderBy("obs")  # as many rows as a paper has months
    spans = {"degree": (Window.unboundedPreceding, -1), "vel12": (-12, -1), "recent6": (-6, -1), "prior6": (-12, -7)}
    state = months.select("paper", "obs", *[F.coalesce(F.sum("_cites").over(w.rangeBetween(*span)), F.lit(0)).alias(c) for c, span in spans.items()])
    found = wanted.join(state, ["paper", "obs"], "left")
    return found.select(*wanted.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in spans])


def slot_totals(edges: DataFrame) -> DataFrame:
    """(month, slots, slot_pairs): references made up to each month, and ordered pairs of them within a paper; a row a month."""
    lists = edges.groupBy("src", F.col("t_src").alias("month")).agg(F.count("*").alias("k"))
    monthly = lists.groupBy("month").agg(F.sum("k").alias("k1"), F.sum(F.col("k") * (F.col("k") - 1)).alias("k2"))
    upto = Window.orderBy("month")  # as many rows as months
    return monthly.select("month", F.sum("k1").over(upto).alias("slots"), F.sum("k2").over(upto).alias("slot_pairs"))


def hubs(papers: DataFrame, edges: DataFrame, month: int, quantile: float = 0.99) -> DataFrame:
    """(paper): those whose citations before ``month`` reach the quantile over all papers (paper, t) of earlier months, and one at least."""
    degree = edges.where(F.col("t_src") < month).groupBy(F.col("dst").alias("_cited")).agg(F.count("*").alias("_degree"))
    every = papers.join(degree, F.col("paper") == F.col("_cited"), "left").select("paper", "t", F.coalesce("_degree", F.lit(0)).alias("_degree"))
    every = kept(every, "degrees")  # a quantile takes several passes
    cut = selected(every.where(F.col("t") < month), {"cut": ("_degree", quantile)})["cut"]
    return every.where(F.lit(cut is not None) & (F.col("_degree") >= max(cut or 0.0, 1.0))).select("paper")


def elite_attention(edges: DataFrame, hub: DataFrame, month: int) -> DataFrame:
    """(paper, attention): citations before ``month`` that come from ``hub`` (paper)."""
    citing = edges.where(F.col("t_src") < month).join(hub.select(F.col("paper").alias("src")), "src", "left_semi")
    return citing.groupBy(F.col("dst").alias("paper")).agg(F.count("*").alias("attention"))


def reference_momentum(edges: DataFrame, papers: DataFrame, month: int, rank: DataFrame | None = None) -> DataFrame:
    """Per paper that cites at ``month``: how its references are doing as of then.

    Mean and largest 12-month velocity, acceleration (last six months against the six before), the largest burst ratio, the share of
    hubs, attention that hubs pay to them, and with ``rank`` (node, rank) sum, mean and maximum of rank times nodes."""
    edges = kept(edges.where(F.col("t_src") <= month), "edges")  # later ones tell nothing; state, hubs and attention ask for the rest
    refs = edges.where(F.col("t_src") == month).select("src", F.col("dst").alias("paper"), F.col("t_src").alias("obs"))
    cited = refs.select(F.col("paper").alias("dst")).distinct()
    state = state_as_of(refs, edges.join(cited, "dst", "left_semi"))
    hub = kept(hubs(papers, edges, month), "hubs")
    marked = state.join(hub.withColumn("_hub", F.lit(1.0)), "paper", "left").join(elite_attention(edges, hub, month), "paper", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    found = [
        F.avg(F.log1p("vel12")).alias("vel_mean"),
        F.log1p(F.max("vel12")).alias("vel_max"),
        (F.log1p(F.sum("recent6")) - F.log1p(F.sum("prior6"))).alias("acceleration"),
        F.max((F.col("recent6") + 1) / (F.col("prior6") + 1)).alias("burst_ratio"),
        F.avg(zero("_hub")).alias("hub_share"),
        F.log1p(F.avg(zero("attention"))).alias("elite_attention"),
    ]
    if rank is not None:
        scaled = rank.crossJoin(F.broadcast(rank.agg(F.count("*").alias("_n")))).select(F.col("node").alias("paper"), (F.col("rank") * F.col("_n")).alias("_rank"))
        marked = marked.join(scaled, "paper", "left")
        found += [F.log1p(f(zero("_rank"))).alias(f"rank_{name}") for name, f in (("sum", F.sum), ("mean", F.avg), ("max", F.max))]
    return marked.groupBy(F.col("src").alias("paper")).agg(*found)


def unseen_term_pairs(papers: DataFrame, month: int, key: str) -> DataFrame:
    """(key, pairs, unseen) of papers (terms, t) of ``month``: pairs of a paper's terms, and those that no earlier paper has.

    Only pairs of this month's papers are looked up, so history is made into pairs of their terms alone."""
    now = papers.where(F.col("t") == month).select(key, F.inline_outer(pairs_of(F.col("terms"))))
    wanted = now.select(F.col("a").alias("term")).union(now.select("b")).distinct().where("term IS NOT NULL")
    history = papers.where(F.col("t") < month).select(key, F.explode(F.array_distinct("terms")).alias("term")).join(wanted, "term", "left_semi")
    seen = history.groupBy(key).agg(F.collect_set("term").alias("terms")).select(F.inline(pairs_of(F.col("terms")))).distinct().withColumn("_seen", F.lit(1))
    met = now.join(seen, ["a", "b"], "left")
    return met.groupBy(key).agg(F.count("a").alias("pairs"), F.sum((F.col("a").isNotNull() & F.col("_seen").isNull()).cast("long")).alias("unseen"))

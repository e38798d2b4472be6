"""What the plans of the graph's queries derive: edges and degrees once, and no month against every earlier month."""

from pyspark.sql import functions as F

from sparkloom.operators import graph
from sparkloom.plans import study


def drawn(spark):
    edges = spark.range(400).select((F.col("id") % 40 + 100).alias("src"), (F.col("id") * 7 % 60).alias("dst"), (F.col("id") % 40 + 30).cast("int").alias("t_src"), (F.col("id") * 7 % 20).cast("int").alias("t_dst")).distinct()
    nodes = edges.select(F.col("src").alias("paper"), F.col("t_src").alias("t")).union(edges.select("dst", "t_dst")).distinct()
    return edges, nodes


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_state_as_of_meets_no_month_with_every_earlier_one(spark):
    edges = drawn(spark)[0]
    wanted = edges.select("src", F.col("dst").alias("paper"), F.col("t_src").alias("obs")).union(spark.sql("SELECT 1L, 999L, 5 UNION ALL SELECT 1L, 7L, NULL"))
    found = graph.state_as_of(wanted, edges)
    assert plan(found).count("Join") == 1 and "Window" in plan(found)
    rows, cites = found.collect(), [(r["dst"], r["t_src"]) for r in edges.collect()]
    assert len(rows) == wanted.count()
    for r in rows:
        back = [r["obs"] - t for d, t in cites if d == r["paper"] and r["obs"] is not None and t < r["obs"]]
        assert (r["degree"], r["vel12"], r["recent6"], r["prior6"]) == (len(back), sum(b <= 12 for b in back), sum(b <= 6 for b in back), sum(7 <= b <= 12 for b in back))


def test_momentum_reads_stored_edges(spark):
    edges, nodes = drawn(spark)
    found = graph.reference_momentum(edges, nodes, 60)
    assert "Range (" not in plan(found) and found.count() == edges.where("t_src = 60").select("src").distinct().count()


def test_hubs_read_stored_degrees(spark):
    edges, nodes = drawn(spark)
    assert "Range (" not in plan(graph.hubs(nodes, edges, 60))


def test_attention_derives_edges_once_more_than_its_hubs(spark):
    edges, nodes = drawn(spark)
    assert plan(graph.elite_attention(edges, graph.hubs(nodes, edges, 60), 60)).count("Range (") == 1


def test_references_meet_before_they_are_summed(spark):
    assert "RepartitionByExpression" in plan(graph.reference_features(drawn(spark)[0], 60))


def test_attention_tells_only_lines_of_hubs_apart(spark, sf_dir):
    told = plan(study.elite_attention(spark, sf_dir))
    assert "_degree" not in told and told.rindex("Aggregate") < told.index("LeftSemi")

"""Components of chains, stars and random graphs; rounds are few whatever the order of ids."""

import random

import pytest

from sparkloom.llm import components
from tests.llm.test_dedup_operators import smallest_reachable


@pytest.mark.parametrize("order", ["ascending", "shuffled"])
def test_long_chain_takes_few_cuts(spark, monkeypatch, order):
    """2,000 links dealt over 64 partitions so that no task sees neighbours; AQE is off, so none are put together."""
    ids = list(range(2_001))
    if order == "shuffled":
        random.Random(3).shuffle(ids)
    cuts = []
    inner = components.stored
    monkeypatch.setattr(components, "stored", lambda frame, name: cuts.append(1) or inner(frame, name))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "src long, dst long").repartition(64, "src")
        found = {r["node"]: r["component"] for r in components.components(links).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found == dict.fromkeys(range(2_001), 0)
    assert len(cuts) <= 50  # a round a link would be 2,000 of them


def test_random_graphs(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(5, 5), (None, 3), (4, None)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "src long, dst long").repartition(7)).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    nodes = {x for link in real for x in link}
    assert found == smallest_reachable(nodes, real)

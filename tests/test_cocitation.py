"""Co-citation novelty against a plain count over whole reference lists."""

import random

import numpy as np
import pytest

from sparkloom.operators import graph


def novelty_brute(edges, month, most):
    refs, t = {}, {}
    for s, d, ts, _ in edges:
        refs.setdefault(s, set()).add(d)
        t[s] = ts
    before = [refs[p] for p in refs if t[p] < month]
    m, sk = sum(map(len, before)), sum(len(r) * (len(r) - 1) for r in before)
    found = {}
    for p in refs:
        if t[p] != month:
            continue
        own = sorted(refs[p])
        if len(own) > most:
            own = [own[i * len(own) // most] for i in range(most)]
        z = []
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                expected = max(sk * sum(a in r for r in before) * sum(b in r for r in before) / m**2, 1e-6)
                z.append((sum(a in r and b in r for r in before) - expected) / expected**0.5)
        found[p] = (np.median(z), np.quantile(z, 0.1), np.mean(np.array(z) <= 0))
    return found


def test_history_is_counted_over_whole_lists(spark):
    rng = random.Random(11)
    edges = [(s, d, s // 10, d // 10) for s in range(20, 60) for d in sorted(rng.sample(range(s), rng.randrange(2, 16)))]
    frame = spark.createDataFrame(edges, "src long, dst long, t_src int, t_dst int").repartition(3)
    rows = graph.cocitation_novelty(frame, 5, 6).collect()
    expected = novelty_brute(edges, 5, 6)
    assert {r["paper"] for r in rows} == set(expected)
    for r in rows:
        assert (r["z_median"], r["z_low"], r["share_new"]) == pytest.approx(expected[r["paper"]])

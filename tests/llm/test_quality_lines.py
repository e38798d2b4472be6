"""Lines of mixed documents get labels of their own, and op10 over a whole table against a plain version."""

import math
import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import quality, queries
from sparkloom.llm.common import table


def test_lines_differ_within_documents():
    """Good prose and shouting in runs within one document; documents are labelled by what they mostly are."""
    rng = random.Random(3)
    words = "the river was quiet and people walked slowly along its green banks in summer".split()

    def line(good):
        if good:
            return " ".join(rng.choice(words) for _ in range(rng.randrange(8, 14))).capitalize() + "."
        return " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "###", "CLICK!!"]) for _ in range(rng.randrange(8, 14)))

    documents = []
    for _ in range(200):
        mostly = rng.random() < 0.5
        kinds = []
        while len(kinds) < 12:
            kinds += [mostly if rng.random() < 0.7 else not mostly] * rng.randrange(1, 5)
        documents.append((kinds, [line(k) for k in kinds], int(sum(kinds) * 2 > len(kinds))))
    model = quality.train([quality.features("\n".join(lines))[0] for _, lines, _ in documents], [y for _, _, y in documents])
    right = n = 0
    spread = []
    for kinds, lines, _ in documents:
        x, _ = quality.features("\n".join(lines))
        p = quality.marginals(x @ model.weights, model.transition)
        right += sum((v > 0.5) == k for v, k in zip(p, kinds, strict=True))
        n += len(kinds)
        spread.append(np.std(p))
    assert right / n > 0.9
    assert np.median(spread) > 0.3


def plain_score(text, model):
    """Sums over all ways, in logs, line by line."""
    x, _ = quality.features(text)
    lines = (text or "").split("\n")
    odds = [sum(a * b for a, b in zip(row, model.weights, strict=True)) for row in x.tolist()]
    pair = model.transition
    log_sum = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    ahead, back = [(0.0, max(-50, min(50, odds[0])))], [(0.0, 0.0)]
    for o in odds[1:]:
        bad, good = ahead[-1]
        ahead.append((log_sum(bad + pair[0][0], good + pair[1][0]), log_sum(bad + pair[0][1], good + pair[1][1]) + max(-50, min(50, o))))
    for o in reversed(odds[1:]):
        bad, good = back[-1]
        good += max(-50, min(50, o))
        back.append((log_sum(pair[0][0] + bad, pair[0][1] + good), log_sum(pair[1][0] + bad, pair[1][1] + good)))
    total = weight = 0.0
    for (a0, a1), (b0, b1), line in zip(ahead, reversed(back), lines, strict=True):
        size = max(1, len(line))
        total += size / (1 + math.exp(min(700, (a0 + b0) - (a1 + b1))))
        weight += size
    return total / weight


def test_op10_is_the_plain_version(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = quality.fit(docs, spark.createDataFrame([(r["doc_id"], r["quality"]) for r in labels.collect() if not held(r["doc_id"])], "doc_id long, quality int"))
    found = {r["doc_id"]: r for r in queries.op10_quality(spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for r in rows:
        got, score = found[r["doc_id"]], plain_score(r["text"], model)
        assert got["held_out"] == held(r["doc_id"])
        assert got["score"] == pytest.approx(score, abs=1e-6)
        assert got["predicted"] == int(got["score"] >= 0.3)

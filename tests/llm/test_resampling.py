"""Importance resampling against plain counts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from sparkloom.llm import resampling


def plain(docs, target, percent=5):
    """Rows (doc_id, n_features, weight, score, rank), nulls of ids last."""

    def features(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        return len(words), Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1))

    s, t = Counter(), Counter()
    for _, text in docs:
        s += features(text)[1]
    for _, text in target:
        t += features(text)[1]
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000) / ((s[b] + 1.0) * (all_t + 10_000)))) for b in s}
    rows = []
    for doc_id, text in docs:
        n_words, counts = features(text)
        weight = sum(gain[b] * n for b, n in counts.items())
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, sum(counts.values()), weight, score, None, n_words])
    best = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(best[: percent * len(best) // 100], 1):
        row[4] = rank
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


def told(frame):
    return sorted(repr(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank"))) for r in frame.collect())


def test_joined_checksums():
    draw = random.Random(1)
    pairs = [(draw.randbytes(draw.choice([0, 1, 9, 63, 64, 65, 5_000])), draw.randbytes(draw.choice([0, 1, 9, 63, 64, 65, 5_000]))) for _ in range(300)]
    for some in (pairs, [p for p in pairs if len(p[1]) < 64]):
        first, second = (pa.array([zlib.crc32(p[i]) for p in some], pa.uint32()) for i in (0, 1))
        joined = resampling.crc32_join(first, second, pa.array([len(p[1]) for p in some], pa.int64()))
        assert joined.to_pylist() == [zlib.crc32(a + b) for a, b in some]
    assert resampling.shifted(np.empty(0, np.uint32), np.empty(0, np.int64)).size == 0


def test_against_plain(spark):
    draw = random.Random(2)
    words = [f"{a}{b}" for a in ("wo", "ÉÀ", "X", "9", "日本") for b in "abcdeFGH"]
    text = lambda n: draw.choice([" ", "-", "\n", "  "]).join(draw.choice(words) for _ in range(n))
    docs = [(i, text(draw.choice([0, 1, 2, 19, 20, 60]))) for i in range(400)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (None, text(40)), (None, None), (1_000, None), (1_001, ""), (1_002, text(30_000))]
    target = [(0, text(300)), (1, None), (None, text(5))]
    frame = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, number long, score long, place string").repartition(6)
    aim = spark.createDataFrame(target, "item_id long, text string")
    found = told(resampling.resample(frame, aim))
    assert found == plain(docs, target)
    assert found == told(resampling.resample(frame.repartition(3), aim))  # however rows are dealt
    assert told(resampling.resample(frame, aim, percent=100)) == plain(docs, target, 100)


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, " ".join(["same"] * 25)) for i in range(100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = resampling.resample(frame, frame.selectExpr("doc_id AS item_id", "text"), percent=50).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 51))
    assert [(-r["score"], r["doc_id"]) for r in found] == sorted((-r["score"], r["doc_id"]) for r in found)


def test_odd_rows_and_tables(spark, odd_docs, no_docs):
    aim = spark.createDataFrame([(1, "base1 base2")], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert told(resampling.resample(odd_docs, aim)) == plain(rows, [(1, "base1 base2")])
    assert told(resampling.resample(odd_docs, aim.limit(0))) == plain(rows, [])
    assert resampling.resample(no_docs, aim).count() == 0

"""Lines that share a segment with many others: variants of templates, against brute force."""

import random

import pytest

from sparkloom.llm import lines
from tests.llm.test_dedup_operators import lines_brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts_of(frame, **options):
    return {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame, **options).collect()}


@pytest.mark.parametrize("most, core, few", [(1, 4, 2), (2, 10, 1), (3, 16, 500), (2, 8, 12)])
def test_families_match_brute_force(spark, most, core, few):
    """Few lines make a segment common here, so that short rests, long ones and deeper levels all occur."""
    rng = random.Random(most)

    def line():
        kind = rng.randrange(4)
        if kind == 0:
            return f"order number {rng.randrange(400)} was sent to the depot"
        if kind == 1:
            return f"{rng.choice('abc')}{rng.choice('abc')} the same middle part of it {rng.choice('xyz')}{rng.choice('xy')}{rng.choice('z ')}"
        if kind == 2:
            return "aaaaaaaaaaaaaaaaaaaaaaaa"[: rng.randrange(20, 25)] + rng.choice(["", "b", "bb"])
        return f"begin {''.join(rng.choice('ab') for _ in range(9))} common words here {''.join(rng.choice('ab') for _ in range(9))}"

    docs = {i: "\n".join(line() for _ in range(5)) for i in range(40)}
    frame = spark.createDataFrame([(k, v, None, None, 0) for k, v in docs.items()], SCHEMA)
    assert texts_of(frame, most=most, core=core, few=few, sample=1) == lines_brute(docs)


def test_many_variants_of_one_line(spark):
    """5,000 variants that differ in digits: a variant goes if an earlier one differs in at most two."""
    rng = random.Random(5)
    numbers = rng.sample(range(10**8), 2_000) + [n for base in rng.sample(range(10**6), 30) for n in (base * 100 + rng.randrange(100) for _ in range(100))]
    rng.shuffle(numbers)
    docs = {i: f"parcel {n:08d} left the depot on time" for i, n in enumerate(numbers[:5_000])}
    seen, stay = set(), set()
    for i, text in docs.items():
        digits = text[7:15]
        rubbed = {(a, b, digits[:a] + "*" + digits[a + 1 : b] + "*" + digits[b + 1 :]) for a in range(8) for b in range(a + 1, 8)}
        moved = {digits[:a] + digits[a + 1 :] for a in range(8)}
        if not (rubbed & seen or moved & seen):
            stay.add(i)
        seen |= rubbed | moved
    frame = spark.createDataFrame([(k, v, None, None, 0) for k, v in docs.items()], SCHEMA)
    found = texts_of(frame)
    assert {k for k, v in found.items() if v} == stay
    assert 0 < len(stay) < 4_000


def test_rests_are_posted_at_places_of_their_length(spark, monkeypatch):
    """Against rests of one length a rest has at most five of its twelve places, however many lines share a segment."""
    rng = random.Random(7)
    words = [f"word{n}" for n in range(9)]

    def line():
        cut = list(words)
        cut[rng.randrange(9)] = rng.choice(["other", "next", "ward", "wordy9"]) + str(rng.randrange(100))
        return " ".join(cut)

    docs = {i: line() for i in range(80)}
    docs |= {80 + i: docs[i][:n] + rng.choice(["", "x", "xy"]) + docs[i][n + rng.randrange(2) :] for i in range(20) for n in [rng.randrange(50)]}
    counts, plain = {}, lines.stored

    def counted(frame, name):
        made = plain(frame, name)
        counts[name] = counts.get(name, 0) + made.count()
        return made

    monkeypatch.setattr(lines, "stored", counted)
    frame = spark.createDataFrame([(k, v, None, None, 0) for k, v in docs.items()], SCHEMA)
    assert texts_of(frame, most=3, sample=1) == lines_brute(docs)
    assert counts["cores"] > 100 and 0 < counts["deeper"] <= 5 * counts["cores"]

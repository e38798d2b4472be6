"""The filter audit against a plain count, with copies that cross partitions."""

import itertools
import random
import re

import pytest

from sparkloom.llm import filter_audit


def plain(docs, labels):
    """Report rows as a dict from (part, order, step), by following each document through each order."""
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, mark in labels if mark == 1 and i is not None}
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    parts = sorted({lang or "" for _, _, lang in docs})
    found = {(p, "".join(o), s): dict.fromkeys(names, 0) for p in parts for o in itertools.permutations("ABCDE") for s in range(1, 6)}
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if doc_id is not None and first.get(text, doc_id) < doc_id:
            fails.add("E")
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, letter in enumerate(order, 1):
                row = found[lang or "", "".join(order), step]
                fail = letter in fails
                row["redundant"] += fail and gone
                row["removed"] += fail and not gone
                row["good_lost"] += fail and not gone and doc_id in good
                row["toxic_lost"] += fail and not gone and doc_id in toxic
                row["unique_fails"] += fails == {letter}
                gone |= fail
                row["kept"] += not gone
    for part in parts:
        for letter in "ABCDE":
            rows = [(k, row) for k, row in found.items() if k[0] == part and k[1][k[2] - 1] == letter]
            total = sum(row["removed"] for _, row in rows)
            for _, row in rows:
                row["shapley"] = total
    return found


def told(frame):
    return {(r["part"], r["filter_order"], r["step"]): {c: r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")} for r in frame.collect()}


def made_up(seed, n=240):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(3))
    texts = [" ".join(word() for _ in range(draw.choice([3, 99, 100, 130]))) for _ in range(12)]
    texts += ["UPPER case TEXT", "a # b", "", None, "é" * 9 + "A", "A" + "b" * 9, "a b\x1fc " * 60]
    rows = []
    for i in range(n):
        text = texts[0] if draw.random() < 0.4 else draw.choice(texts)
        rows.append((draw.choice([i, i, i, None if i % 29 == 0 else i, max(0, i - 1)]), text, draw.choice(["en", "de", None, ""])))
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, n, 2)] + [(4, 1, 1), (4, 1, 1), (None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("parts", ["1", "4", "31"])
def test_against_plain(spark, parts):
    docs, labels = made_up(int(parts))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in docs], "doc_id long, text string, lang string, part string, mask int, f1 long, number long").repartition(7)
        marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        # Of repeated ids the labels are those of any row.
        assert told(filter_audit.audit_filters(frame, marks)) == plain(docs, labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_text_over_all_partitions(spark):
    """A text in all rows but two goes on from range to range; only its smallest id is no copy."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        docs = spark.range(0, 4_000, 1, 8).selectExpr("id + 10 AS doc_id", "IF(id IN (7, 1999), concat('own ', id), 'the same') AS text", "'en' AS lang")
        found = filter_audit.masks(docs)
        assert found.where(f"mask & {filter_audit.DUPLICATE} = 0").count() == 3
        assert found.where(f"mask & {filter_audit.DUPLICATE} = 0").agg({"doc_id": "min"}).first()[0] == 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fingerprints_that_collide(spark):
    """Different texts under one fingerprint stay apart, across partitions too."""
    rows = [(i, f"text {i % 3}", "en", 5, 5) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, part string, f1 long, f2 long")
    spread = frame.repartitionByRange(9, "doc_id").sortWithinPartitions("f1", "f2", "text", "doc_id")
    rows = filter_audit._compared(spread, "bigint").collect()
    edges = [r for r in rows if r["edge_text"] is not None]
    later = {r["head"] for r in edges if any(e["edge_text"] == r["edge_text"] and e["doc_id"] < r["doc_id"] for e in edges)}
    kept = {r["doc_id"] for r in rows if r["edge_text"] is None and not r["mask"] & filter_audit.DUPLICATE and r["head"] not in later}
    assert kept == {0, 1, 2}


def test_odd_rows_and_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()]
    assert told(filter_audit.audit_filters(odd_docs, labels)) == plain(rows, [(1, 1, 0)])
    assert filter_audit.audit_filters(no_docs, labels).count() == 0
    assert filter_audit.audit_filters(odd_docs, labels.limit(0)).count() == 600 * len({lang or "" for _, _, lang in rows})

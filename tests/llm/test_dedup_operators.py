"""Near-dedup, substring dedup, embeddings, line dedup and components against brute force."""

import glob
import hashlib
import itertools
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import embeddings, lines, near_dedup, substrings
from sparkloom.llm.components import components
from sparkloom.llm.shingles import sequence_hashes, word_hashes


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, length):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + length]) for i in range(len(words) - length + 1)} or {tuple(words)}


def near_brute(docs, length):
    sets = {d: shingles(t, length) for d, t in docs.items()}
    ids = sorted(sets)
    linked = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    return smallest_reachable(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if linked(a, b)]), {d: len(s) for d, s in sets.items()}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    frame = spark.createDataFrame([*links, (None, 3), (7, 7)], "src long, dst long").repartition(5)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    expected = smallest_reachable(nodes, links)
    assert {r["node"]: r["component"] for r in components(frame).collect()} == expected
    assert components(frame.limit(0)).count() == 0


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def copies(spark):
    """Chains of edited copies around the threshold, exact copies, a family larger than the merge window, and a shared passage."""
    rng = random.Random(3)
    docs, n = {}, 0
    shared = [f"s{i}" for i in range(30)]
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(4):
            docs[n] = " ".join(words)
            n += 1
            words = edited(rng, words, rng.randrange(0, max(2, len(words) // 25)))
    family = [f"f{i}" for i in range(150)]
    for _ in range(40):
        docs[n] = " ".join(edited(rng, family, rng.randrange(0, 5)))
        n += 1
    for _ in range(20):
        docs[n] = " ".join(shared + [f"t{rng.randrange(10**6)}" for _ in range(40)])
        n += 1
    docs |= {n: None, n + 1: "", n + 2: "  ", n + 3: "Two Words", n + 4: "two  words", n + 5: docs[0].upper()}
    return docs


@pytest.mark.parametrize("length", [4, 5])
def test_near_duplicates_match_brute_force(spark, copies, length):
    frame = spark.createDataFrame(list(copies.items()), "doc_id long, text string").repartition(6)
    rows = near_dedup.near_duplicates(frame, length=length).collect()
    component, sizes = near_brute(copies, length)
    assert {r["doc_id"]: r["component_id"] for r in rows} == component
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


@pytest.mark.parametrize("options", [{"short": 1}, {"short": 1, "block_shingles": 900}, {"short": 1, "longest": 2}, {"longest": 2}])
def test_near_duplicates_long_lists(spark, copies, options):
    """Where every list counts as long, links are found by neighbours and in settled groups."""
    frame = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    rows = near_dedup.near_duplicates(frame, length=4, **options).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == near_brute(copies, 4)[0]


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    rows = near_dedup.near_duplicates(odd_docs).collect()
    assert len(rows) == 11
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert found[6] == found[7] == 1 and found[2] == 2 and found[3] == 3
    assert near_dedup.near_duplicates(no_docs).count() == 0


def digests(frame, width=20):
    rows = substrings.digest(substrings.dedup_substrings(frame, width)).collect()
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows}


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_substrings_match_brute_force(spark, letters):
    """Few letters give runs and periods, which recompression must not lose."""
    rng = random.Random(letters)
    docs = {}
    for d in range(30):
        words = [f"x{rng.randrange(letters)}" for _ in range(rng.randrange(0, 120))]
        if d and rng.random() < 0.5 and docs[d - 1]:
            words[10:10] = docs[d - 1].split()[: rng.randrange(15, 60)]
        docs[d] = " ".join(words)
    docs |= {30: None, 31: "", 32: "ab " * 500, 33: "a b c " * 200, 34: docs[3], 35: ("p q " * 30) + docs[4]}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    assert digests(frame) == substrings.brute_force(docs)


def test_substrings_chunks(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"c{rng.randrange(3000)}" for _ in range(4000)]
    docs = {1: " ".join(words), 2: " ".join(words[500:900] + words[100:200]), 3: " ".join(words[:19])}
    texts = [docs[k].encode() for k in docs]
    whole = {tuple(k for k in substrings.Rounds(w, s, 20).anchors()[0].tolist()) for w, s, _, _ in substrings._chunks(texts, 20)}
    monkeypatch.setattr(substrings, "CHUNK", 300)
    parts = {k for w, s, _, _ in substrings._chunks(texts, 20) for k in substrings.Rounds(w, s, 20).anchors()[0].tolist()}
    assert parts == {k for ks in whole for k in ks}
    assert digests(spark.createDataFrame(list(docs.items()), "doc_id long, text string")) == substrings.brute_force(docs)


def test_substrings_odd_rows(odd_docs, no_docs):
    rows = substrings.dedup_substrings(odd_docs).collect()
    assert len(rows) == 11
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[6]["n_removed"] == 60 and by_id[7]["n_removed"] == 60 and by_id[1]["n_removed"] == 0
    assert by_id[2]["kept_text"] == "" and by_id[None]["n_removed"] == 0
    assert substrings.dedup_substrings(no_docs).count() == 0


def test_sequence_hashes_tell_order_and_length():
    h = word_hashes([b"a", b"b", b"a", b"b"])
    two = sequence_hashes(h, 2)
    assert two[0] == two[2] != two[1] and sequence_hashes(h, 3)[0] != two[0] and not len(sequence_hashes(h, 5))


def vector_brute(rows, threshold=0.93):
    good = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=float)
            good[i] = x / np.linalg.norm(x), label
    keys = list(good)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= threshold]
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    component = smallest_reachable([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    return sorted((r[0], count[i], component[r[0]]) for i, r in enumerate(rows))


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(60):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), (centre + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25])).astype(np.float32).tolist(), int(c % 3)))
    rows += [(len(rows) + i, rows[0][1], rows[0][2]) for i in range(50)]
    extra = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(len(rows) + i, v, 0) for i, v in enumerate(extra)] + [(900, rows[0][1], None), (901, [2.0, 4.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("members", F.lit(1)).withColumn("leaf", F.lit("x"))
    for options in ({}, {"leaf": 20, "miss": 1e-4}, {"block": 15}):
        found = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_vectors(frame, **options).collect())
        assert found == vector_brute(rows)
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(300):
        a = [rng.choice("abé😀") for _ in range(rng.randrange(5, 40))]
        b = list(a)
        for _ in range(rng.randrange(0, edits + 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "é"])
        a, b = sorted(("".join(a), "".join(b)), key=len)
        if len(b) - len(a) <= edits <= len(a):
            rows.append((a, b, levenshtein(a, b)))
    found = spark.createDataFrame(rows, "a string, b string, d int").withColumn("g", lines.banded_distance(F.split("a", ""), F.split("b", ""), edits))
    assert found.where(f"(d <= {edits} AND g <> d) OR (d > {edits} AND g <= {edits})").count() == 0
    apart = lines.counts_apart(lines.letter_counts(F.repeat("a", F.lit(20))), lines.letter_counts(F.repeat("b", F.lit(20))))
    assert found.where(apart > 2 * 20 * F.col("d")).count() == 0


def lines_brute(docs, edits=2, least=20):
    seen, out = [], {}
    for d in sorted(docs):
        kept = []
        for line in docs[d].split("\n"):
            own = line.strip(" \t\r")
            if len(own) < least:
                kept.append(line)
                continue
            if own not in seen and not any(abs(len(o) - len(own)) <= edits and levenshtein(o, own) <= edits for o in seen):
                kept.append(line)
            if own not in seen:
                seen.append(own)
        out[d] = "\n".join(kept)
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(10, 45))).strip() + "." for _ in range(40)]

    def changed(line):
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(line))
            line = line[:at] + rng.choice(["", "x", line[at] + "y"]) + line[at + 1 :]
        return line

    docs = {d: "\n".join(changed(rng.choice(pool)) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(1, 9))) for d in range(40)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame).collect()} == lines_brute(docs)


def test_lines_are_native(spark, sf_dir):
    from sparkloom.llm import queries

    plan = queries.op6_line_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_lines_odd_rows(odd_docs, no_docs):
    found = lines.dedup_lines(odd_docs)
    assert found.columns == [*odd_docs.columns, "line_dedup"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(found.collect()) == 11 and rows[2]["text"] is None and rows[3]["text"] == ""
    assert rows[6]["line_dedup"]["n_removed"] == 1 and rows[None]["text"] == "a text without an id"
    assert lines.dedup_lines(no_docs).count() == 0


def test_kept_digest_of_a_plain_text(spark):
    frame = spark.createDataFrame([(1, " a  b\tc ")], "doc_id long, text string")
    assert digests(frame)[1] == (3, 0, hashlib.sha256(b"a b c").hexdigest())


def test_near_duplicates_exchange_only_texts_asked_for(spark):
    """Of 400 texts two are asked for; the others go before the exchange, but for those that share a bit."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a text of number"), "id").alias("text"))
    sketches = near_dedup._sketches(docs, 5).where("doc_id IN (7, 300)")
    wanted = sketches.select(F.col("doc_id").alias("class_id"), "d1", "d2")
    sets = near_dedup._sets(wanted, docs, 5)
    assert {r["class_id"] for r in sets.collect()} == {7, 300}
    assert sets._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    assert near_dedup._narrowed(docs, "doc_id", wanted.select("class_id")).count() == 2
    assert near_dedup._narrowed(docs, "doc_id", docs.select("doc_id")).count() == 400


def test_near_duplicates_leave_no_signatures(spark, copies):
    frame = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    folder = tempfile.mkdtemp(prefix="sparkloom-test-")
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(folder)
    try:
        near_dedup.near_duplicates(frame).count()
        own = glob.glob(f"{folder}/**/sparkloom-*", recursive=True)
        assert own and not any("signature" in spark.read.parquet(path).columns for path in own if glob.glob(f"{path}/part-*"))
    finally:
        spark.sparkContext.setCheckpointDir(before)


def test_near_duplicates_settle_only_members_with_a_near_partner(spark, monkeypatch):
    """Documents of four passages each, two of which share one at most: all their lists are long, but they are far from the threshold, and their sets meet nobody."""
    chosen: list[tuple] = []
    for four in itertools.combinations(range(16), 4):
        if all(len({*four} & {*other}) < 2 for other in chosen):
            chosen.append(four)
    docs = {i: " ".join(f"p{p}w{w}" for p in four for w in range(30)) for i, four in enumerate(chosen)}
    dealt, inner = set(), near_dedup._settled
    monkeypatch.setattr(near_dedup, "_settled", lambda groups, *more: dealt.update(r["class_id"] for r in groups.collect()) or inner(groups, *more))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = near_dedup.near_duplicates(frame, length=4, short=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: i for i in docs} and len(docs) > 10
    assert not dealt


def test_near_partners_match_brute_force(spark):
    """Members in blocks of 5 against all pairs, with agreements around the least one and sizes that rule pairs out."""
    rng = random.Random(8)
    groups, marks = [], {}
    for i in range(60):
        mark = [rng.randrange(256) if rng.random() < 0.3 else k for k in range(128)]
        marks[i] = (rng.choice([10, 11, 30]), bytes(mark))
        groups += [(g, i, i % 7, i % 7 != 0) for g in (0, 1) if rng.random() < 0.6]
    agree = lambda x, y: sum(a == b for a, b in zip(marks[x][1], marks[y][1], strict=True))
    fits = lambda x, y: 100 * min(marks[x][0], marks[y][0]) >= 80 * max(marks[x][0], marks[y][0])
    met = lambda a, b: a[0] == b[0] and a[2] != b[2] and (a[3] or b[3]) and fits(a[1], b[1]) and agree(a[1], b[1]) >= 68
    expected = {(a[0], a[1]) for a in groups for b in groups if met(a, b)}
    frame = spark.createDataFrame(groups, "group_id long, class_id long, part long, minor boolean")
    told = spark.createDataFrame([(i, *m) for i, m in marks.items()], "class_id long, n long, mark binary")
    for block in (5, 1_000):
        rows = near_dedup._near(frame, told, 68, 80, block).collect()
        assert len(rows) == len(expected) and {(r["group_id"], r["class_id"]) for r in rows} == expected
        assert all(r["minor"] == (r["class_id"] % 7 != 0) for r in rows)
    assert 10 < len(expected) < len(groups) - 10

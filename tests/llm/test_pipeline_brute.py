"""The pipeline's stages two to four against plain versions, each on what the one before it kept; packing by its invariants."""

import random
from collections import Counter

import corpus_pipeline
from sparkloom.llm import lines, mixing, packing
from tests.llm.test_dedup_operators import levenshtein, near_brute


def plain_lines(docs):
    """Equal lines of any length but empty ones, two edits from 20 characters on; documents that lose all lines go."""
    seen, out = set(), {}
    for d in sorted(docs):
        kept, whole = [], docs[d].split("\n")
        for line in whole:
            own = line.strip(" \t\r")
            near = len(own) >= lines.LEAST_CHARS and any(abs(len(o) - len(own)) <= 2 and len(o) >= lines.LEAST_CHARS and levenshtein(o, own) <= 2 for o in seen)
            if not own or not (own in seen or near):
                kept.append(line)
            if own:
                seen.add(own)
        if kept or not whole:
            out[d] = "\n".join(kept)
    return out


def plain_mix(docs, sources):
    """{doc_id: copies}: water-filling by trying levels, then passes over each source in seeded order."""
    import hashlib

    sizes = {d: len(t.encode().split()) for d, t in docs.items()}
    of = {s: [d for d in docs if sources[d] == s] for s in sorted(set(sources[d] for d in docs))}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(of)}
    total = {s: sum(sizes[d] for d in ids) for s, ids in of.items()}
    target, free = {}, set(of)
    while True:
        left = 1.5 * sum(total.values()) - sum(target.values())
        level = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if level[s] > 2 * total[s]}
        if not over:
            target |= level
            break
        target |= {s: 2.0 * total[s] for s in over}
        free -= over
        if not free:
            break
    copies = {}
    for s, ids in of.items():
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, at = int(target[s]) - whole * total[s], 0
        for d in sorted(ids, key=lambda d: (hashlib.md5(f"mix:{d}".encode()).hexdigest(), d)):
            more = max(0, min(sizes[d], rest - at))
            at += sizes[d]
            copies[d] = int((whole * sizes[d] + more) / sizes[d] + 0.5) if sizes[d] else 1
    return copies


def test_stages_are_the_plain_versions(spark):
    rng = random.Random(12)
    words = "harbour light stone winter garden letter morning silver window paper bridge summer".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5, 9)))
    docs = {d: "\n".join(sentence() for _ in range(rng.randrange(1, 7))) for d in range(60)}
    for d in range(60, 80):  # near copies of documents, repeated and near lines, copies
        base = docs[rng.randrange(50)]
        docs[d] = base if d % 4 == 0 else base.replace("stone", "stones", 1) + "\n" + sentence() if d % 4 == 1 else sentence() + " " + base.replace("\n", " \n", 1).replace(" ", "  ", 1)
    sources = {d: "abc"[d % 3] if d % 5 else "a" for d in docs}
    frame = spark.createDataFrame([(d, t, "en", sources[d], len(t)) for d, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)

    cut = stages["dedup_lines"](spark, frame, "").cache()
    expected = plain_lines(docs)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == expected

    kept = stages["dedup_near"](spark, cut, "").cache()
    component, _ = near_brute(expected, 5)
    remaining = {d: expected[d] for d in expected if component[d] == d}
    assert {r["doc_id"] for r in kept.collect()} == set(remaining)

    mixed = stages["mix_sources"](spark, kept, "").cache()
    times = plain_mix(remaining, sources)
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({d: n for d, n in times.items() if n})

    packed = stages["pack_bins"](spark, mixed, "").collect()
    sizes = {d: len(t.split()) for d, t in remaining.items()}
    assert sum(r["n_words"] for r in packed) == sum(n * sizes[d] for d, n in times.items())
    fill = Counter()
    for r in packed:
        fill[r["bin_id"]] += r["n_words"]
    assert max(v for b, v in fill.items() if b is not None) <= packing.CAPACITY
    assert mixing.WEIGHTS == (3, 1, 2) and mixing.MAX_EPOCHS == 2

"""op1 over a whole table against a plain version with dictionaries."""

import math
import re
import unicodedata
import zlib

import pytest

from sparkloom.llm import langid, queries
from sparkloom.llm.common import table


def letter_runs(text):
    """Runs of characters of Unicode's category L, as a text without a letter is ``und``."""
    return [run for run in re.split(" +", "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text)) if run]


def test_letters():
    for text in ("½ ½", "² Ⅷ ٣", "a½b Ⅷc _d9e", "", "ª º é日本", "x\u0301y"):
        assert langid.letter_words(text) == letter_runs(text.lower())


def plain_langid(rows):
    """{doc_id: (held_out, lang, score)}; every word and 1- to 4-gram of the teaching documents is known."""
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    words_of = {i: letter_runs((text or "").lower()) for i, text, _ in rows}
    languages = sorted({lang for i, text, lang in rows if lang is not None and text is not None and not held[i]})
    words = {x: {} for x in languages}
    grams = {(x, k): {} for x in languages for k in range(1, 5)}
    prior = dict.fromkeys(languages, 0)
    for i, text, lang in rows:
        if lang is None or text is None or held[i]:
            continue
        prior[lang] += 1
        for w in words_of[i]:
            words[lang][w] = words[lang].get(w, 0) + 1
            for k in range(1, 5):
                marked = w if k == 1 else f"^{w}$"
                for at in range(len(marked) - k + 1):
                    g = marked[at : at + k]
                    grams[lang, k][g] = grams[lang, k].get(g, 0) + 1
    all_words = set().union(*words.values())
    all_grams = {k: set().union(*(grams[x, k] for x in languages)) for k in range(1, 5)}

    sizes = {(x, k): sum(grams[x, k].values()) + 0.5 * len(all_grams[k]) for x in languages for k in range(1, 5)}
    word_sizes = {x: sum(words[x].values()) + 0.5 * len(all_words) for x in languages}
    word_log = {x: {w: math.log((words[x].get(w, 0) + 0.5) / word_sizes[x]) for w in all_words} for x in languages}
    found = {}
    for i, _, _ in rows:
        if not words_of[i]:
            found[i] = (held[i], "und", 0.0)
            continue
        total = {x: math.log(prior[x] / sum(prior.values())) for x in languages}
        for w in words_of[i]:
            if w in all_words:
                for x in languages:
                    total[x] += word_log[x][w]
                continue
            for k in range(4, 0, -1):
                marked = w if k == 1 else f"^{w}$"
                known = [g for at in range(len(marked) - k + 1) if (g := marked[at : at + k]) in all_grams[k]]
                if known:
                    for x in languages:
                        total[x] += sum(math.log((grams[x, k].get(g, 0) + 0.5) / sizes[x, k]) for g in known) / len(known)
                    break
        best = max(languages, key=lambda x: (total[x], [-ord(c) for c in x]))
        found[i] = (held[i], best, 1 / sum(math.exp(total[x] - total[best]) for x in languages))
    return found


def test_op1_is_the_plain_version(spark, sf_dir):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, sf_dir, "documents").collect()]
    expected = plain_langid(rows)
    found = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in queries.op1_langid(spark, sf_dir).collect()}
    assert set(found) == set(expected)
    for i, (held, lang, score) in expected.items():
        assert found[i][:2] == (held, lang)
        assert found[i][2] == pytest.approx(score, abs=1e-6)

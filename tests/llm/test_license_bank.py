"""Automata against a plain matcher on random texts, and whole license bodies that accept no altered wording."""

import random
import re

import pytest

from sparkloom.llm import licenses
from sparkloom.llm.license_templates import TEMPLATES


def expansions(markup):
    """Every way to fill a template: tuples of words, None for any word."""
    marks = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup)

    def parse(at):
        ways = [()]
        while at < len(marks) and marks[at] != "]]":
            if marks[at] == "[[":
                inner, at = parse(at + 1)
                ways = [w + i for w in ways for i in {(), *inner}]
            elif marks[at].startswith("{{"):
                n = int(marks[at][2:-2])
                ways = [w + (None,) * k for w in ways for k in range(n + 1)]
            else:
                ways = [(*w, marks[at]) for w in ways]
            at += 1
        return ways, at

    return set(parse(0)[0])


def plain_places(markup, words):
    """Leftmost start of each earliest end; places don't overlap."""
    found, floor = [], 0
    ways = expansions(markup)
    for end in range(1, len(words) + 1):
        starts = [end - len(w) for w in ways if w and end - len(w) >= floor and all(a is None or a == b for a, b in zip(w, words[end - len(w) : end], strict=True))]
        if starts:
            found.append((min(starts), end))
            floor = end
    return found


@pytest.mark.parametrize("markup", ["a b", "a [[b]] c", "a {{2}} b", "a [[b {{1}} [[c]]]] a", "[[a]] b [[c [[a]] b]]", "a b {{3}} a c", "[[a b]] [[c]] a a"])
def test_automata_are_the_plain_matcher(markup):
    rng = random.Random(markup)
    automaton = licenses.compile_template("t", markup)
    for _ in range(400):
        words = [rng.choice("abcd") for _ in range(rng.randrange(0, 14))]
        assert automaton.scan([w.encode() for w in words]) == plain_places(markup, words)


def filled(markup):
    """The template with its optional regions and one word for each replaceable one."""
    return re.sub(r"\[\[|\]\]", " ", re.sub(r"\{\{\d+\}\}", " someone ", markup))


@pytest.mark.parametrize("label", sorted(k for k, v in TEMPLATES.items() if len(v.split()) > 25))
def test_bodies_accept_their_wording_only(label):
    automaton = licenses.compile_template(label, TEMPLATES[label])
    words, mandatory, depth = [], [], 0
    for mark in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", TEMPLATES[label]):
        if mark in ("[[", "]]"):
            depth += 1 if mark == "[[" else -1
            continue
        if not mark.startswith("{{") and not depth:
            mandatory.append(len(words))
        words.append(b"someone" if mark.startswith("{{") else mark.encode())
    text = [b"before", *words, b"after"]
    assert automaton.scan(text) and automaton.guard in b" " + b" ".join(text) + b" "
    for i in random.Random(label).sample(mandatory, 20):
        assert not automaton.scan([b"before", *words[:i], b"altered", *words[i + 1 :], b"after"])


def test_altered_mit_is_not_mit():
    text = filled(TEMPLATES["mit"])
    whole = licenses.scan_text(text.encode(), [licenses.compile_template(k, v) for k, v in TEMPLATES.items()], licenses.BASE_PHRASES)
    altered = licenses.scan_text(text.replace("sublicense", "lend").encode(), [licenses.compile_template(k, v) for k, v in TEMPLATES.items()], licenses.BASE_PHRASES)
    assert "mit" in whole[5].split(",") and "mit" not in altered[5].split(",") and "mit-grant" in altered[5]


@pytest.mark.parametrize(
    ("notice", "label"),
    [
        ("This work is licensed under CC BY-SA 4.0", "cc-by-sa"),
        ("Distributed under the Boost Software License, Version 1.0.", "boost-notice"),
        ("Released under the ISC License", "isc-notice"),
        ("Available under the Unlicense", "unlicense-name"),
        ("under the terms of the GNU Lesser General Public License version 3", "lgpl-any"),
        ("under the GNU Affero General Public License", "agpl-any"),
        ("Licensed under the MIT License", "mit-notice"),
    ],
)
def test_notices(notice, label):
    found = licenses.scan_text(notice.encode(), [licenses.compile_template(k, v) for k, v in TEMPLATES.items()], licenses.BASE_PHRASES)
    assert label in found[5].split(",")

"""License scan by matching template markup.

A template is mandatory wording with marked regions: ``[[ ... ]]`` is optional (it may nest) and
``{{n}}`` is replaceable by zero to n words. ``compile_template`` makes a token automaton of it: one
state before each mandatory token, free steps around optional regions, and a chain of n skippable states
that take any word for a replaceable one. ``scan`` follows all starts of a text at once, keeping for each
state the leftmost start, and accepts where the last state is reached; a text is accepted only where the
mandatory words stand exactly. Accepted places don't overlap within a template: the first to end wins.

An automaton runs only over texts that hold its guard, the longest mandatory run of tokens outside any
region; that test loses nothing, as every accepted place holds it.

Base phrases are plain: places where their words stand consecutively.

Defined cases: null and empty texts have no words, null first and last places, empty label strings and
score 0; score is the share of words inside accepted or base places; repeated rows are scanned one by
one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.common import as_bytes, map_batches, small_batches
from sparkloom.llm.license_templates import TEMPLATES

# Base phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

_MARKUP = re.compile(r"\[\[|\]\]|\{\{(\d+)\}\}|[^\s\[\]{}]+")

#: ASCII letters fall to lower case; ASCII that is neither letter nor digit becomes a blank.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text given as UTF-8."""
    return (text or b"").translate(_FOLD).split()


@dataclass(frozen=True)
class Automaton:
    """``tokens[s]`` is what state s takes (None: any word) to state s + 1; ``free[s]`` are all states reached from s without a word."""

    label: str
    tokens: tuple[bytes | None, ...]
    free: tuple[tuple[int, ...], ...]
    guard: bytes

    def scan(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Accepted places as (start, end), end exclusive."""
        last, found, live, floor = len(self.tokens), [], {}, 0
        firsts = {self.tokens[s] for s in self.free[0] if s < last}
        for at, word in enumerate(words):
            if None in firsts or word in firsts:
                for state in self.free[0]:
                    live.setdefault(state, at)
            if not live:
                continue
            after: dict[int, int] = {}
            for state, start in live.items():
                if state < last and start >= floor and self.tokens[state] in (None, word):
                    for to in self.free[state + 1]:
                        if start < after.get(to, at + 1):
                            after[to] = start
            live = after
            if last in live:
                found.append((live[last], at + 1))
                live, floor = {}, at + 1
        return found


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of a template; raises ValueError for unbalanced regions or one without mandatory words."""
    tokens: list[bytes | None] = []
    jumps: dict[int, set[int]] = {}
    opened: list[int] = []
    runs: list[list[bytes]] = [[]]
    for found in _MARKUP.finditer(markup):
        mark = found[0]
        if mark == "[[":
            opened.append(len(tokens))
            runs.append([])
        elif mark == "]]":
            if not opened:
                raise ValueError(f"{label}: a region is closed that isn't open")
            jumps.setdefault(opened.pop(), set()).add(len(tokens))
            runs.append([])
        elif found[1]:
            for _ in range(int(found[1])):
                jumps.setdefault(len(tokens), set()).add(len(tokens) + 1)
                tokens.append(None)
            runs.append([])
        else:
            for token in words_of(mark.encode()):
                tokens.append(token)
                if not opened:
                    runs[-1].append(token)
    if opened:
        raise ValueError(f"{label}: a region stays open")
    guard = max(runs, key=lambda r: len(b" ".join(r)))
    if not guard:
        raise ValueError(f"{label}: no mandatory words")

    def closure(state: int) -> tuple[int, ...]:
        seen, todo = {state}, [state]
        while todo:
            for to in jumps.get(todo.pop(), ()):
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return tuple(sorted(seen))

    return Automaton(label, tuple(tokens), tuple(closure(s) for s in range(len(tokens) + 1)), b" " + b" ".join(guard) + b" ")


def phrase_starts(line: bytes, phrase: bytes) -> list[int]:
    """Word places of a phrase in words joined and bordered by blanks; places may overlap."""
    found, at = [], line.find(phrase)
    while at >= 0:
        found.append(line.count(b" ", 0, at))
        at = line.find(phrase, at + 1)
    return found


def scan_text(text: bytes | None, automata: list[Automaton], base: dict[str, str]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans)."""
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    places: list[tuple[int, int, str, bool]] = []
    for phrase, label in base.items():
        needle = b" " + phrase.encode() + b" "
        places += [(at, at + phrase.count(" ") + 1, label, True) for at in phrase_starts(line, needle)]
    for automaton in automata:
        if automaton.guard in line:
            places += [(a, b, automaton.label, False) for a, b in automaton.scan(words)]
    starts = [p[0] for p in places if p[3]]
    covered, reached = 0, 0
    for start, end, _, _ in sorted(places):
        covered += max(0, end - max(start, reached))
        reached = max(reached, end)
    of = lambda kept: ",".join(sorted({p[2] for p in places if kept(p)}))
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        of(lambda p: p[3]),
        of(lambda p: True),
        covered / len(words) if words else 0.0,
        [{"start": a, "end": b, "label": x} for a, b, x, _ in sorted(places)],
    )


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """One row a document, with the spans of all places in words (``end`` exclusive)."""
    small_batches(docs.sparkSession)
    automata = [compile_template(k, v) for k, v in (TEMPLATES if templates is None else templates).items()]
    phrases = BASE_PHRASES if base is None else base
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64()}
    kinds |= {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": SPANS}

    def work(batch: pa.RecordBatch):
        rows = [scan_text(x, automata, phrases) for x in as_bytes(batch.column(1))]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *kinds])

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string>>"
    return map_batches(docs.select(docs["doc_id"], docs["text"]), work, schema)

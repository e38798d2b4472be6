"""Substring dedup by recompression.

A document is a sequence of word hashes. Each round names maximal runs of a symbol, then pairs of a left
symbol followed by a right one, where a hash of the symbol itself says which it is. Names are hashes of what they
stand for, so equal content gets equal names in every task without any exchange, and equal substrings
are parsed alike except at their borders: a run at a border may go on outside it, and so may a pair.

For a window of ``width`` words, the symbols that its own words determine form an interval at each round.
The window's anchor is the symbol of least hash in the last non-empty interval: equal windows have equal
anchors at equal places. Few windows in a row share each anchor, and only anchors are exchanged:

1. Each anchor's symbol, with as many words to both sides as rounds were made (they lie inside every
   window that has the anchor), is a key. Keys that occur once rule out all their windows.
2. Windows of the other anchors are confirmed by two hashes (96 bits) of their whole word sequences: of each sequence,
   the first place (by document, then word) stays and the others are repeats.
3. Words covered by a repeated window go.

Windows without a symbol after two rounds (long runs and short periods) are their own anchors.

What repeats within one Arrow batch is settled there, and only one row of it goes on, so that a passage
in a third of all documents meets in one task with one row a batch.

Defined cases: null and empty texts have no words; a row with a null id loses nothing and shows nothing
to others; repeated rows are one document; an empty table gives no rows; extra columns are ignored. Long texts are
parsed ``CHUNK`` windows at a time, which changes no result, since anchors depend on windows only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import as_bytes, map_batches, small_batches, stored
from sparkloom.llm.shingles import mixed, sequence_hashes, word_hashes

WIDTH = 20
ROUNDS = 3
#: Windows that are parsed at once.
CHUNK = 150_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_RUN = np.uint64(0xA24BAED4963EE407)
_PAIR = np.uint64(0x9FB21C651E98DF25)
#: What words' hashes are changed by for the second hash of a window.
SECOND = np.uint64(0x6C62272E07BB0142)


def _powers(base: np.uint64, count: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(count - 1, 0), base, dtype=np.uint64))])[:count]


class Rounds:
    """Windows of a word sequence and their anchors. ``starts``: where windows begin, ascending."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, width: int, rounds: int = ROUNDS):
        level = np.zeros(len(starts), dtype=np.int64)
        self.first, self.end = starts.copy(), starts + width
        live, low, high = np.arange(len(starts)), starts.copy(), starts + width
        symbols, begins = words, np.arange(len(words))
        kept = []
        for turn in range(1, rounds + 1):
            if not len(live):
                break
            salt = mixed(np.array([turn], dtype=np.uint64))[0]
            fresh = np.concatenate([[True], symbols[1:] != symbols[:-1]])
            head = np.flatnonzero(fresh)
            run_of = np.cumsum(fresh) - 1
            times = np.diff(np.append(head, len(symbols))).astype(np.uint64)
            symbols = np.where(times > 1, mixed(symbols[head] * _RUN + times + salt), symbols[head])
            begins = begins[head]
            low, high = run_of[low] + 1, run_of[high - 1]  # a border's run may go on outside
            live, low, high = (x[low < high] for x in (live, low, high))
            left = (mixed(symbols + salt) & np.uint64(1)).astype(bool)
            low = low + ~left[low]  # a right symbol may belong to what stands before the border
            high = high - left[high - 1]
            live, low, high = (x[low < high] for x in (live, low, high))
            joins = np.append(left[:-1] & ~left[1:], False)
            second = np.concatenate([[False], joins[:-1]])
            stay = np.flatnonzero(~second)
            new_of = np.cumsum(~second) - 1
            pair = joins[stay]
            names = symbols[stay]
            names[pair] = mixed(names[pair] * _PAIR + mixed(symbols[stay[pair] + 1]) + salt)
            symbols, begins = names, begins[stay]
            low, high = new_of[low], new_of[high - 1] + 1
            if turn >= 2:
                kept.append((turn, live, low, high, symbols, np.append(begins, len(words))))
        for turn, live, low, high, symbols, begins in reversed(kept):
            own = level[live] == 0
            live, low, high = live[own], low[own], high[own]
            rank = mixed(symbols ^ _RUN)
            best, at = np.full(len(live), np.uint64(2**64 - 1)), low.copy()
            for step in range(int((high - low).max(initial=0))):
                inside = low + step < high
                value = rank[np.minimum(low + step, len(rank) - 1)]
                less = inside & (value < best)
                best[less], at[less] = value[less], (low + step)[less]
            level[live] = turn
            self.first[live], self.end[live] = begins[at], begins[at + 1]
        self.level = level
        self.starts = starts
        self.words = words
        self.width = width

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, first window, last window) of each anchor."""
        if not len(self.starts):
            return np.empty(0, np.uint64), self.starts, self.starts
        name = self.first * 8 + self.level
        order = np.argsort(name, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
        tail = np.append(head[1:], len(order)) - 1
        of, last = order[head], order[tail]
        begin, end = self.first[of] - self.level[of], self.end[of] + self.level[of]
        up, down = _powers(_BASE, len(self.words)), _powers(_INVERSE, len(self.words))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * up, dtype=np.uint64)])
        keys = mixed((sums[end] - sums[begin]) * down[begin] + ((end - begin) * 8 + self.level[of]).astype(np.uint64) * _RUN)
        return keys, self.starts[of], self.starts[last]


def _chunks(texts: list[bytes | None], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, window starts, row of each window, its place in the row) of rows joined to chunks."""
    parts, starts, rows, places, size = [], [], [], [], 0
    for row, text in enumerate(texts):
        words = (text or b"").split()
        if len(words) < width:
            continue
        hashes = word_hashes(words)
        for at in range(0, len(hashes) - width + 1, CHUNK):
            some = hashes[at : at + CHUNK + width - 1]
            windows = np.arange(len(some) - width + 1)
            parts.append(some)
            starts.append(windows + size)
            rows.append(np.full(len(windows), row))
            places.append(windows + at)
            size += len(some)
            if size >= CHUNK:
                yield np.concatenate(parts), np.concatenate(starts), np.concatenate(rows), np.concatenate(places)
                parts, starts, rows, places, size = [], [], [], [], 0
    if parts:
        yield np.concatenate(parts), np.concatenate(starts), np.concatenate(rows), np.concatenate(places)


def _routed(keys: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, whether a row repeats an earlier one of its key there, and each row's route: the key, or ``spread`` for repeats."""
    order = np.argsort(keys, kind="stable")
    again = np.concatenate([[False], keys[order][1:] == keys[order][:-1]]) if len(keys) else np.empty(0, bool)
    return order, again, np.where(again, mixed(spread[order]), keys[order])


def _anchors(docs: DataFrame, width: int) -> DataFrame:
    """(route, key, doc_id, low, high, known): anchors with their windows' range; known: its key repeats."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch):
        for words, starts, rows, places in _chunks(as_bytes(batch.column(1)), width):
            keys, low, high = Rounds(words, starts, width).anchors()
            at = np.searchsorted(starts, low)
            order, again, route = _routed(keys, (rows[at] * 2**32 + places[at]).astype(np.uint64))
            known = again | np.append(again[1:], False)
            at = at[order]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(route.view(np.int64)),
                    pa.array(keys[order].view(np.int64)),
                    batch.column(0).take(pa.array(rows[at])),
                    pa.array(places[at].astype(np.int32)),
                    pa.array((places[at] + high[order] - low[order]).astype(np.int32)),
                    pa.array(known),
                ],
                names=["route", "key", "doc_id", "low", "high", "known"],
            )

    return map_batches(docs, work, f"route long, key long, doc_id {kind}, low int, high int, known boolean")


def _repeated(anchors: DataFrame) -> DataFrame:
    """(doc_id, low, high) of anchors whose key repeats: a stream over rows sorted by key, one row of memory."""
    kind = anchors.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            keys = whole.column(0).to_numpy()
            same = keys[1:] == keys[:-1]
            take = whole.column(4).to_numpy(zero_copy_only=False).copy()
            take[1:] |= same
            take[:-1] |= same
            out = whole.slice(0, len(keys) - 1).filter(pa.array(take[:-1]))
            held = whole.slice(len(keys) - 1)
            if take[-1] and not held.column(4)[0].as_py():
                held = held.set_column(4, "known", pa.array([True]))
            yield pa.RecordBatch.from_arrays([out.column(i) for i in (1, 2, 3)], names=["doc_id", "low", "high"])
        if held is not None:
            out = held.filter(held.column(4))
            yield pa.RecordBatch.from_arrays([out.column(i) for i in (1, 2, 3)], names=["doc_id", "low", "high"])

    sorted_rows = anchors.repartition("route").sortWithinPartitions("key").select("key", "doc_id", "low", "high", "known")
    return sorted_rows.mapInArrow(run, f"doc_id {kind}, low int, high int")


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """(route, print, more, doc_id, place, known) of windows in ranges; known: an earlier place has the same words.

    A word sequence is told by ``print`` and ``more`` together, 96 bits of two hashes: of 10**12 windows, some two differ and agree in them
    with a chance under 1e-5. The route is 32 bits of the print, so the wider print takes no more room."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch):
        own, prints, further, places = [], [], [], []
        asked = np.flatnonzero(batch.column(2).is_valid())
        for row, text in zip(asked.tolist(), as_bytes(batch.column(1).take(pa.array(asked))), strict=True):
            words = (text or b"").split()
            count = len(words) - width + 1
            if count < 1:
                continue
            marks = np.zeros(count + 1, dtype=np.int32)
            low, high = (np.array(batch.column(i)[row].as_py(), dtype=np.int64) for i in (2, 3))
            np.add.at(marks, np.minimum(low, count), 1)
            np.add.at(marks, np.minimum(high + 1, count), -1)
            at = np.flatnonzero(np.cumsum(marks)[:-1])
            if len(at):
                hashes = word_hashes(words)
                prints.append(sequence_hashes(hashes, width)[at])
                further.append(sequence_hashes(mixed(hashes ^ SECOND), width)[at] >> np.uint64(32))
                places.append(at)
                own.append(np.full(len(at), row))
        if not own:
            return
        prints, places, own, further = np.concatenate(prints), np.concatenate(places), np.concatenate(own), np.concatenate(further)
        ids = np.array(batch.column(0).to_pylist())[own]
        order = np.lexsort((places, ids))
        prints, places, own, ids, further = prints[order], places[order], own[order], ids[order], further[order]
        order, again, route = _routed(prints, (own * 2**32 + places).astype(np.uint64))
        same = np.zeros(len(order), dtype=bool)  # repeated rows: the very same place again
        same[1:] = again[1:] & (ids[order][1:] == ids[order][:-1]) & (places[order][1:] == places[order][:-1])
        stay = ~same
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((route[stay] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)),
                pa.array(prints[order][stay].view(np.int64)),
                pa.array(further[order][stay].astype(np.uint32).view(np.int32)),
                batch.column(0).take(pa.array(own[order][stay])),
                pa.array(places[order][stay].astype(np.int32)),
                pa.array(again[stay]),
            ],
            names=["route", "print", "more", "doc_id", "place", "known"],
        )

    return map_batches(docs, work, f"route int, print long, more int, doc_id {kind}, place int, known boolean")


def _later(windows: DataFrame) -> DataFrame:
    """(doc_id, place) of windows that aren't the first of their print, from a stream sorted by print and place."""
    kind = windows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first row of the print that a batch ended in
        for batch in batches:
            known = batch.column(4).to_numpy(zero_copy_only=False)
            settled, batch = batch.filter(pa.array(known)), batch.filter(pa.array(~known))
            yield pa.RecordBatch.from_arrays([settled.column(2), settled.column(3)], names=["doc_id", "place"])
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            prints, more, ids, places = (whole.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            head = np.concatenate([[True], (prints[1:] != prints[:-1]) | (more[1:] != more[:-1])])
            first = np.maximum.accumulate(np.where(head, np.arange(len(prints)), 0))
            later = (ids != ids[first]) | (places != places[first])
            out = whole.filter(pa.array(later))
            held = whole.slice(int(first[-1]), 1)
            yield pa.RecordBatch.from_arrays([out.column(2), out.column(3)], names=["doc_id", "place"])

    sorted_rows = windows.repartition("route").sortWithinPartitions("print", "more", "doc_id", "place").select("print", "more", "doc_id", "place", "known")
    return sorted_rows.mapInArrow(run, f"doc_id {kind}, place int")


def dedup_substrings(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of each row of ``docs`` (doc_id, text); kept words are joined by one blank."""
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"], docs["text"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(spark)
    anchors = _anchors(docs.where("doc_id IS NOT NULL"), width)
    small_batches(spark, 4_000)
    repeated = stored(_repeated(anchors), "anchors")
    small_batches(spark, 512)
    ranges = repeated.groupBy(F.col("doc_id").alias("of_doc")).agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    # Both joins are left ones over the same columns, so that one exchange of the texts serves both.
    windows = _windows(docs.join(ranges, F.col("doc_id") == F.col("of_doc"), "left").select("doc_id", "text", "lows", "highs"), width)
    later = _later(windows).groupBy(F.col("doc_id").alias("of_doc")).agg(F.collect_list("place").alias("places"))

    def rewrite(batch: pa.RecordBatch):
        rows = []
        for text, places in zip(as_bytes(batch.column(1)), batch.column(2), strict=True):
            words = (text or b"").split()
            marks = np.zeros(len(words) + 1, dtype=np.int32)
            if places.is_valid:
                at = places.values.to_numpy()
                at = at[at + width <= len(words)]
                np.add.at(marks, at, 1)
                np.add.at(marks, at + width, -1)
            gone = np.cumsum(marks)[:-1] > 0
            kept = b" ".join([words[i] for i in np.flatnonzero(~gone)]) if gone.any() else b" ".join(words)
            rows.append((len(words), int(gone.sum()), kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_text"],
        )

    joined = docs.join(later, F.col("doc_id") == F.col("of_doc"), "left").select("doc_id", "text", "places")
    return map_batches(joined, rewrite, f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def digest(found: DataFrame) -> DataFrame:
    """The kept texts' SHA-256 in place of the texts."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str | None], width: int = WIDTH) -> dict[int, tuple[int, int, str]]:
    """The definition itself, for tests: all windows in one table."""
    seen: set = set()
    out = {}
    for doc in sorted(texts):
        words = (texts[doc] or "").encode().split()
        gone = [False] * len(words)
        for at in range(len(words) - width + 1):
            window = tuple(words[at : at + width])
            if window in seen:
                gone[at : at + width] = [True] * width
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS at_word FROM later, (SELECT unnest(range(0, 20)) AS k)),
each_word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at_word FROM w),
kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.at_word) AS txt FROM each_word e
  LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.at_word = e.at_word WHERE g.doc_id IS NULL GROUP BY e.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.txt, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

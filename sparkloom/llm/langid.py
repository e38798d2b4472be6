"""Language identification by word-first backoff.

A known word adds its log frequency in each language. An unseen word falls back to its character
4-grams (with ``^`` and ``$`` at the word's ends), then 3-, 2- and 1-grams: the first order of which any
gram is known adds the mean log frequency of those grams. The posterior over the learned languages is
the normalised exponential of the sums; its top is the prediction and its share the score.

The posterior tells languages apart and not whether a text is in any of them. That is told by the evidence:
a text's mean over its words of 1 for a known word that its predicted language has, 0 for another known word, and
for an unseen word the share of its 4-grams that the language has. ``identified`` asks for some evidence, and for
``EVIDENCE`` times what all but ``OUTLIERS`` of the teaching documents reach, each without its own counts.

Fit: on a sample of at most ``FIT_DOCS`` labelled documents (those of smallest seeded id hash), counted
whole on the executors: words first, then the grams of each distinct word, as often as the word came. The model keeps every word and gram of
the sample, so the bound on documents bounds what is broadcast. Prediction reads every whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any learned
language every text is ``und`` with score 0; ties of score go to the alphabetically first language, ties
of count to the alphabetically first entry; documents whose lang is null don't teach; repeated rows are
predicted one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_sample, cut, held_out, map_batches, small_batches

#: Labelled documents that the model is fitted on.
FIT_DOCS = 5_000
MAX_GRAM = 4
SMOOTHING = 0.5
#: Unseen words whose fallback a worker remembers; it forgets all when that many are reached.
CACHE_WORDS = 100_000
UNKNOWN = "und"
#: Documents that the least evidence is fitted on, the share of them that may lie lower, and what a text must have of theirs.
EVIDENCE_DOCS = 2_000
OUTLIERS = 0.02
EVIDENCE = 0.8

WORD = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """Lower-cased runs of letters, which are the characters of category L; other numbers than digits (``½``, ``Ⅷ``) part runs."""
    found = WORD.findall(text.lower())
    if "".join(found).isalpha() or not found:
        return found
    return [run for word in found for run in "".join(c if c.isalpha() else " " for c in word).split(" ") if run]


def grams(word: str, order: int) -> list[str]:
    marked = f"^{word}$" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


class Model:
    """Log frequencies of words and grams by language."""

    def __init__(self, languages: list[str], priors: list[float], words: dict[str, list[int]], by_gram: dict[str, list[int]]):
        self.languages = languages
        self.priors = np.array(priors)
        self.least_evidence = 0.0
        self.words, self.word_logs = self._logs(words)
        self.word_counts = self._counts(words)
        self.grams: dict[str, int] = {}
        tables, gram_counts = [], []
        for order in range(1, MAX_GRAM + 1):
            of_order = {g: n for g, n in by_gram.items() if len(g) == order}
            index, logs = self._logs(of_order)
            self.grams |= {g: i + sum(map(len, tables)) for g, i in index.items()}
            tables.append(logs)
            gram_counts.append(self._counts(of_order))
        self.gram_logs = np.concatenate(tables)
        self.gram_counts = np.concatenate(gram_counts)

    def _counts(self, counts: dict[str, list[int]]) -> np.ndarray:
        return np.array(list(counts.values()), dtype=np.int64).reshape(len(counts), len(self.languages))

    def _logs(self, counts: dict[str, list[int]]) -> tuple[dict[str, int], np.ndarray]:
        table = np.array(list(counts.values()), dtype=float).reshape(len(counts), len(self.languages)) + SMOOTHING
        return {k: i for i, k in enumerate(counts)}, np.log(table / table.sum(axis=0)) if len(counts) else table

    def fallback(self, word: str) -> np.ndarray | None:
        for order in range(MAX_GRAM, 0, -1):
            known = [g for x in grams(word, order) if (g := self.grams.get(x)) is not None]
            if known:
                return np.add.reduce(self.gram_logs[known], axis=0) / len(known)
        return None

    def evidence(self, text: str, language: str, cache: dict, own: str | None = None) -> float:
        """Share of the words of ``text`` that speak for ``language``; what only ``text`` itself has taught, as one of language ``own``, doesn't."""
        counted = Counter(letter_words(text))
        at = self.languages.index(language)
        taught: Counter = Counter()
        if own == language:
            for word, n in counted.items():
                for gram in grams(word, MAX_GRAM):
                    taught[gram] += n
        total = 0.0
        for word, n in counted.items():
            row = self.words.get(word)
            every = None if row is None or own is None else self.word_counts[row].sum()
            if row is not None and every != n:
                total += n * bool(self.word_counts[row, at] > (n if own == language else 0))
                continue
            share = None if own is not None else cache.get((word, at))
            if share is None:
                found = grams(word, MAX_GRAM)
                has = sum(1 for g in found if (i := self.grams.get(g)) is not None and self.gram_counts[i, at] > taught[g])
                share = has / len(found) if found else 0.0
                if own is None:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[word, at] = share
            total += n * share
        return total / max(1, counted.total())

    def identified(self, text: str | None, least: float, cache: dict, shares: dict) -> bool:
        """Whether the language of ``text`` is told, by its posterior and by evidence; never by the prior alone."""
        language, score = self.predict(text, cache)
        if language == UNKNOWN or score < least:
            return False
        found = self.evidence(text, language, shares)
        return found > 0 and found >= self.least_evidence

    def predict(self, text: str | None, cache: dict) -> tuple[str, float]:
        words = letter_words(text) if text else []
        if not words or not self.languages:
            return UNKNOWN, 0.0
        total = np.log(self.priors)
        seen, times, unseen = [], [], []
        known = self.words.get
        for word, n in Counter(words).items():
            at = known(word)
            if at is not None:
                seen.append(at)
                times.append(n)
                continue
            found = cache.get(word, self)
            if found is self:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                found = cache[word] = self.fallback(word)
            if found is not None:
                unseen.append(found if n == 1 else n * found)
        if seen:
            total = total + np.array(times, dtype=float) @ self.word_logs[seen]
        if unseen:
            total = total + np.add.reduce(unseen, axis=0)
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def fit_evidence(docs: DataFrame, model: Model, fit_docs: int = FIT_DOCS, most: int = EVIDENCE_DOCS) -> Model:
    """``model``, fitted on the same ``docs`` and ``fit_docs``, with its least evidence from at most ``most`` of them."""
    labelled = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    chosen = bounded_sample(labelled.select("doc_id"), ["doc_id"], min(most, fit_docs), "langid")
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("chosen_id")).distinct())
    sample = labelled.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen_id")), "left_semi").select("lang", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch):
        rows = [(lang, text) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if letter_words(text)]
        yield pa.RecordBatch.from_arrays([pa.array([shared.value.evidence(text, lang, {}, lang) for lang, text in rows], pa.float64())], names=["evidence"])

    found = [r["evidence"] for r in map_batches(sample, work, "evidence double").collect()]
    model.least_evidence = EVIDENCE * float(np.quantile(found, OUTLIERS)) if found else 0.0
    return model


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """A model of ``docs`` (doc_id, text, lang); the sample it counts is bounded by the parameter."""
    small_batches(docs.sparkSession)
    labelled = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    chosen = bounded_sample(labelled.select("doc_id"), ["doc_id"], fit_docs, "langid")
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("chosen_id")).distinct())
    sample = labelled.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen_id")), "left_semi").select("lang", "text")

    def batch_of(keys: list, counts: Counter, names: list[str]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(len(names) - 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([counts[k] for k in keys], pa.int64())], names=names)

    def count_words(batch: pa.RecordBatch):
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[lang, ""] += 1  # no word is empty: this counts documents
            for word, n in Counter(letter_words(text)).items():
                counts[lang, word] += n
        yield batch_of(list(counts), counts, ["lang", "word", "n"])

    def count_grams(batch: pa.RecordBatch):
        counts: Counter = Counter()
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for order in range(1, MAX_GRAM + 1):
                for gram in grams(word, order):
                    counts[lang, gram] += n
        yield batch_of(list(counts), counts, ["lang", "gram", "n"])

    words = cut(map_batches(sample, count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    by_gram = map_batches(words.where("word <> ''"), count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    documents = {r["lang"]: r["n"] for r in words.where("word = ''").collect()}
    languages = sorted(documents)
    place = {x: i for i, x in enumerate(languages)}

    def of(counted: DataFrame) -> dict[str, list[int]]:
        """Counts by language of each entry, entries in order; as many as the sample's documents have."""
        found: dict[str, list[int]] = {}
        for lang, entry, n in zip(*(column.to_pylist() for column in counted.toArrow().columns), strict=True):
            found.setdefault(entry, [0] * len(languages))[place[lang]] = n
        return dict(sorted(found.items()))

    if not languages:
        return Model([], [], {}, {})
    every = sum(documents.values())
    return Model(languages, [documents[x] / every for x in languages], of(words.where("word <> ''")), of(by_gram))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    cache: dict = {}  # each worker gets its own copy

    def work(batch: pa.RecordBatch):
        found = [shared.value.predict(x, cache) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
            names=["doc_id", "lang_pred", "score"],
        )

    return map_batches(docs.select(docs["doc_id"], docs[text]), work, f"doc_id {kind}, lang_pred string, score double")


def teaching(docs: DataFrame) -> DataFrame:
    """The documents that may teach: not held out."""
    return docs.where(~held_out(F.col("doc_id")))


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` without those whose language isn't told: ``und``, a score under ``least``, or too little evidence. Columns stay."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    cache: dict = {}
    shares: dict = {}

    def work(batch: pa.RecordBatch):
        yield batch.filter(pa.array([shared.value.identified(x, least, cache, shares) for x in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(lambda batches: (out for batch in batches for out in work(batch)), docs.schema)


def with_fold(found: DataFrame) -> DataFrame:
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")



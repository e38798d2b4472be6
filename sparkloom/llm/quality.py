"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its score comes from features of itself and of the lines before and after it;
neighbouring labels are tied by a transition matrix. Forward-backward gives each line's marginal of
being good, and a document's score is their mean weighted by line length.

Fit: on at most ``FIT_DOCS`` labelled documents (smallest seeded id hash), whole. Labels are of documents and not of lines, so
lines are labelled first: a model without ties between neighbours learns from the documents' labels, and a line then keeps
its document's label unless its own features speak against it by more than ``DOUBT`` (in log odds); the line that speaks most for the
document's label always keeps it. The field is trained on those line labels, so transitions between good and bad lines within a document
are seen. Scoring reads every line. Gradients are exact (expected minus seen features), the optimiser is Adam in a fixed
order, so that a refit gives the same weights.

Defined cases: null and empty texts are one empty line and get its marginal; without labelled rows every
score is 0.5; labels that are null don't teach; repeated rows are scored one by one; repeated labels
of a document teach by their smallest; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_sample, map_batches, small_batches

FIT_DOCS = 3_000
#: Lines, padding included, whose gradient is worked out at once.
BATCH_LINES = 40_000
EPOCHS = 150
#: Log odds against its document's label from which a line has the other one.
DOUBT = 0.25
RATE = 0.05
RIDGE = 1e-4
THRESHOLD = 0.3

_ODD = re.compile(r"[^\w\s.,;:'\"()?\-]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"\d")

#: Own features of a line; neighbours' ones follow in the same order, before and after.
OWN = ("length", "words", "word length", "upper", "digits", "odd", "odd words", "same next", "distinct", "ends", "starts upper", "repeated", "empty")


def line_features(line: str, seen: set[int]) -> tuple[float, ...]:
    """The line's own features; ``seen`` holds hashes of the document's earlier lines."""
    words = line.split()
    n, chars = len(words), len(line)
    mark = hash(line)
    repeated = mark in seen
    seen.add(mark)
    if not n:
        return (0.0,) * 11 + (float(repeated), 1.0)
    return (
        np.log1p(chars) / 6,
        np.log1p(n) / 5,
        min(chars / n / 10, 4.0),
        len(_UPPER.findall(line)) / chars,
        len(_DIGIT.findall(line)) / chars,
        min(10 * len(_ODD.findall(line)) / chars, 5.0),
        sum(not w[-1].isalnum() and w[-1] not in ".,;:'\"()?-" for w in words) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(words)) / n if n > 3 else 1.0,
        float(line.rstrip()[-1] in ".?!:\"'"),
        float(line.lstrip()[0].isupper()),
        float(repeated),
        0.0,
    )


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features with a bias last, lengths) of a text; neighbours beyond its ends are all zero."""
    lines = (text or "").split("\n")
    seen: set[int] = set()
    own = np.array([line_features(x, seen) for x in lines])
    edge = np.zeros((1, own.shape[1]))
    whole = np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.ones((len(lines), 1))])
    return whole, np.array([max(1, len(x)) for x in lines], dtype=float)


def marginals(scores: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """P(good) of each line: ``scores`` are the good label's log potentials, ``transition`` log potentials by label pair."""
    n = len(scores)
    forward, backward = np.zeros(n), np.zeros(n)
    (t00, t01), (t10, t11) = np.exp(transition)
    grow = np.exp(np.clip(scores, -50, 50))
    ahead = 0.5
    for i in range(n):  # share of good among the prefix's weight
        good, bad = ahead * grow[i], 1 - ahead
        forward[i] = here = good / (good + bad)
        one, zero = here * t11 + (1 - here) * t01, here * t10 + (1 - here) * t00
        ahead = one / (one + zero)
    back = 0.5
    for i in range(n - 1, -1, -1):
        backward[i] = back
        good, bad = back * grow[i], 1 - back
        one, zero = t11 * good + t10 * bad, t01 * good + t00 * bad
        back = one / (one + zero)
    good, bad = forward * backward, (1 - forward) * (1 - backward)
    return good / np.maximum(good + bad, 1e-300)


class Model:
    """Weights of line features and of label pairs; none: every score is 0.5."""

    def __init__(self, weights: np.ndarray | None = None, transition: np.ndarray | None = None):
        self.weights, self.transition = weights, transition

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.5
        rows, lengths = features(text)
        return float(np.clip(marginals(rows @ self.weights, self.transition) @ lengths / lengths.sum(), 0, 1))


def _padded(sequences: list[np.ndarray]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """(numbers of sequences, features, mask) of sequences of similar length, at most ``BATCH_LINES`` lines or one sequence each."""
    groups: list[list[int]] = []
    for i in sorted(range(len(sequences)), key=lambda i: len(sequences[i])):
        if groups and (len(groups[-1]) + 1) * len(sequences[i]) <= BATCH_LINES:
            groups[-1].append(i)
        else:
            groups.append([i])
    found = []
    for group in groups:
        steps = max(len(sequences[i]) for i in group)
        x, mask = np.zeros((len(group), steps, sequences[0].shape[1])), np.zeros((len(group), steps))
        for row, i in enumerate(group):
            x[row, : len(sequences[i])], mask[row, : len(sequences[i])] = sequences[i], 1
        found.append((group, x, mask))
    return found


def _maximised(batches: list, labels: list[np.ndarray], tied: bool, epochs: int) -> np.ndarray:
    """Weights of maximum likelihood with a ridge; those of label pairs stay 0 unless ``tied``."""
    width = batches[0][1].shape[2]
    lines = sum(mask.sum() for _, _, mask in batches)
    seen = []
    for group, _, mask in batches:
        y = np.zeros(mask.shape)
        for row, i in enumerate(group):
            y[row, : len(labels[i])] = labels[i]
        seen.append(y)
    theta, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for epoch in range(1, epochs + 1):
        slope = RIDGE * theta
        for (_, x, mask), y in zip(batches, seen, strict=True):
            slope += _gradient(theta, x, mask, y) / lines
        if not tied:
            slope[width:] = 0
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta - RATE * 4 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return theta


def line_labels(sequences: list[np.ndarray], labels: list[int], weights: np.ndarray, doubt: float = DOUBT) -> list[np.ndarray]:
    """0 or 1 of each line, from its document's label and its own log odds."""
    found = []
    for x, label in zip(sequences, labels, strict=True):
        odds = x @ weights
        own = (odds + (doubt if label else -doubt) > 0).astype(float)
        own[np.argmax(odds if label else -odds)] = label
        found.append(own)
    return found


def train(sequences: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> Model:
    """A field over lines from sequences of line features and one label each."""
    if not sequences:
        return Model()
    width = sequences[0].shape[1]
    batches = _padded(sequences)
    alone = _maximised(batches, [np.full(len(x), float(y)) for x, y in zip(sequences, labels, strict=True)], False, epochs // 2)
    theta = _maximised(batches, line_labels(sequences, labels, alone[:width]), True, epochs)
    return Model(theta[:width], theta[width:].reshape(2, 2))


def _gradient(theta: np.ndarray, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Expected less seen features, all documents of a batch at once; ``y`` is a label a line."""
    width = x.shape[2]
    docs, steps, _ = x.shape
    potential = np.stack([np.zeros((docs, steps)), x @ theta[:width]], axis=2)
    pair = theta[width:].reshape(2, 2)
    forward = np.zeros((docs, steps, 2))
    backward = np.zeros((docs, steps, 2))
    forward[:, 0] = potential[:, 0]
    join = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    for t in range(1, steps):
        step = join(np.swapaxes(forward[:, t - 1, :, None] + pair, 1, 2)) + potential[:, t]
        forward[:, t] = np.where(mask[:, t, None] > 0, step, forward[:, t - 1])
    for t in range(steps - 2, -1, -1):
        step = join(pair[None] + (potential[:, t + 1] + backward[:, t + 1])[:, None, :])
        backward[:, t] = np.where(mask[:, t + 1, None] > 0, step, backward[:, t + 1])
    total = join(forward[:, -1])
    good = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * mask
    slope = np.zeros(width + 4)
    slope[:width] = np.einsum("dt,dtw->w", good - y * mask, x)
    both = np.exp(forward[:, :-1, :, None] + pair + (potential + backward)[:, 1:, None, :] - total[:, None, None, None])
    expected = (both * mask[:, 1:, None, None]).sum(axis=(0, 1))
    for a in (0, 1):
        for b in (0, 1):
            expected[a, b] -= ((y[:, :-1] == a) & (y[:, 1:] == b) & (mask[:, 1:] > 0)).sum()
    slope[width:] = expected.ravel()
    return slope


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """A model of ``labels`` (doc_id, quality) over the texts of ``docs``; the driver gets the sample's features only."""
    small_batches(docs.sparkSession)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = bounded_sample(known, ["doc_id"], fit_docs, "quality")
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("chosen_id"), "quality"))
    texts = docs.select(docs["doc_id"].alias("text_id"), docs["text"].alias("own_text"))
    sample = texts.join(chosen, F.col("text_id") == F.col("chosen_id")).select("chosen_id", "own_text", F.col("quality").cast("int"))

    def work(batch: pa.RecordBatch):
        rows = []
        for text in batch.column(1).to_pylist():
            rows.append(features(text)[0].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["doc_id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = map_batches(sample, work, f"doc_id {kind}, quality int, x binary").orderBy("doc_id", "x").collect()
    width = 3 * len(OWN) + 1
    return train([np.frombuffer(r["x"], np.float32).reshape(-1, width).astype(float) for r in found], [r["quality"] for r in found])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch):
        found = [shared.value.score(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())],
            names=["doc_id", "score", "predicted"],
        )

    return map_batches(docs.select(docs["doc_id"], docs["text"]), work, f"doc_id {kind}, score double, predicted int")

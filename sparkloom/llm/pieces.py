"""SentencePiece encoding and decoding of BPE models by a table of each prefix's last token.

Merging always the best pair of neighbours gives one encoding, and a sequence of tokens is that encoding just where every two
neighbours are compatible: encoded together, they come out as they are. So every prefix of a text has one last token: of the tokens that
end there (an automaton over the vocabulary finds them) the one that is compatible with the last token of the prefix before it. Left to
right the table is filled, and from its end the ids are recovered backwards. Work is linear in the text; no merge is ever carried out on it.

Two tokens are compatible unless a merge crosses their border before both are whole. What can cross are the parts that stand at the border while
each token grows, its ``spine``: these are walked from single characters up, the side that grows first next. Where ties of
score would matter, the left one goes first. A token whose parts score worse than itself doesn't grow in order of score; pairs with such a token are told by merging them.

Text is cut where no vocabulary entry reaches across (before a run of blanks, between characters that no entry joins), which changes nothing,
and a worker remembers the ids of recent pieces of text between cuts. The vocabulary, its merges included, is read by the
driver and broadcast; it doesn't grow with the documents.

Covered models: merge type (BPE) with byte fallback, identity normalisation, a blank put before the text, no user-defined entries; ``ValueError`` for others.

Defined cases: a null text is empty; the empty text has no ids and decodes to itself; characters that no entry holds become their UTF-8 bytes' ids;
bytes that aren't UTF-8 decode to U+FFFD one by one; repeated rows are coded one by one; very long texts and words are coded whole; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.common import map_batches, small_batches

BLANK = "▁"
#: Pieces of text whose ids a worker remembers, and as many before those, of which it keeps what comes again. Longer pieces aren't remembered.
CACHE_PIECES = 250_000
CACHE_CHARS = 48
#: Compatible pairs that a worker remembers, likewise.
CACHE_PAIRS = 1_000_000
NEVER = float("inf")
# Kinds of entries in the model's file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
BPE = 2

codecs.register_error("sparkloom_one_by_one", lambda bad: ("�", bad.start + 1))


class Vocabulary:
    """What a model's file says: entries with their kinds and ranks (0: merged first), and how each comes from two parts."""

    def __init__(self, entries: list[tuple[str, float, int]]):
        self.entries = [e[0] for e in entries]
        self.kinds = [e[2] for e in entries]
        places = {score: i for i, score in enumerate(sorted({e[1] for e in entries}, reverse=True))}
        self.ranks = {text: places[score] for text, score, kind in entries if kind == NORMAL}
        self.parts = {text: self._parts(text) for text in self.ranks if len(text) > 1}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = {p.type for p in model.pieces}
        trained, normal = model.trainer_spec, model.normalizer_spec
        plain = normal.name == "identity" and normal.add_dummy_prefix and not normal.remove_extra_whitespaces and normal.escape_whitespaces
        if trained.model_type != BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix or not plain or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("not a merge-type model with byte fallback and identity normalisation")
        return cls([(p.piece, p.score, p.type) for p in model.pieces])

    def merged(self, text: str) -> list[str]:
        """``text`` merged pair by pair, best first, leftmost of equals: the definition, for entries and odd pairs."""
        found = list(text)
        while len(found) > 1:
            ranks = [self.ranks.get(a + b, NEVER) for a, b in zip(found, found[1:], strict=False)]
            at = ranks.index(best := min(ranks))
            if best == NEVER:
                break
            found[at : at + 2] = [found[at] + found[at + 1]]
        return found

    def _parts(self, text: str) -> tuple[str, str] | None:
        """The two parts whose merge makes an entry; None if merging its characters ends elsewhere."""
        found = list(text)
        while len(found) > 2:
            ranks = [self.ranks.get(a + b, NEVER) for a, b in zip(found, found[1:], strict=False)]
            at = ranks.index(best := min(ranks))
            if best == NEVER:
                return None
            found[at : at + 2] = [found[at] + found[at + 1]]
        return (found[0], found[1])


class Coder:
    """Encoder and decoder of one process."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, ranks = vocabulary, vocabulary.ranks
        self.ids = {text: i for i, (text, kind) in enumerate(zip(vocabulary.entries, vocabulary.kinds, strict=True)) if kind == NORMAL}
        self.byte_ids = {int(text[3:-1], 16): i for i, (text, kind) in enumerate(zip(vocabulary.entries, vocabulary.kinds, strict=True)) if kind == BYTE}
        self.strings = [self._decoded(text, kind) for text, kind in zip(vocabulary.entries, vocabulary.kinds, strict=True)]
        self.silent = {i for i, kind in enumerate(vocabulary.kinds) if kind == CONTROL}
        self.digits = [str(i) for i in range(len(vocabulary.entries))]
        self.left: dict[str, tuple] = {}
        self.right: dict[str, tuple] = {}
        self.odd: set[str] = set()
        self.automaton = ahocorasick.Automaton()
        for text in sorted(ranks, key=len):
            if len(text) == 1:
                self.automaton.add_word(text, (text, len(text)))
                continue
            parts = vocabulary.parts[text]
            if parts is None:
                continue
            a, b = parts
            self.left[text] = (*self._spine(self.left, a)[:-1], (a, ranks[text]), (text, NEVER))
            self.right[text] = (*self._spine(self.right, b)[:-1], (b, ranks[text]), (text, NEVER))
            if any(len(x) > 1 and (ranks[x] > ranks[text] or x in self.odd) for x in parts):
                self.odd.add(text)
            self.automaton.add_word(text, (text, len(text)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.earlier: dict[str, list[int]] = {}
        self.cuts = self._cuts()

    @staticmethod
    def _decoded(text: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(text[3:-1], 16)])
        return {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, text.replace(BLANK, " ").encode())

    @staticmethod
    def _spine(spines: dict[str, tuple], token: str) -> tuple:
        """((part, rank of the merge that takes it up), ...) of what stands at a token's border, from a character to the token."""
        return spines.get(token) or ((token, NEVER),)

    def _cuts(self) -> re.Pattern:
        """Runs of characters that entries join directly or through others, after blanks where these are joined to what follows only.

        Characters side by side in some entry are of one group; no entry reaches from one group into another."""
        longer = [t for t in self.vocabulary.ranks if len(t) > 1]
        if any(b == BLANK != a for t in longer for a, b in zip(t, t[1:], strict=False)):
            inside = "".join(map(re.escape, sorted({BLANK}.union(*longer))))
            return re.compile(f"[{inside}]+|[^{inside}]")
        group: dict[str, set[str]] = {}
        for a, b in {(a, b) for t in longer for a, b in zip(t, t[1:], strict=False)}:
            if b == BLANK:
                continue
            joined = group.setdefault(b, {b})
            if a != BLANK and (other := group.setdefault(a, {a})) is not joined:
                joined, other = sorted((joined, other), key=len, reverse=True)
                joined |= other
                group.update(dict.fromkeys(other, joined))
        groups = sorted({id(x): x for x in group.values()}.values(), key=lambda x: (-len(x), min(x)))
        runs = [f"{BLANK}*[{''.join(map(re.escape, sorted(x)))}]+" for x in groups]
        return re.compile("|".join([*runs, f"{BLANK}+", f"[^{BLANK}]"]))

    def compatible(self, first: str, second: str) -> bool:
        """Whether both stay as they are when encoded together; remembered."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[first, second] = fits = self._compatible(first, second)
        return fits

    def _compatible(self, first: str, second: str) -> bool:
        if first in self.odd or second in self.odd:
            return self.vocabulary.merged(first + second) == [first, second]
        ranks, own, other = self.vocabulary.ranks, self._spine(self.right, first), self._spine(self.left, second)
        i = j = 0
        while True:
            (x, taken_x), (y, taken_y) = own[i], other[j]
            crossing = ranks.get(x + y, NEVER)
            if crossing < taken_x and crossing <= taken_y and crossing != NEVER:
                return False
            if taken_x == taken_y == NEVER:
                return True
            if taken_x <= taken_y:
                i += 1
            else:
                j += 1

    def tokens(self, text: str) -> list[str]:
        """The encoding of a text between cuts: entries, and characters that are none, which stand alone."""
        last: list[str | None] = [None] * (len(text) + 1)
        known = self.pairs.get
        for end, (match, length) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                before = end - length
                if before:
                    pair = (last[before] or text[before - 1], match)
                    if not (self.compatible(*pair) if (fits := known(pair)) is None else fits):
                        continue
                last[end] = match
        at, back = len(text), []
        while at:
            token = last[at] or text[at - 1]
            back.append(token)
            at -= len(token)
        return back[::-1]

    def _ids(self, text: str) -> list[int]:
        found: list[int] = []
        for token in self.tokens(text):
            own = self.ids.get(token)
            found += [self.byte_ids[b] for b in token.encode()] if own is None else (own,)
        return found

    def encode(self, text: str | None) -> list[int]:
        """Ids without those of begin and end."""
        found: list[int] = []
        if not text:
            return found
        for piece in self.cuts.findall(BLANK + text.replace(" ", BLANK)):
            found += self.pieces.get(piece) or self._remembered(piece)
        return found

    def _remembered(self, piece: str) -> list[int]:
        """Ids of a piece that isn't among the recent ones: from those before them, or worked out."""
        ids = self.earlier.get(piece) or self._ids(piece)
        if len(self.pieces) >= CACHE_PIECES:
            self.earlier, self.pieces = self.pieces, {}
        if len(piece) <= CACHE_CHARS:
            self.pieces[piece] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids; an id that stands for no text ends a run of bytes."""
        runs = [ids]
        if not self.silent.isdisjoint(ids):
            runs = [list(run) for _, run in itertools.groupby(ids, self.silent.__contains__)]
        first = next((i for i in ids if i not in self.silent), None)
        text = "".join(b"".join(map(self.strings.__getitem__, run)).decode("utf-8", "sparkloom_one_by_one") for run in runs)
        led = first is not None and self.vocabulary.entries[first].startswith(BLANK)
        return text[1:] if led else text  # the blank that encoding puts before a text


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    """The process's coder of a broadcast vocabulary; workers serve many batches."""
    number = id(shared.value)
    if number not in _coders:
        _coders.clear()
        _coders[number] = Coder(shared.value)
    return _coders[number]


def _shared(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of each row of ``docs`` (doc_id, text); ``path`` is the model's file, which only the driver reads."""
    small_batches(docs.sparkSession)
    shared, kind = _shared(docs, path), docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch):
        coder = _coder(shared)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.encode(x) for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_batches(docs.select(docs["doc_id"], docs["text"]), work, f"doc_id {kind}, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of each row of ``coded`` (doc_id, ids); null ids decode to the empty text."""
    small_batches(coded.sparkSession)
    shared, kind = _shared(coded, path), coded.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch):
        coder = _coder(shared)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_batches(coded.select(coded["doc_id"], coded["ids"]), work, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded again."""
    small_batches(docs.sparkSession)
    shared, kind = _shared(docs, path), docs.schema["doc_id"].dataType.simpleString()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def work(batch: pa.RecordBatch):
        coder = _coder(shared)
        counts, coded, decoded = [], [], []
        for text in batch.column(1).to_pylist():
            ids = coder.encode(text)
            counts.append(len(ids))
            coded.append(sha(",".join(map(coder.digits.__getitem__, ids))))
            decoded.append(sha(coder.decode(ids)))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(docs["doc_id"], docs["text"]), work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Merge-type pieces against the library itself."""

import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import pieces, queries
from sparkloom.llm.common import table

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(pieces.Vocabulary.read(PATH))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    own, theirs = test_any_text.coder, test_any_text.library
    ids = own.encode(text)
    assert ids == theirs.encode(text)
    assert own.decode(ids) == theirs.decode(ids)


test_any_text.coder = pieces.Coder(pieces.Vocabulary.read(PATH))
test_any_text.library = sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_joined_entries_and_runs(coder, library):
    draw = random.Random(3)
    entries = list(coder.vocabulary.ranks)
    for _ in range(3_000):
        text = "".join(draw.choice(entries) for _ in range(draw.randint(1, 7)))
        assert coder.encode(text) == library.encode(text)
    for text in ("", " ", "   ", "\n", "a" * 500, " " * 301, "=" * 77, "<s></s><0x0A>", "▁a ▁", "a\x00b", "日本語" * 50, "😀 é́"):
        assert coder.encode(text) == library.encode(text), text
        assert coder.decode(coder.encode(text)) == library.decode(library.encode(text))


def test_any_ids(coder, library):
    draw = random.Random(4)
    for _ in range(3_000):
        ids = [draw.randrange(300 if draw.random() < 0.5 else 32_000) for _ in range(draw.randint(0, 9))]
        assert coder.decode(ids) == library.decode(ids), ids


def test_pairs_by_spines_and_by_merging(coder):
    draw = random.Random(5)
    entries = [t for t, parts in coder.vocabulary.parts.items() if parts is not None]
    for _ in range(5_000):
        a, b = draw.choice(entries), draw.choice(entries)
        assert coder._compatible(a, b) == (coder.vocabulary.merged(a + b) == [a, b])


def small(scores):
    entries = [("<unk>", 0.0, pieces.UNKNOWN)] + [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)]
    return pieces.Vocabulary(entries + [(text, score, pieces.NORMAL) for text, score in scores])


def test_ties_and_parts_that_score_worse():
    """Equal scores go left to right, and an entry whose part scores worse than itself is told by merging."""
    draw = random.Random(6)
    for seed in range(40):
        chars = "ab▁"
        longer = sorted({"".join(draw.choice(chars) for _ in range(draw.randint(2, 4))) for _ in range(9)})
        known = small([(c, -100.0) for c in chars] + [(t, -float(draw.randint(1, 4))) for t in longer])
        own = pieces.Coder(known)
        for _ in range(60):
            text = "".join(draw.choice(chars) for _ in range(draw.randint(1, 9)))
            assert own.tokens(text) == known.merged(text), (seed, text, longer)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.byte_fallback = False
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Vocabulary.read(str(tmp_path / "other.model"))


def test_query_against_library(spark, sf_dir, library):
    found = {r["doc_id"]: r for r in queries.op13_pieces(spark, sf_dir).collect()}
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for doc_id, text in rows:
        ids = library.encode(text or "")
        assert found[doc_id]["n_tokens"] == len(ids)
        assert found[doc_id]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[doc_id]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows_and_tables(spark, odd_docs, no_docs, library):
    coded = pieces.encode(odd_docs, PATH)
    rows = odd_docs.select("doc_id", "text").collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in coded.collect()) == sorted((str(r["doc_id"]), library.encode(r["text"] or "")) for r in rows)
    texts = pieces.decode(coded, PATH).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in texts) == sorted((str(r["doc_id"]), r["text"] or "") for r in rows)
    assert pieces.digests(odd_docs, PATH).count() == len(rows)
    assert pieces.digests(no_docs, PATH).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).collect()[0]["text"] == ""

"""Language ID, licenses, media and quality against plain versions, round trips and held-out labels."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import langid, licenses, media, quality, queries
from sparkloom.llm.common import table


def test_langid_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = queries.op1_langid(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = found.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right / n > 0.97
    assert found.where("score < 0 OR score > 1").count() == 0


def test_langid_odd_rows(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    found = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd_docs, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= found
    assert langid.predict(odd_docs, model).count() == 11
    none = langid.fit(no_docs)
    assert {r["lang_pred"] for r in langid.predict(odd_docs, none).collect()} == {"und"}
    assert langid.predict(no_docs, model).count() == 0
    kept = langid.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({2, 3, 4})


def test_langid_backs_off_to_shorter_grams():
    model = langid.Model(["aa", "bb"], [0.5, 0.5], {"known": [9, 1], "other": [1, 9]}, {"xyz": [1, 9], "abc": [9, 1], "q": [9, 1], "r": [1, 9]})
    assert model.predict("known", {})[0] == "aa"
    assert model.predict("wxyzw", {})[0] == "bb"
    assert model.predict("qqq", {})[0] == "aa"
    assert model.predict("123 !", {}) == ("und", 0.0)


@pytest.mark.parametrize(
    ("markup", "text", "accepted"),
    [
        ("a b c", "x a b c y", [(1, 4)]),
        ("a [[b]] c", "a c a b c", [(0, 2), (2, 5)]),
        ("a {{2}} c", "a c a x c a x y c a x y z c", [(0, 2), (2, 5), (5, 9)]),
        ("a [[b [[d]]]] c", "a b d c a d c a b c", [(0, 4), (7, 10)]),
        ("a b", "a x b", []),
        ("a a b", "a a a b", [(1, 4)]),
    ],
)
def test_template_automata(markup, text, accepted):
    assert licenses.compile_template("t", markup).scan(licenses.words_of(text.encode())) == accepted


def test_template_errors():
    for markup in ("[[a", "a ]]", "[[a]] {{3}}"):
        with pytest.raises(ValueError):
            licenses.compile_template("t", markup)


def test_licenses_against_plain_search(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    for row in queries.op7_licenses(spark, sf_dir).collect():
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), docs[row["doc_id"]] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert row["n_words"] == len(words) and row["n_base"] == len(places)
        assert row["first_word"] == min((p for p, _ in places), default=None)
        assert row["last_word"] == max((p for p, _ in places), default=None)
        assert row["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, row["base_labels"].split(","))) <= set(filter(None, row["labels"].split(",")))
        assert 0 <= row["score"] <= 1


def test_licenses_odd_rows(odd_docs, no_docs):
    rows = licenses.scan_licenses(odd_docs).collect()
    assert len(rows) == 11 and all(r["n_words"] == 0 and r["labels"] == "" for r in rows if r["doc_id"] in (2, 3, 4))
    assert licenses.scan_licenses(no_docs).count() == 0


def test_media_round_trip(spark, sf_dir, odd_docs, no_docs):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, sf_dir, "documents").collect()}
    for row in queries.op8_media(spark, sf_dir).collect():
        payload = docs[row["doc_id"]] + b" " * (-len(docs[row["doc_id"]]) % 192 or (0 if docs[row["doc_id"]] else 192))
        assert (row["n_bytes"], row["payload_bytes"]) == (len(docs[row["doc_id"]]), len(payload))
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(payload[-16:])
    assert media.media_features(media.text_media(odd_docs)).count() == 11
    assert media.text_media(no_docs).count() == 0


@pytest.mark.parametrize("encode", [media.encode_ppm, media.encode_bmp])
def test_image_formats_are_lossless(encode):
    payload = np.random.default_rng(1).integers(0, 256, 192 * 7, dtype=np.uint8).tobytes()
    assert media.decode(encode(payload)).tobytes() == payload


def test_netpbm_kinds_and_broken_images():
    assert media.decode(b"P2 # grey\n2 1\n255\n 7 9").tolist() == [[7, 9]]
    assert media.decode(b"P5 1 2 65535\n" + bytes([1, 0, 0, 2])).tolist() == [[256], [2]]
    for broken in (b"", b"P6\n64 9\n255\nabc", b"BMxx", b"P5\n0 1\n255\n", b"GIF89a"):
        with pytest.raises(ValueError):
            media.decode(broken)


def test_area_resize_is_the_exact_mean():
    image = np.random.default_rng(2).integers(0, 256, (13, 10))
    fine = np.kron(image, np.ones((4, 3)))  # 52 x 30 has whole cells for 4 x 3
    assert np.allclose(media.area_resize(image, 4, 3), fine.reshape(4, 13, 3, 10).mean(axis=(1, 3)))
    old, media.STRIP = media.STRIP, 5
    try:
        assert np.allclose(media.area_resize(image, 4, 3), fine.reshape(4, 13, 3, 10).mean(axis=(1, 3)))
    finally:
        media.STRIP = old


def test_media_tiles(spark):
    frame = spark.createDataFrame([(1, media.encode_ppm(bytes(range(192)))), (2, b"nothing"), (3, None)], "k long, image binary")
    rows = {r["key"]: r for r in media.media_tiles(frame, "k", "image").collect()}
    assert rows[1]["width"] == 64 and len(rows[1]["dhash"]) == 16 and rows[1]["tile"].startswith(b"\x93NUMPY")
    assert rows[2]["tile"] is None and rows[3]["dhash"] is None


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    found = queries.op10_quality(spark, sf).join(labels, "doc_id").where("held_out")
    right, n = found.select(F.sum((F.col("quality") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert right / n > 0.93


def test_quality_odd_rows(spark, odd_docs, no_docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(odd_docs, quality.fit(odd_docs, empty)).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 0, 0), (9, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.score(odd_docs, quality.fit(odd_docs, labels)).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(no_docs, quality.Model()).count() == 0


def test_marginals_match_enumeration():
    rng = np.random.default_rng(4)
    scores, transition = rng.normal(size=5), rng.normal(size=(2, 2))
    weight = np.zeros((5, 2))
    for code in range(32):
        labels = [(code >> i) & 1 for i in range(5)]
        w = np.exp(sum(scores[i] * labels[i] for i in range(5)) + sum(transition[a, b] for a, b in zip(labels, labels[1:], strict=False)))
        for i, label in enumerate(labels):
            weight[i, label] += w
    assert np.allclose(quality.marginals(scores, transition), weight[:, 1] / weight.sum(axis=1))


def test_gradient_matches_differences():
    rng = np.random.default_rng(5)
    x, mask, y = rng.normal(size=(3, 4, 2)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0.0]]), np.array([[1.0, 0, 0, 1], [0, 1, 0, 0], [1, 0, 0, 0]])
    x *= mask[:, :, None]
    theta = rng.normal(size=6)

    def loss(t):
        total = 0.0
        for d in range(3):
            n = int(mask[d].sum())
            s, pair = x[d, :n] @ t[:2], t[2:].reshape(2, 2)
            value = lambda labels: sum(s[i] * labels[i] for i in range(n)) + sum(pair[a, b] for a, b in zip(labels, labels[1:], strict=False))  # noqa: E731,B023
            total += np.log(sum(np.exp(value([(c >> i) & 1 for i in range(n)])) for c in range(2**n))) - value([int(v) for v in y[d, :n]])
        return total

    step = np.eye(6) * 1e-6
    assert np.allclose(quality._gradient(theta, x, mask, y), [(loss(theta + e) - loss(theta - e)) / 2e-6 for e in step], atol=1e-4)

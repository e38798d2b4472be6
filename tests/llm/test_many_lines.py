"""Documents of very many lines, and odd rows whose results are told and not only counted."""

import corpus_pipeline
from sparkloom.llm import licenses, lines, media, packing, quality


def test_one_document_of_very_many_lines(spark):
    text = "\n".join(f"line {i % 4_000} of a long document that goes on and on {i % 4_000 * 7919}" for i in range(12_000))
    frame = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in lines.dedup_lines(frame).collect()}
    assert found[1]["line_dedup"]["n_lines"] == 12_000 and found[1]["line_dedup"]["n_removed"] >= 8_000
    assert found[2]["text"] == "" and found[2]["line_dedup"]["n_removed"] == 12_000
    score = quality.score(frame, quality.Model()).collect()
    assert {r["score"] for r in score} == {0.5}


def test_odd_rows_have_told_results(spark, odd_docs):
    found = {(r["doc_id"], r["n_words"], r["labels"], r["score"]) for r in licenses.scan_licenses(odd_docs).collect()}
    assert {(2, 0, "", 0.0), (3, 0, "", 0.0), (4, 0, "", 0.0), (9, 1, "", 0.0)} <= found
    found = {r["doc_id"]: r for r in media.media_features(media.text_media(odd_docs)).collect()}
    assert found[2]["n_bytes"] == 0 and found[2]["payload_bytes"] == 192 and found[2]["payload_sha256"] == found[3]["payload_sha256"]
    packed = [r for r in packing.pack(odd_docs).collect() if r["doc_id"] in (2, 3, 4)]
    assert len(packed) == 3 and {r["n_words"] for r in packed} == {0}
    scores = {r["doc_id"]: r["score"] for r in quality.score(odd_docs, quality.Model()).collect()}
    assert set(scores.values()) == {0.5} and len(scores) == 10


def test_pipeline_stages_tell_odd_rows(spark, odd_docs):
    stages = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"] for r in stages["identify_language"](spark, odd_docs, "").collect()}
    assert kept.isdisjoint({2, 3, 4})
    cut = {r["doc_id"]: r["text"] for r in stages["dedup_lines"](spark, odd_docs, "").collect()}
    assert 1 in cut and 6 not in cut and cut[2] is None and cut[3] == "" and None in cut
    near = {r["doc_id"] for r in stages["dedup_near"](spark, odd_docs, "").collect()}
    assert 1 in near and not near & {6, 7} and {2, 3, 4, 8, 9, None} <= near
    mixed = {r["doc_id"] for r in stages["mix_sources"](spark, odd_docs, "").collect()}
    assert {2, 3, 4} <= mixed

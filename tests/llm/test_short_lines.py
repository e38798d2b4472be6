"""Short lines: equal ones go whatever their length, near ones only from the least length on."""

import corpus_pipeline
from sparkloom.llm import lines, queries

DOCS = {1: "Read more\n\nShare\nthe first line of this page", 2: " Share\r\nRead mode\n\nx", 3: "x\nthe first lime of this page\nRead more", 4: "Share"}
KEPT = {1: DOCS[1], 2: "Read mode\n\nx", 3: "", 4: ""}


def test_short_repeats_go(spark, tmp_path):
    frame = spark.createDataFrame(list(DOCS.items()), "doc_id long, text string")
    found = {r["doc_id"]: r for r in lines.dedup_lines(frame, least_exact=lines.EXACT_CHARS).collect()}
    assert {d: r["text"] for d, r in found.items()} == KEPT
    assert {d: r["line_dedup"]["n_removed"] for d, r in found.items()} == {1: 0, 2: 1, 3: 3, 4: 1}
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_removed"] for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 3, 4: 1}


def test_short_repeats_go_in_the_pipeline(spark):
    frame = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in DOCS.items()], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.dedup_lines(spark, frame, "").collect()}
    assert found == {d: (t, len(t)) for d, t in KEPT.items() if t}

"""Stage one rejects texts in no learned language, gibberish and unseen scripts, and keeps what it has learned."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import langid
from sparkloom.llm.common import table


def test_only_learned_languages_are_identified(spark, sf_dir):
    rng = random.Random(5)
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))  # nobody teaches French
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 10)))
    strange = [" ".join(word(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрст") for n in (1, 5, 60, 800)]
    odd = spark.createDataFrame([(10**6 + i, text, None, "a", len(text)) for i, text in enumerate(strange)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.union(odd), sf_dir).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.where("lang IS NOT NULL").select("doc_id").collect()}


def test_evidence_of_a_text_leaves_out_what_it_taught():
    model = langid.Model(["aa", "bb"], [0.5, 0.5], {"mine": [2, 0], "ours": [3, 0], "theirs": [0, 4]}, {"^min": [2, 0], "mine": [2, 0], "ine$": [2, 0], "^ne$": [0, 1]})
    assert model.evidence("mine ours", "aa", {}) == 1
    assert model.evidence("mine mine ours ours", "aa", {}, "aa") == 0.5
    assert model.evidence("theirs ne", "aa", {}) == 0 and model.evidence("theirs ne", "bb", {}) == 1
    assert not model.identified("Ωμέγα", 0.5, {}, {}) and model.identified("ours", 0.5, {}, {})

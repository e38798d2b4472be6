"""Scalar functions on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import fixed, scalars


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "base", "version"),
    [
        ("http://arxiv.org/abs/2101.00001v3", "2101.00001", 3),
        ("arXiv:hep-th/9901001", "hep-th/9901001", 1),
        (" 1234.5678 ", "1234.5678", 1),
        ("nonsense", None, None),
    ],
)
def test_paper_id(spark, raw, base, version):
    assert one(spark, scalars.paper_id(F.col("a")), a=raw) == base
    assert one(spark, scalars.paper_version(F.col("a")), a=raw) == version


def test_versions(spark):
    assert one(spark, scalars.strip_version(F.col("a")), a="arXiv:2101.00001v12") == "2101.00001"
    assert [one(spark, scalars.version_number(F.col("a")), a=x) for x in ("v3", "7", "x")] == [3, 7, None]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("Mon, 2 Apr 2007 19:18:42 GMT", datetime.datetime(2007, 4, 2, 19, 18, 42)),
        ("2007-04-02T19:18:42Z", datetime.datetime(2007, 4, 2, 19, 18, 42)),
        ("2007-04-02 19:18:42", datetime.datetime(2007, 4, 2, 19, 18, 42)),
        ("never", None),
    ],
)
def test_parse_timestamp(spark, raw, expected):
    found = one(spark, scalars.parse_timestamp(F.col("a")).cast("timestamp_ntz"), a=raw)
    assert found == expected


def test_hashes_ignore_order_and_case(spark):
    own = scalars.content_hash(F.col("t"), F.col("a"), F.col("c"))
    assert one(spark, own, t="T ", a="A", c=["x.Y", "b"]) == one(spark, own, t="t", a=" a", c=["B", "X.y"])
    assert one(spark, scalars.author_uid(F.col("a")), a="Ann  Lee") == one(spark, scalars.author_uid(F.col("a")), a=" ann lee ")
    assert one(spark, scalars.payload_hash(F.col("a")), a='{"b":1,"a":2}') == one(spark, scalars.payload_hash(F.col("a")), a='{"a": 2, "b": 1}')


def test_lists(spark):
    assert one(spark, scalars.string_list(F.col("a")), a='["x ", "", "y"]') == ["x", "y"]
    assert one(spark, scalars.string_list(F.col("a")), a="x, y,,z") == ["x", "y", "z"]
    assert one(spark, scalars.category_tokens(F.col("a")), a="['cs.LG' 'CS.lg' 'stat.ML' junk math]") == ["cs.LG", "stat.ML", "math"]


def test_topics(spark):
    frame = spark.createDataFrame([("cs.LG",), ("math.CO",), ("hep-xy",), ("physics.bio-ph",), ("physics.x",), ("foo",)], "c string")
    assert [r[0] for r in frame.select(scalars.topic_key(F.col("c"))).collect()] == ["ai-ml", "math-stats", "space-high-energy", "bio-complex", "physics-quantum", "other"]
    assert one(spark, scalars.topic_keys(F.col("a")), a=["foo.x", "cs.CV", "cs.LG"]) == ["ai-ml", "vision-language", "other"]
    assert one(spark, scalars.has_category(F.col("a"), ["cs"]), a=["cs.CV"]) and not one(spark, scalars.has_category(F.col("a"), ["c"]), a=["cs.CV"])
    assert one(spark, scalars.has_category(F.col("a"), []), a=["x"]) and not one(spark, scalars.has_category(F.col("a"), [], empty=False), a=["x"])
    assert one(spark, scalars.in_topic(F.col("a"), ["AI-ML "]), a=["cs.lg"]) and not one(spark, scalars.in_topic(F.col("a"), [" "]), a=["cs.lg"])


def test_citations(spark):
    key = scalars.cite_key(F.col("a"), F.col("p"), F.col("t"))
    assert one(spark, key, a=["Ada B. Lovelace"], p="1843-01-01", t="On $x$ \\emph An engine") == "lovelace1843engine"
    assert one(spark, scalars.bib_note(F.col("a")), a="a } b { 5%") == "a b 5\\%"
    assert one(spark, scalars.bib_note(F.col("a")), a="a {b}  c") == "a {b} c"
    names = [chr(65 + i) for i in range(9)]
    made = [one(spark, scalars.apa_authors(F.array(*[F.lit(x) for x in names[:n]]) if n else F.array().cast("array<string>"))) for n in (0, 1, 2, 3, 9)]
    assert made == ["Unknown", "A", "A & B", "A, B, & C", "A, B, C, D, E, F, ... I"]
    assert one(spark, scalars.short_authors(F.col("a")), a=names) == "A, B, C +6"
    text = scalars.bibtex(F.lit("k"), F.lit("T & U"), F.array(F.lit("A"), F.lit("B")), F.lit("2020"), F.lit("1"), F.lit(None).cast("string"), F.lit(""), F.lit("J"), F.lit("n"), F.lit("u"))
    assert one(spark, text).split("\n") == ["@misc{k,", "  title = {T \\& U},", "  author = {A and B},", "  year = {2020},", "  eprint = {1},", "  archivePrefix = {arXiv},", "  note = {J},", "  annote = {n},", "  url = {u},", "}"]


def test_text_shape(spark):
    assert one(spark, scalars.math_segments(F.col("a")), a="a $x$ b $$y z$$") == ["$x$", "$$y z$$"]
    assert one(spark, scalars.tokens(F.col("a")), a="The Model of large-scale GPUs is AI") == ["large-scale", "gpus"]
    assert one(spark, scalars.term_count(F.col("a"), fixed.CLAIM_TERMS), a="We propose a novel, NOVEL dataset") == 4
    assert one(spark, scalars.xml_escape(F.col("a")), a="<a & 'b'>") == "&lt;a &amp; &apos;b&apos;&gt;"
    assert one(spark, scalars.has_named_system(F.col("a")), a="BERT: a thing")
    index = F.create_map(F.lit("world"), F.array(F.lit(1)), F.lit("hello"), F.array(F.lit(0), F.lit(2)))
    assert one(spark, scalars.invert_index(index)) == "hello world hello"


def test_numbers(spark):
    assert len(fixed.CALIBRATION) == 41
    grid = [one(spark, scalars.calibrate(F.lit(p))) for p in (-1.0, 0.1, 0.3, 0.9875, 1.0, 2.0)]
    assert grid == pytest.approx([0, 0, 0.001556, (0.079545 + 0.111111) / 2, 0.111111, 0.111111])
    assert [one(spark, scalars.compact_count(F.lit(n))) for n in (999, 1234, 12345, 4_500_000)] == ["999", "1.2k", "12k", "4.5M"]
    assert one(spark, scalars.year_ticks(F.lit(2000), F.lit(2013))) == [2000, 2002, 2004, 2006, 2008, 2010, 2012, 2013]
    assert tuple(one(spark, scalars.embedded_date(F.lit(9203001)))) == (1992, 3) and one(spark, scalars.embedded_date(F.lit(9213001))) is None
    moment = lambda s: F.lit(s).cast("timestamp")
    ages = [one(spark, scalars.relative_age(moment(m), moment("2024-02-01 12:00:00"))) for m in ("2024-02-01 11:30:00", "2024-02-01 09:00:00", "2024-01-29 12:00:00", "2023-12-01 00:00:00")]
    assert ages == ["just now", "3h ago", "3d ago", "2023-12-01"]


def test_counts_are_written_as_printf_writes_them(spark):
    numbers = [1_050, 1_150, 1_250, 1_750, 5_250, 8_350, 9_949, 9_950, 9_999, 3_150_000, 14_350_000, 17_150_000, 123_450_000, *range(1_000, 10_000, 7)]
    made = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", scalars.compact_count(F.col("n")).alias("label"), scalars.dashboard_count(-F.col("n")).alias("other")).collect()
    for r in made:
        n = r["n"]
        assert r["label"] == (f"{n / 1e6:.1f}M" if n >= 1e6 else f"{int(n / 1000 + 0.5)}k" if n >= 1e4 else f"{n / 1e3:.1f}k")
        size, unit = (n / 1e6, "M") if n >= 1e6 else (n / 1e3, "K")
        assert r["other"] == (f"-{size:.1f}{unit}" if size < 10 else f"-{size:.0f}{unit}")
    doubles = [0.0, 0.05, 0.15, 0.25, 0.35, 0.5, 1.5, 2.5, 0.95, 9.95, 1e13 + 0.25, 3e13 + 0.5, 1e15, *[k / 20 for k in range(1, 400)], *[k / 7 for k in range(100)]]
    told = spark.createDataFrame([(x,) for x in doubles], "x double").select("x", scalars.printed(F.col("x"), 1).alias("one"), scalars.printed(F.col("x"), 0).alias("none")).collect()
    assert [(r["one"], r["none"]) for r in told] == [(f"{r['x']:.1f}", f"{r['x']:.0f}") for r in told]


def test_tokens_are_told_without_a_walk_over_stop_words(spark):
    made = spark.createDataFrame([("The a1 ab abc 9ab-c of THESE x--- ab 1ab", ), (None,), ("",)], "a string").select(scalars.tokens(F.col("a")).alias("t"))
    assert [r["t"] for r in made.collect()] == [["abc", "ab-c", "x---"], None, []]
    assert "array_contains" not in made._jdf.queryExecution().optimizedPlan().toString()

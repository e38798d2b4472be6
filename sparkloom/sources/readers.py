"""Readers that tolerate what metadata dumps look like; only Spark's readers touch paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import scalars
from sparkloom.operators.tables import last_by

#: A string of a Python repr with its quotes.
_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""

ATOM_ENTRY = "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, category array<struct<_term:string>>"


def tolerant_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns of ``schema`` in its order: absent ones null, others dropped; a missing path is an empty table."""
    wanted = T.StructType.fromDDL(schema)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], wanted)
    return spark.read.schema(wanted).parquet(path)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON objects a line, also as lines of one array; blanks, brackets and trailing commas are skipped. Gzip by suffix."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r",\s*$", "").alias("line")).where("line NOT IN ('', '[', ']')")
    return lines.select(F.from_json("line", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("r")).select("r.*")


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a text of two numbers a line, # for comments."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.get(parts, 0).try_cast("long").alias("src"), F.get(parts, 1).try_cast("long").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, citations, zscore) of tab-separated lines whose first field is an id."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(parts.alias("p"), "value").where(F.get("p", F.lit(0)).rlike(r"^\d{4}\.\d{4,5}$"))
    z = F.nullif(F.regexp_extract("value", r"zscore:\s*(-?\d+(?:\.\d+)?)", 1), F.lit(""))
    return rows.select(F.get("p", F.lit(0)).alias("id"), F.get("p", F.lit(1)).alias("title"), F.get("p", F.lit(2)).try_cast("int").alias("citations"), z.try_cast("double").alias("zscore"))


def python_strings(value: Column) -> Column:
    """Strings of a Python list's repr: each is quoted by either kind of quote and may hold the other, or its own behind a backslash."""
    quoted = F.regexp_extract_all(value, F.lit(_QUOTED), F.lit(0))
    inside = lambda x: F.substring(x, F.lit(2), F.char_length(x) - 2)
    return F.transform(quoted, lambda x: F.regexp_replace(inside(x), r"\\(.)", "$1"))


def atom_entries(feeds: DataFrame, column: str) -> DataFrame:
    """Papers of Atom feeds given as text; error entries go."""
    entry = F.regexp_extract_all(F.col(column), F.lit(r"(?s)<entry>.*?</entry>"), F.lit(0))
    parsed = feeds.select(F.explode(entry).alias("e")).select(F.from_xml("e", ATOM_ENTRY).alias("r")).where(~F.contains("r.id", F.lit("api/errors")))
    return parsed.select(
        F.col("r.id").alias("id"),
        F.trim(F.regexp_replace("r.title", r"\s+", " ")).alias("title"),
        F.trim(F.regexp_replace("r.summary", r"\s+", " ")).alias("abstract"),
        F.col("r.published").try_cast("timestamp").alias("published"),
        F.transform("r.author", lambda a: a["name"]).alias("authors"),
        F.transform("r.category", lambda c: c["_term"]).alias("categories"),
    )


def first_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """Union in order, where the first frame that has a key gives its row."""
    from functools import reduce

    from sparkloom.operators.tables import last_by

    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    return last_by(reduce(DataFrame.unionByName, tagged), [key], [F.col("_source")]).drop("_source")


def discovered(spark: SparkSession, root: str, preferred: tuple[str, ...], words: tuple[str, ...]) -> list[str]:
    """Files to read under ``root``: the first of ``preferred`` that is there, else all files, at any depth, whose name has every word, sorted."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in preferred:
        if system.exists(hadoop(f"{root}/{name}")):
            return [f"{root}/{name}"]
    if not system.exists(hadoop(root)):
        return []
    found, listing = [], system.listFiles(hadoop(root), True)
    while listing.hasNext():
        path = listing.next().getPath()
        if all(w in path.getName().lower() for w in words):
            found.append(path.toString())
    return sorted(found)


def snapshots(spark: SparkSession, folder: str, categories: list[str], paper: str) -> tuple[DataFrame, list[str]]:
    """(papers of the categories' JSON snapshots with their category, categories that have none or one that can't be read).

    One bad file takes only its own category away. ``paper`` is the DDL of a paper."""
    from sparkloom.operators.publishing import exists

    there = [c for c in categories if exists(spark, f"{folder}/{c}.json")]
    if not there:
        return spark.createDataFrame([], f"category string, {paper}"), list(categories)
    whole = spark.read.option("wholetext", "true").text([f"{folder}/{c}.json" for c in there])
    parsed = whole.select(F.from_json("value", f"category string, fetchedAt string, papers array<struct<{paper}>>", {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    good = parsed.where(F.col("papers").isNotNull() & F.col("category").isin(*there))
    read = {r[0] for r in good.select("category").distinct().collect()}
    return good.select("category", F.explode("papers").alias("p")).select("category", "p.*"), [c for c in categories if c not in read]


def with_fallback(spark: SparkSession, path: str, older: str, schema: str, renames: dict[str, str], defaults: dict[str, object]) -> DataFrame:
    """``path`` in the columns of ``schema``; where it isn't there, ``older`` with its columns renamed. Absent columns and nulls take ``defaults``."""
    from sparkloom.operators.publishing import exists

    wanted = T.StructType.fromDDL(schema)
    if exists(spark, path):
        found = spark.read.parquet(path)
    elif exists(spark, older):
        found = spark.read.parquet(older)
        found = found.withColumnsRenamed({a: b for a, b in renames.items() if a in found.columns and b not in found.columns})
    else:
        return spark.createDataFrame([], wanted)
    value = lambda f: F.coalesce(F.col(f.name).cast(f.dataType) if f.name in found.columns else F.lit(None).cast(f.dataType), F.lit(defaults.get(f.name)).cast(f.dataType))
    return found.select(*[value(f).alias(f.name) for f in wanted])


def synthetic_points(spark: SparkSession, size: int = 3_000, clusters: int = 5, seed: int = 42) -> DataFrame:
    """Stand-in map points where nothing is published: normal clusters around a circle, the same for a seed."""
    n = spark.range(size)
    cluster = (F.col("id") % clusters).cast("int")
    angle = 2 * F.pi() * cluster / clusters
    return n.select(
        F.concat(F.lit("synthetic-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("doc_id"),
        cluster.alias("cluster"),
        (4 * F.cos(angle) + scalars.seeded_normal(F.concat(F.lit(f"{seed}-x-"), F.col("id").cast("string")))).alias("x"),
        (4 * F.sin(angle) + scalars.seeded_normal(F.concat(F.lit(f"{seed}-y-"), F.col("id").cast("string")))).alias("y"),
        (2015 + F.col("id") % 10).cast("int").alias("year"),
    )


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Papers of a JSON array whose authors and tags are reprs of Python lists, with the month's number ``t``.

    The version goes from the id, and of the rows of one id the first in the files' order stays; the first category is the primary one."""
    schema = "id string, title string, summary string, author string, tag string, year int, month int, day int"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    told = lambda c, field: F.flatten(F.transform(F.regexp_extract_all(c, F.lit(rf"'{field}':\s*(?:{_QUOTED})"), F.lit(0)), lambda x: F.slice(python_strings(x), 2, 1)))
    filled = lambda names: F.filter(names, lambda x: x != "")
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    categories = filled(told("tag", "term"))
    typed = rows.select(
        scalars.strip_version(F.col("id")).alias("id"),
        clean("title").alias("title"),
        clean("summary").alias("abstract"),
        filled(told("author", "name")).alias("authors"),
        categories.alias("categories"),
        F.coalesce(F.get(categories, F.lit(0)), F.lit("")).alias("primary"),
        "year",
        "month",
        "day",
        ((F.col("year") - 1992) * 12 + F.col("month") - 1).alias("t"),
        F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("_place"),
    )
    return last_by(typed.where("id IS NOT NULL"), ["id"], [F.col("_place")]).drop("_place")

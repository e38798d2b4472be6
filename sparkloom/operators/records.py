"""Records on their way in: validation, normalisation, fan-out into tables, resolution against other sources, filters of the views."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import scalars
from sparkloom.operators.tables import last_by

#: Most characters of a category token, and what one looks like.
TOKEN_CHARS = 32
TOKEN = r"^[A-Za-z][A-Za-z-]*(\.[A-Za-z-]+|\.\*)?$"


def parse_list(parameter: str | None) -> list[str]:
    """Entries of a comma-separated parameter, without blanks."""
    return [x for part in (parameter or "").split(",") if (x := part.strip())]


def parse_viewport(x_min: float | None, x_max: float | None, y_min: float | None, y_max: float | None) -> tuple[tuple, tuple] | None:
    """((x, x), (y, y)) if all four bounds are there, else none: half a viewport is no viewport."""
    bounds = (x_min, x_max, y_min, y_max)
    return None if any(b is None for b in bounds) else ((x_min, x_max), (y_min, y_max))


def in_window(rows: DataFrame, submitted: str, start: datetime, end: datetime, categories: str, tokens: list[str]) -> DataFrame:
    """Rows submitted from ``start`` to ``end``, both inclusive, in any of ``tokens``; a token without a dot stands for its whole archive."""
    moment = F.col(submitted).cast("timestamp")
    return rows.where(moment.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) & scalars.has_category(F.col(categories), tokens))


def first_version_year(versions: Column) -> Column:
    """Year in which the lowest version of an array of (version, created) was made."""
    return F.year(F.get(F.array_sort(F.transform(versions, lambda v: F.struct(v["version"].alias("v"), v["created"].alias("c")))), F.lit(0))["c"])


def first_published_between(rows: DataFrame, versions: str, first: int, last: int) -> DataFrame:
    """Rows whose first version is of the years ``first`` to ``last``, whichever comes first."""
    return rows.where(first_version_year(F.col(versions)).between(min(first, last), max(first, last)))


def missing_fields(rows: DataFrame, texts: tuple[str, ...] = ("id", "title", "abstract"), lists: tuple[str, ...] = ("categories", "versions")) -> DataFrame:
    """``rows`` with ``missing``: which required fields are null, blank or empty; an empty array if none."""
    marks = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in texts]
    marks += [F.when(F.coalesce(F.size(F.array_compact(c)), F.lit(0)) <= 0, F.lit(c)) for c in lists]
    return rows.withColumn("missing", F.array_compact(F.array(*marks)))


def accepted(rows: DataFrame, **fields) -> tuple[DataFrame, DataFrame]:
    """(rows with all required fields, the rest with what they lack)."""
    marked = missing_fields(rows, **fields)
    return marked.where(F.size("missing") == 0).drop("missing"), marked.where(F.size("missing") > 0)


def category_tokens(value: Column) -> Column:
    """Distinct valid tokens of a comma- or blank-separated text, in order."""
    tokens = F.transform(F.split(value, r"[,\s]+"), lambda t: F.trim(t))
    return F.array_distinct(F.filter(tokens, lambda t: (t != "") & (F.char_length(t) <= TOKEN_CHARS) & t.rlike(TOKEN)))


def split_categories(value: Column) -> Column:
    """Categories of a text that separates them by semicolons or commas; blanks go."""
    return F.filter(F.transform(F.split(F.translate(value, ";", ","), ","), lambda c: F.trim(c)), lambda c: c != "")


def recently_enriched(enriched: DataFrame, key: str, source: str, now: datetime, days: int = 7) -> DataFrame:
    """(key): papers that ``source`` has enriched in the last ``days`` days."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return enriched.where((F.col("source") == source) & (F.col("updated_at").cast("timestamp") >= since)).select(key).distinct()


def search_filters(field: str | None = None, author: str | None = None, source: str | None = None, text: str | None = None) -> Column:
    """All conditions that are given, as one: a field of study, an author's exact name, a source, a text in title or abstract."""
    conditions = [
        None if field is None else F.col("field") == field,
        None if not author else F.exists("authors", lambda a: F.lower(a) == author.strip().lower()),
        None if source is None else F.col("source") == source,
        None if not text else F.contains(F.lower("title"), F.lit(text.lower())) | F.contains(F.lower("abstract"), F.lit(text.lower())),
    ]
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def with_status(rows: DataFrame, status: str | None) -> DataFrame:
    """Rows of one status; all of them for none or ``all``."""
    return rows if status in (None, "all") else rows.where(F.col("status") == status)


def runs_of(runs: DataFrame, statuses: list[str], modes: list[str]) -> DataFrame:
    return runs.where(F.col("status").isin(*statuses) & F.col("mode").isin(*modes))


def focused(rows: DataFrame, primary: str, focus: str | None) -> DataFrame:
    """Rows whose primary category is the focus; all without one."""
    return rows if focus is None else rows.where(F.col(primary) == focus)


def in_scope(rows: DataFrame, categories: str, scope: list[str]) -> DataFrame:
    return rows.where(F.arrays_overlap(categories, F.array(*[F.lit(s) for s in scope])))


def normalised_entry(entries: DataFrame) -> DataFrame:
    """Feed entries (id, title, abstract, published, updated, authors, categories) as records of one version."""
    raw = F.col("id")
    return entries.select(
        scalars.paper_id(raw).alias("paper_id"),
        F.concat(scalars.paper_id(raw), F.lit("v"), scalars.paper_version(raw).cast("string")).alias("paper_version_id"),
        scalars.paper_version(raw).alias("version"),
        F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"),
        F.trim(F.regexp_replace("abstract", r"\s+", " ")).alias("abstract"),
        F.col("published").cast("timestamp").alias("submitted_at"),
        F.coalesce(F.col("updated").cast("timestamp"), F.col("published").cast("timestamp")).alias("updated_at"),
        F.array_distinct(F.filter(F.transform("authors", lambda a: F.trim(a)), lambda a: a != "")).alias("authors"),
        F.array_distinct("categories").alias("categories"),
        F.get("categories", F.lit(0)).alias("primary_category"),
    ).where("paper_id IS NOT NULL AND title <> ''")


def fan_out(records: DataFrame) -> dict[str, DataFrame]:
    """The seven tables that a batch of records (see ``normalised_entry``, with doi and raw) brings, each without repeats of its key."""
    newest = [F.col("updated_at").desc(), F.col("title")]
    one = last_by(records, ["paper_version_id"], newest)
    named = one.select("paper_version_id", F.posexplode("authors").alias("position", "name"))
    hashed = F.sha2(F.coalesce("raw", F.lit("")).cast("binary"), 256)
    return {
        "papers": one.groupBy("paper_id").agg(F.max("version").alias("latest_version"), F.max("updated_at").alias("updated_at")),
        "paper_versions": one.select("paper_id", "paper_version_id", "version", "title", "abstract", "submitted_at", "updated_at", scalars.content_hash(F.col("title"), F.col("abstract"), F.col("categories")).alias("content_hash")),
        "paper_categories": one.select("paper_id", F.explode("categories").alias("category"), "submitted_at").groupBy("paper_id", "category").agg(F.max("submitted_at").alias("latest_submitted_at")),
        "authors": named.select(scalars.author_uid(F.col("name")).alias("author_uid"), "name").groupBy("author_uid").agg(F.min("name").alias("name")),
        "authorships": named.select("paper_version_id", scalars.author_uid(F.col("name")).alias("author_uid"), "position").groupBy("paper_version_id", "author_uid").agg(F.max("position").alias("position")),
        "external_ids": one.where("doi IS NOT NULL").groupBy("paper_id").agg(F.max_by("doi", "version").alias("doi")),
        "raw_payloads": one.select("paper_id", hashed.alias("payload_hash"), "raw").dropDuplicates(["paper_id", "payload_hash"]),
    }


def new_payloads(archive: DataFrame, incoming: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Rows to append to an archive: (keys, payload_hash, payload) that it lacks, once each. Run twice, the second adds nothing."""
    hashed = incoming.select(*keys, F.sha2(F.col(payload).cast("binary"), 256).alias("payload_hash"), payload).dropDuplicates([*keys, "payload_hash"])
    return hashed.join(archive.select(*keys, "payload_hash").distinct(), [*keys, "payload_hash"], "left_anti")


def resolved_works(papers: DataFrame, works: DataFrame) -> DataFrame:
    """(paper_id, work_id, how): each paper's work by DOI, else the one of equal title whose own id is the paper's.

    Papers (paper_id, doi, title), works (work_id, doi, title, paper_id). Titles alone don't suffice; of several works the smallest id counts."""
    title = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    by_doi = works.where("doi IS NOT NULL").groupBy(scalars.doi(F.col("doi")).alias("_doi")).agg(F.min("work_id").alias("_by_doi"))
    by_title = works.where("paper_id IS NOT NULL").groupBy(title("title").alias("_title"), F.col("paper_id").alias("_paper")).agg(F.min("work_id").alias("_by_title"))
    keyed = papers.select("paper_id", scalars.doi(F.col("doi")).alias("_own_doi"), title("title").alias("_own_title"))
    joined = keyed.join(by_doi, F.col("_own_doi") == F.col("_doi"), "left").join(by_title, (F.col("_own_title") == F.col("_title")) & (F.col("paper_id") == F.col("_paper")), "left")
    how = F.when(F.col("_by_doi").isNotNull(), "doi").when(F.col("_by_title").isNotNull(), "title")
    return joined.select("paper_id", F.coalesce("_by_doi", "_by_title").alias("work_id"), how.alias("how"))


def marked_hits(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``is_hit``: whether ``known`` has the key."""
    found = known.select(F.col(key).alias("_known")).distinct()
    return rows.join(found, rows[key] == found["_known"], "left").withColumn("is_hit", F.col("_known").isNotNull().cast("int")).drop("_known")


def indexed_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, t_src, t_dst) of edges by ids, with ends replaced by the numbers of ``nodes`` (id, number, t); edges with an unknown end go."""
    a = nodes.select(F.col("id").alias("_a"), F.col("number").alias("src_number"), F.col("t").alias("t_src"))
    b = nodes.select(F.col("id").alias("_b"), F.col("number").alias("dst_number"), F.col("t").alias("t_dst"))
    joined = edges.select("src", "dst").join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b"))
    return joined.select(F.col("src_number").alias("src"), F.col("dst_number").alias("dst"), "t_src", "t_dst")


def with_papers(rows: DataFrame, papers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with columns of their papers, null where a paper is unknown."""
    return rows.join(papers.select(key, *columns), key, "left")


def category_lists(pairs: DataFrame, paper: str, category: str) -> DataFrame:
    """(paper, categories): each paper's distinct categories, sorted; a paper has few."""
    return pairs.groupBy(paper).agg(F.array_sort(F.collect_set(category)).alias("categories"))


def newest_unenriched(candidates: DataFrame, done: DataFrame, key: str, submitted: str, most: int) -> DataFrame:
    """Candidates that aren't done, newest first; at most ``most``, or all for 0."""
    rest = candidates.join(done.select(key).distinct(), key, "left_anti").orderBy(F.col(submitted).desc(), key)
    return rest.limit(most) if most else rest


def scan_limit(most: int, each: int = 40, least: int = 4_000) -> int:
    """How many recent rows to look through for ``most`` wanted ones."""
    return max(each * most, least)

"""Column functions over records of research papers: ids, dates, hashes, categories, citations, text shape.

All are built-in expressions, so they stay in whole-stage code generation and can be pushed down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import fixed

ID_PATTERN = r"([A-Za-z\-.]+/\d{7}|\d{4}\.\d{4,5})(?:v(\d+))?$"


def collapse(text: Column) -> Column:
    """Runs of blanks to one, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def paper_id(identifier: Column) -> Column:
    """Base id out of an URL, a prefixed or a versioned id; null if there is none."""
    tail = F.regexp_replace(F.regexp_replace(F.trim(identifier), r"^.*/abs/", ""), r"^(?i:arxiv:)", "")
    return F.nullif(F.regexp_extract(tail, ID_PATTERN, 1), F.lit(""))


def paper_version(identifier: Column) -> Column:
    """Version of an id, 1 where it has none; null if it is no id."""
    found = F.regexp_extract(F.trim(identifier), ID_PATTERN, 2)
    return F.when(paper_id(identifier).isNotNull(), F.coalesce(found.try_cast("int"), F.lit(1)))


def strip_version(identifier: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(identifier), r"^(?i:arxiv:)", ""), r"v\d+$", "")


def version_number(marker: Column) -> Column:
    """``v3`` or ``3`` as 3; null for anything else."""
    return F.regexp_replace(F.lower(F.trim(marker)), "^v", "").try_cast("int")


def parse_timestamp(value: Column) -> Column:
    """RFC 2822 or ISO 8601; without a zone it is UTC; null if neither."""
    bare = F.regexp_replace(F.trim(value), r"^[A-Za-z]{3},\s*", "")
    mail = F.try_to_timestamp(F.regexp_replace(bare, r"\s+(GMT|UTC|Z)$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    return F.coalesce(mail, F.trim(value).try_cast("timestamp"))


def content_hash(title: Column, abstract: Column, categories: Column) -> Column:
    """SHA-256 of what makes a version's content; order and case of categories don't count."""
    fold = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    joined = F.array_join(F.array_sort(F.transform(F.coalesce(categories, F.array().cast("array<string>")), fold)), "|")
    return F.sha2(F.concat_ws("||", fold(title), fold(abstract), joined), 256)


def author_uid(name: Column) -> Column:
    return F.concat(F.lit("name:"), F.substring(F.sha1(F.lower(collapse(name)).cast("binary")), 1, 24))


def payload_hash(payload: Column) -> Column:
    """SHA-256 of a JSON text with its keys sorted (a variant keeps them so)."""
    return F.sha2(F.to_json(F.parse_json(payload)), 256)


def string_list(value: Column) -> Column:
    """A JSON array's strings, else the parts between commas; trimmed, without empty ones."""
    parts = F.coalesce(F.from_json(value, "array<string>"), F.split(value, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def category_tokens(value: Column) -> Column:
    """Valid category tokens of a text of any shape, first spelling of each kept, in order."""
    bare = F.array(*[F.lit(x) for x in fixed.BARE_CATEGORIES.split()])
    found = F.regexp_extract_all(value, F.lit(r"[A-Za-z0-9][A-Za-z0-9.-]*"), F.lit(0))
    valid = F.filter(found, lambda x: x.contains(".") | x.contains("-") | F.array_contains(bare, F.lower(x)))
    fresh = lambda seen, x: F.when(F.exists(seen, lambda y: F.lower(y) == F.lower(x)), seen).otherwise(F.concat(seen, F.array(x)))
    return F.aggregate(valid, F.array().cast("array<string>"), fresh)


def topic_key(category: Column) -> Column:
    """First topic group that has the category, else ``other``."""
    own = F.lower(F.trim(category))
    cases = None
    for key, _, exact, prefixes in fixed.TOPIC_GROUPS[:-1]:
        tests = [own == x for x in exact] + [own.startswith(x) for x in prefixes]
        test = reduce(lambda a, b: a | b, tests)
        cases = F.when(test, key) if cases is None else cases.when(test, key)
    return cases.otherwise(fixed.TOPIC_GROUPS[-1][0])


def topic_keys(categories: Column) -> Column:
    """Distinct topic groups of a list of categories, in the groups' order."""
    own = F.array_distinct(F.transform(categories, topic_key))
    return F.filter(F.array(*[F.lit(g[0]) for g in fixed.TOPIC_GROUPS]), lambda k: F.array_contains(own, k))


def has_category(categories: Column, tokens: list[str], empty: bool = True) -> Column:
    """Whether a category is one of ``tokens`` or below one in the hierarchy; ``empty`` is the answer without tokens."""
    if not tokens:
        return F.lit(empty)
    return F.exists(categories, lambda c: reduce(lambda a, b: a | b, [(c == t) | c.startswith(t + ".") for t in tokens]))


def in_topic(categories: Column, tokens: list[str]) -> Column:
    """Like ``has_category`` without regard to case; a token may be a topic group's key too."""
    wanted = [t.strip().lower() for t in tokens if t.strip()]
    if not tokens:
        return F.lit(True)
    if not wanted:
        return F.lit(False)
    lowered = F.transform(categories, F.lower)
    keys = F.array(*[F.lit(t) for t in wanted])
    return F.arrays_overlap(topic_keys(categories), keys) | has_category(lowered, wanted)


def printed(value: Column, places: int) -> Column:
    """A double from 0 on with no or one decimal, as C's printf writes it: its exact binary value is rounded, and a tie goes to the even digit.

    ``format_string`` rounds the shortest decimal that stands for the double, so it writes 1.15 (in binary below that) as 1.2 and the tie 5.25 as 5.3."""
    below = F.floor(value * 10**places)
    # Twice the value in units of the last digit, as a sum whose lost bits are told: 20 x is 16 x + 4 x, and 2 x is exact.
    large, small = (value * 16, value * 4) if places else (value * 2, F.lit(0.0))
    total = large + small
    over = (total - (below * 2 + 1)) + (small - (total - large))
    units = F.when(over < 0, below).when(over > 0, below + 1).otherwise(below + below % 2)
    text = F.concat(F.floor(units / 10).cast("string"), F.lit("."), (units % 10).cast("string")) if places else units.cast("string")
    return F.when(value < 1e14, text).otherwise(F.format_string(f"%.{places}f", value))  # from there on, doubles don't hold twenty times the value


def dashboard_count(value: Column) -> Column:
    """A number in thousands (K), millions (M) or billions (B): one decimal under ten of them, none from there; below 1,000 as it is."""
    size, sign = F.abs(value), F.when(value < 0, "-").otherwise("")
    short = lambda n, unit: F.concat(sign, F.when(size / n < 10, printed(size / n, 1)).otherwise(printed(size / n, 0)), F.lit(unit))
    return F.when(size >= 1e9, short(1e9, "B")).when(size >= 1e6, short(1e6, "M")).when(size >= 1e3, short(1e3, "K")).otherwise(value.cast("long").cast("string"))


def abstract_preview(text: Column) -> Column:
    """First 480 characters of an abstract."""
    return F.substring(text, 1, 480)


def invert_index(index: Column) -> Column:
    """Text out of a map of words to places."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def doi(value: Column) -> Column:
    """Lower-cased DOI without its resolver."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(value)), r"^https?://(dx\.)?doi\.org/", ""), F.lit(""))


def cite_key(authors: Column, published: Column, title: Column) -> Column:
    last = F.element_at(F.split(F.trim(F.coalesce(F.get(authors, 0), F.lit("arxiv"))), r"\s+"), -1)
    name = F.regexp_replace(F.lower(last), "[^a-z]", "")
    word = F.regexp_extract(F.regexp_replace(F.lower(title), r"\\[a-z]+|[${}^_]", " "), "[a-z]{3,}", 0)
    or_else = lambda x, y: F.coalesce(F.nullif(x, F.lit("")), F.lit(y))
    return F.concat(or_else(name, "arxiv"), or_else(F.substring(published, 1, 4), "0000"), or_else(word, "paper"))


def bib_escape(value: Column) -> Column:
    return F.regexp_replace(value, "([%&#])", r"\\$1")


def bib_note(value: Column) -> Column:
    """A note fit for a field: blanks collapsed, braces dropped unless they balance."""
    step = lambda d, c: F.when(d < 0, d).when(c == "{", d + 1).when(c == "}", d - 1).otherwise(d)
    depth = F.aggregate(F.split(value, ""), F.lit(0), step)
    return bib_escape(collapse(F.when(depth == 0, value).otherwise(F.regexp_replace(value, "[{}]", ""))))


def bibtex(key: Column, title: Column, authors: Column, year: Column, eprint: Column, primary: Column, own_doi: Column, journal: Column, note: Column, url: Column) -> Column:
    def line(name: str, value: Column) -> Column:
        return F.when(F.nullif(value, F.lit("")).isNotNull(), F.concat(F.lit(f"  {name} = {{"), value, F.lit("},")))

    names = F.array_join(F.transform(authors, bib_escape), " and ")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("@misc{"), key, F.lit(",")),
        F.concat(F.lit("  title = {"), bib_escape(title), F.lit("},")),
        F.concat(F.lit("  author = {"), names, F.lit("},")),
        line("year", year),
        F.concat(F.lit("  eprint = {"), eprint, F.lit("},")),
        F.lit("  archivePrefix = {arXiv},"),
        line("primaryClass", primary),
        line("doi", own_doi),
        line("note", bib_escape(journal)),
        line("annote", bib_note(note)),
        F.concat(F.lit("  url = {"), url, F.lit("},")),
        F.lit("}"),
    )


def apa_authors(authors: Column) -> Column:
    n = F.size(authors)
    last = F.element_at(authors, -1)
    return (
        F.when(n == 0, "Unknown")
        .when(n == 1, F.get(authors, 0))
        .when(n == 2, F.concat_ws(" & ", authors))
        .when(n <= 7, F.concat(F.array_join(F.slice(authors, 1, n - 1), ", "), F.lit(", & "), last))
        .otherwise(F.concat(F.array_join(F.slice(authors, 1, 6), ", "), F.lit(", ... "), last))
    )


def short_authors(authors: Column, most: int = 3) -> Column:
    n = F.size(authors)
    return (
        F.when(n == 0, "Unknown authors")
        .when(n <= most, F.array_join(authors, ", "))
        .otherwise(F.concat(F.array_join(F.slice(authors, 1, most), ", "), F.lit(" +"), (n - most).cast("string")))
    )


def xml_escape(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def compact_count(value: Column) -> Column:
    """1.2k, 13k, 4.5M."""
    return (
        F.when(value >= 1_000_000, F.concat(printed(value / 1_000_000, 1), F.lit("M")))
        .when(value >= 10_000, F.concat(F.floor(value / 1000 + 0.5).cast("string"), F.lit("k")))
        .when(value >= 1_000, F.concat(printed(value / 1000, 1), F.lit("k")))
        .otherwise(value.cast("string"))
    )


def relative_age(moment: Column, now: Column) -> Column:
    hours = (F.unix_timestamp(now) - F.unix_timestamp(moment)) / 3600
    return (
        F.when(hours < 1, "just now")
        .when(hours < 24, F.concat(F.floor(hours).cast("string"), F.lit("h ago")))
        .when(hours < 14 * 24, F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(moment, "yyyy-MM-dd"))
    )


def math_segments(text: Column) -> Column:
    """Formulas of a text, ``$$...$$`` before ``$...$``."""
    return F.regexp_extract_all(text, F.lit(r"\$\$[^$]+\$\$|\$[^$]+\$"), F.lit(0))


def tokens(text: Column) -> Column:
    """Topic words: lower case, over two letters, no stop words."""
    # A run of two characters holds no match of three, so the pattern itself leaves short words out; stop words are looked up in a hash set.
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9\-]{2,}"), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(sorted(set(fixed.STOPWORDS.split()))))


def term_count(text: Column, terms: tuple[str, ...]) -> Column:
    """Occurrences of all terms, each counted without overlap with itself."""
    own = F.lower(text)
    each = [((F.length(own) - F.length(F.replace(own, F.lit(t), F.lit("")))) / len(t)).cast("int") for t in terms]
    return reduce(lambda a, b: a + b, each)


def word_number(text: Column) -> Column:
    own = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(own == "", 0).otherwise(F.size(F.split(own, " ")))


def sentence_number(text: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(". "), F.lit("")))) / 2).cast("int") + 1


def has_percentage(text: Column) -> Column:
    return text.rlike(r"\d+\.?\d*\s*%")


def has_named_system(title: Column) -> Column:
    return title.rlike(r"^[A-Z][A-Za-z0-9\-]{2,}\s*:")


def month_index(moment: Column, origin: int = 1992) -> Column:
    return (F.year(moment) - origin) * 12 + F.month(moment) - 1


def embedded_date(node: Column) -> Column:
    """(year, month) of a numeric id YYMMNNN between 1992 and 2003, else null."""
    own = F.lpad(node.cast("string"), 7, "0")
    two, month = F.substring(own, 1, 2).try_cast("int"), F.substring(own, 3, 2).try_cast("int")
    year = F.when(two >= 90, 1900 + two).otherwise(2000 + two)
    return F.when(month.between(1, 12) & year.between(1992, 2003), F.struct(year.alias("year"), month.alias("month")))


def seeded_uniform(text: Column) -> Column:
    """A draw from 0 to 1 (excluded) told by ``text`` alone: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)


def seeded_normal(text: Column) -> Column:
    """A standard normal draw told by ``text`` alone, from two uniform ones by Box and Muller."""
    radius = F.sqrt(-2 * F.log(1 - seeded_uniform(F.concat(text, F.lit("-radius")))))
    return radius * F.cos(2 * F.pi() * seeded_uniform(F.concat(text, F.lit("-angle"))))


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def calibrate(percentile: Column) -> Column:
    """Linear interpolation on the calibration grid."""
    grid = F.array(*[F.lit(x) for x in fixed.CALIBRATION])
    place = F.least(F.greatest(percentile, F.lit(0.0)), F.lit(1.0)) * 40
    low = F.least(F.floor(place), F.lit(39)).cast("int")
    return F.get(grid, low) + (place - low) * (F.get(grid, low + 1) - F.get(grid, low))


def year_ticks(first: Column, last: Column) -> Column:
    step = F.greatest(F.floor((last - first) / 6), F.lit(1)).cast("int")
    return F.array_distinct(F.concat(F.sequence(first, last, step), F.array(last)))


def snapshot_id(taxonomy: str, model: str, moment: Column) -> Column:
    """A snapshot's name: its moment, taxonomy and model; names order by time."""
    names = f"__{taxonomy.replace(',', '-').replace(' ', '')}__{model.replace('/', '-')}"
    return F.concat(F.date_format(moment, "yyyyMMdd'T'HHmmss'Z'"), F.lit(names))


def snapshot_time(name: Column) -> Column:
    """The moment in a snapshot's name; null where there is none."""
    return F.try_to_timestamp(F.split_part(name, F.lit("__"), F.lit(1)), F.lit("yyyyMMdd'T'HHmmss'Z'"))


def arxiv_doi(paper: Column) -> Column:
    """The DOI that a paper of the new id scheme has; null for others."""
    return F.when(paper.rlike(r"^\d{4}\.\d{4,5}$"), F.concat(F.lit("10.48550/arxiv."), paper))


def paper_of_doi(value: Column) -> Column:
    """The paper's id in such a DOI, or in a link to its page; null without one."""
    found = F.regexp_extract(F.lower(value), r"(?:10\.48550/arxiv\.|arxiv\.org/(?:abs|pdf)/)(\d{4}\.\d{4,5})", 1)
    return F.nullif(found, F.lit(""))


def snippet(text: Column) -> Column:
    """First 320 characters, blanks collapsed."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 320)


def camel_payload(columns: list[str]) -> Column:
    """Columns as one JSON object with names in camel case; numbers with a fraction to four places are rounded before."""
    camel = lambda c: c.split("_")[0] + "".join(x.capitalize() for x in c.split("_")[1:])
    return F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in columns]), {"ignoreNullFields": "false"})

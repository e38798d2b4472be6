"""Line dedup: a segment-partition edit join, in DataFrame functions only.

A line goes where an earlier line (smaller document, then smaller line number) is the same or within
``edits`` insertions, deletions and replacements. Lines are compared without blanks at their ends. Equal lines
meet from ``least_exact`` characters on, near ones from ``least_chars`` on, as in shorter lines a few edits make
another line; shorter ones always stay. ``EXACT_CHARS`` is every line that isn't empty.

1. Equal lines meet first, as hashes without their texts: of each, the first place stays. Only lines at first places go on.
2. Each distinct line is cut into ``edits + 1`` segments of nearly equal length. Within ``edits`` edits
   at least one segment stays whole, so a line probes, for each length that a partner may have, the
   segments' places moved as far as edits on both sides allow (the multi-match-aware ranges). A line
   probes lengths up to its own, hence each pair is met once.
3. A segment of more than about ``most`` lines, as variants of one template share it, is met by the rest of its lines instead:
   see ``_common_segments``. So no group is listed pair by pair, and an earlier near line is found all the same.
4. Candidates whose counts of twelve letters allow ``edits`` edits (an edit changes them by two at most) are
   verified by a banded bit-parallel edit distance: the band's 2 * edits + 1 cells of a column
   are bits of one long, and a column costs a dozen operations whatever the band.

A line's identity is two 64-bit hashes, and a near pair is confirmed on the lines themselves. Texts are exchanged once, by document:
segments, verified lines and the result all come from that exchange, each joined to its own list of line numbers a document.

Defined cases: null texts stay null and empty ones empty; documents with a null id stay whole and don't count as
earlier; repeated rows are one document and keep the same lines; an empty table gives no rows; other
columns pass unchanged whatever their names, as inner columns live in a struct of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, stored

EDITS = 2
LEAST_CHARS = 20
EXACT_CHARS = 1
#: Lines that share a segment and are still met pair by pair, about: which segments are more common is told from a sample.
COMMON = 8
#: One in so many lines is counted for that.
COMMON_SAMPLE = 2
#: Rests of lines that are met pair by pair by their letters, before their texts are fetched.
FEW = 500
#: Lengths of lines that a filter lists at most; of more, none is left out before its keys are made.
LENGTHS = 1_000
#: Characters of a rest of a line that isn't cut into segments any more.
CORE = 16


def _bits(value: int) -> Column:
    return F.lit(value).cast("long")


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of arrays of characters where it is at most ``edits``, else something larger.

    ``a`` must have ``edits`` elements at least, and lengths may differ by ``edits`` at most. Bit r of a
    column j stands for row j - edits + r. The distance is followed down the band's lowest diagonal to
    the last row, and along that row to the last column."""
    width = 2 * edits + 1
    full = (1 << width) - 1
    blank = F.array_repeat(F.lit(""), edits)
    return F.get(
        F.transform(
            F.array(F.struct(F.concat(blank, a, blank, blank, blank).alias("padded"), F.size(a).alias("rows"), b.alias("b"))),
            lambda line: _distance(line["padded"], line["rows"], line["b"], edits, width, full),
        ),
        0,
    )


def _distance(padded: Column, rows: Column, b: Column, edits: int, width: int, full: int) -> Column:
    """The distance itself. Its columns must be variables of a lambda, since the inner ones work out anything else once an element."""

    def same(char: Column, j: Column) -> Column:
        """The band's cells of column j (from 0) whose character of ``a`` is ``char``."""
        return F.struct((j + 1).alias("j"), sum((F.when(F.get(padded, j + r) == char, _bits(1 << r)).otherwise(_bits(0)) for r in range(width)), _bits(0)).alias("eq"))

    def column(state: Column, cell: Column) -> Column:
        vp, vn, j, eq = state["vp"], state["vn"], cell["j"], cell["eq"]
        zero = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(_bits(full))

        def moved(z: Column) -> Column:
            up = vn.bitwiseOR(z.bitwiseOR(vp).bitwiseXOR(_bits(full)))
            down = z.bitwiseAND(vp)
            shifted = F.shiftright(z, 1)
            last = rows - j + edits  # the last row's bit
            diagonal = F.when(z >= 1 << (width - 1), 0).otherwise(1)
            along = F.when(_bit(up, last) == 1, 1).when(_bit(down, last) == 1, -1).otherwise(0)
            return F.struct(
                down.bitwiseOR(shifted.bitwiseOR(up).bitwiseXOR(_bits(full))).alias("vp"),
                shifted.bitwiseAND(up).alias("vn"),
                (state["distance"] + F.when(j <= rows - edits, diagonal).otherwise(along)).alias("distance"),
            )

        # A transform of one element names ``zero``, so that it is worked out once a column.
        return F.get(F.transform(F.array(zero), moved), 0)

    start = F.struct(_bits(full & ~((1 << edits) - 1)).alias("vp"), _bits(0).alias("vn"), F.lit(edits).alias("distance"))
    return F.aggregate(F.transform(b, same), start, column, lambda s: s["distance"])


def _bit(value: Column, place: Column) -> Column:
    return F.call_function("shiftright", value, place).bitwiseAND(_bits(1))


#: Letters and digits whose counts are compared; any would be right, frequent ones tell lines apart best.
LETTERS = "etaoinsrhldu"


def letter_counts(line: Column) -> Column:
    """Counts of the letters modulo 32, five bits each."""
    size = F.octet_length(line)
    return sum((F.shiftleft(((size - F.octet_length(F.replace(line, F.lit(c), F.lit("")))) % 32).cast("long"), 5 * i) for i, c in enumerate(LETTERS)), _bits(0))


def counts_apart(a: Column, b: Column) -> Column:
    """Sum of the letters' differences, each the shorter way round; never more than twice the edit distance."""
    total = F.lit(0)
    for i in range(len(LETTERS)):
        apart = F.abs(F.shiftright(a, 5 * i).bitwiseAND(_bits(31)) - F.shiftright(b, 5 * i).bitwiseAND(_bits(31)))
        total = total + F.least(apart, 32 - apart)
    return total


def _places(edits: int) -> list[tuple[int, int, int]]:
    """(shorter_by, segment, move): a line's own segments first, then the other places where partners no longer than it may have theirs.

    A line's own segments are probes too, for partners of its own length. A place over the line's end gives a shorter
    piece, which verification turns down."""
    parts = edits + 1
    own = [(0, i, 0) for i in range(1, parts + 1)]
    other = []
    for shorter_by in range(edits + 1):
        for i in range(1, parts + 1):
            low = max(-(i - 1), shorter_by - (parts - i))
            high = min(i - 1, shorter_by + (parts - i))
            other += [(shorter_by, i, move) for move in range(low, high + 1) if shorter_by or move]
    return own + other


def _segment(length: Column, shorter_by: Column, i: Column, move: Column, edits: int) -> tuple[Column, Column, Column]:
    """(total, start from 1, size) of a place; of segments of unequal length, the longer are the last."""
    parts = edits + 1
    total = length - shorter_by
    base = F.floor(total / parts).cast("int")
    shorter = parts - (total - base * parts)
    start = F.greatest((i - 1) * base + F.greatest(F.lit(0), i - 1 - shorter) + 1 + move, F.lit(1))
    return total, start, base + F.when(i > shorter, 1).otherwise(0)


def segment_key(line: Column, length: Column, shorter_by: Column, i: Column, move: Column, edits: int, scope: Column | None = None) -> Column:
    """The key of a place in ``line`` of ``length`` characters, a column that was worked out before.

    Where characters are bytes, the piece is cut by bytes: a cut by characters counts them from the line's start each time."""
    total, start, size = _segment(length, shorter_by, i, move, edits)
    piece = F.when(F.octet_length(line) == length, F.substring(line.cast("binary"), start, size)).otherwise(F.substring(line, start, size).cast("binary"))
    return F.xxhash64(*([] if scope is None else [scope]), total, i, piece)


def own_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """A line's keys in the index, one a segment."""
    return [segment_key(line, length, *[F.lit(x) for x in place], edits) for place in _places(edits)[: edits + 1]]


def posted(lines: DataFrame, line: str, edits: int, scope: str | None = None, partner: str | None = None) -> DataFrame:
    """``lines`` without ``line`` but with ``place`` and ``key``: a row for each place of ``_places``, numbered from 0; with ``partner``,
    the length of all lines that are met, only for places in lines so long.

    Places are exploded before their keys are worked out, so that one short expression serves all."""
    places = F.array(*[F.struct(F.lit(n).alias("place"), *[F.lit(x).alias(c) for x, c in zip(p, ("shorter_by", "i", "move"), strict=True)]) for n, p in enumerate(_places(edits))])
    if partner is not None:
        places = F.filter(places, lambda p: p["shorter_by"] == F.char_length(line) - F.col(partner))
    each = lines.withColumn("_length", F.char_length(line)).withColumn("at", F.explode(places))
    key = segment_key(F.col(line), F.col("_length"), F.col("at.shorter_by"), F.col("at.i"), F.col("at.move"), edits, None if scope is None else F.col(scope))
    return each.select(*[c for c in lines.columns if c != line], F.col("at.place").alias("place"), key.alias("key"))


def candidate_pairs(index: DataFrame, probing: DataFrame, edits: int, rests: bool = False) -> DataFrame:
    """(doc_a, number_a, doc_b, number_b) of index (key, doc_id, number) and probing rows (those and place) that share a key;
    with ``rests``, those whose rests (s, letters) are within ``edits``, so that only few of a common segment's pairs come out.

    Number and place travel as one value: postings are what is exchanged most."""
    more = ["letters", "s"] if rests else []
    index = index.select(F.col("doc_id").alias("doc_a"), "key", F.col("number").alias("number_a"), *[F.col(c).alias(f"{c}_a") for c in more])
    packed = F.shiftleft(F.col("number").cast("long"), 5) + F.col("place")
    probing = probing.select(F.col("doc_id").alias("doc_b"), "key", packed.alias("packed"), *[F.col(c).alias(f"{c}_b") for c in more])
    number_b = F.shiftright(F.col("packed"), 5).cast("int")
    own = F.col("packed") % 32 <= edits
    # Of two own segments, one order is enough.
    differ = F.when(own, (F.col("doc_a") < F.col("doc_b")) | ((F.col("doc_a") == F.col("doc_b")) & (F.col("number_a") < number_b)))
    differ = differ.otherwise((F.col("doc_a") != F.col("doc_b")) | (F.col("number_a") != number_b))
    if rests:
        differ = differ & (counts_apart(F.col("letters_a"), F.col("letters_b")) <= 2 * edits) & (F.levenshtein("s_a", "s_b", edits) >= 0)
    return index.join(probing, "key").where(differ).select("doc_a", "number_a", "doc_b", number_b.alias("number_b"))


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _first_places(docs: DataFrame, least_chars: int, least_exact: int, edits: int) -> DataFrame:
    """(doc_id, number, near, length, keys): the first place of each distinct line, whether near ones count, and if so its keys in
    the index; only hashes are exchanged."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("number", "raw"))
    lines = lines.select("doc_id", "number", _trimmed(F.col("raw")).alias("line"))
    lines = lines.select("*", F.char_length("line").alias("length")).where(F.col("length") >= least_exact)
    near = F.col("length") >= least_chars
    keys = [F.when(near, k).alias(f"k{i}") for i, k in enumerate(own_keys(F.col("line"), F.col("length"), edits))]
    hashed = lines.select(F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"), near.alias("near"), "doc_id", "number", "length", *keys)
    # The running number orders places within a document; equal lines have equal keys, so any of them will do.
    place = F.struct("doc_id", "number")
    firsts = hashed.groupBy("h1", "h2", "near").agg(F.min(place).alias("first"), F.max("length").alias("length"), *[F.max(f"k{i}").alias(f"k{i}") for i in range(edits + 1)])
    return firsts.select("first.doc_id", "first.number", "near", "length", *[f"k{i}" for i in range(edits + 1)])


def _lines_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, number, line) of places, out of the one exchange of texts."""
    wanted = places.groupBy(F.col("doc_id").alias("of_doc")).agg(F.collect_set("number").alias("numbers"))
    joined = docs.join(wanted, F.col("doc_id") == F.col("of_doc"), "left").where(F.size("numbers") > 0).select("doc_id", "numbers", F.split("text", "\n").alias("lines"))
    each = joined.select("doc_id", "lines", F.explode("numbers").alias("number"))
    return each.select("doc_id", "number", _trimmed(F.get("lines", F.col("number"))).alias("line"))


def _with_line(docs: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """``pairs`` with the line at one side. Pairs are read once and go to their document's text, each text is cut into lines once."""
    doc, number, line = f"doc_{side}", f"number_{side}", f"line_{side}"
    others = [c for c in pairs.columns if c != doc]
    asked = pairs.groupBy(F.col(doc).alias("of_doc")).agg(F.collect_list(F.struct(*others)).alias("asked"))
    joined = docs.join(asked, F.col("doc_id") == F.col("of_doc"), "left").where(F.size("asked") > 0)
    each = joined.select(F.col("doc_id").alias(doc), F.split("text", "\n").alias("lines"), F.explode("asked").alias("x"))
    return each.select(doc, *[F.col(f"x.{c}").alias(c) for c in others], _trimmed(F.get("lines", F.col(f"x.{number}"))).alias(line))


def _common(a: Column, b: Column) -> Column:
    """How many characters two strings have in common at their start."""
    longest = F.least(F.char_length(a), F.char_length(b))
    differing = F.array_position(F.transform(F.sequence(F.lit(1), longest + 1), lambda n: (n > longest) | (F.substring(a, n, 1) != F.substring(b, n, 1))), True)
    return differing.cast("int") - 1


def _cores(members: DataFrame) -> DataFrame:
    """(scope, doc_id, number, s, n, least, letters) with what all ``n`` members of a scope have in common at both ends taken off ``s``, of whose
    lengths ``least`` is the smallest; edit distances within a scope stay the same."""
    back = F.reverse("s")
    ends = members.groupBy("scope").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.min(back).alias("back_low"), F.max(back).alias("back_high"), F.min(F.char_length("s")).alias("least"), F.count("*").alias("n"))
    head = _common(F.col("low"), F.col("high"))
    ends = ends.select("scope", head.alias("head"), F.least(_common(F.col("back_low"), F.col("back_high")), F.col("least") - head).alias("tail"), "least", "n")
    joined = members.join(ends, "scope")
    inner = joined.select("scope", "doc_id", "number", F.substring("s", F.col("head") + 1, F.char_length("s") - F.col("head") - F.col("tail")).alias("s"), "n", (F.col("least") - F.col("head") - F.col("tail")).alias("least"))
    return inner.withColumn("letters", letter_counts(F.col("s")))


def _few_pairs(cores: DataFrame, edits: int) -> DataFrame:
    """Pairs of a scope whose rests are within ``edits``, which lengths and letters settle for most; for scopes of few members."""
    a = cores.select("scope", F.col("doc_id").alias("doc_a"), F.col("number").alias("number_a"), F.char_length("s").alias("length_a"), F.col("letters").alias("letters_a"), F.col("s").alias("s_a"))
    b = cores.select("scope", F.col("doc_id").alias("doc_b"), F.col("number").alias("number_b"), F.char_length("s").alias("length_b"), F.col("letters").alias("letters_b"), F.col("s").alias("s_b"))
    order = (F.col("doc_a") < F.col("doc_b")) | ((F.col("doc_a") == F.col("doc_b")) & (F.col("number_a") < F.col("number_b")))
    near = (F.abs(F.col("length_a") - F.col("length_b")) <= edits) & (counts_apart(F.col("letters_a"), F.col("letters_b")) <= 2 * edits)
    near = near & (F.levenshtein("s_a", "s_b", edits) >= 0)
    return a.join(b, "scope").where(order & near).select("doc_a", "number_a", "doc_b", "number_b")


def _near_first(cores: DataFrame) -> DataFrame:
    """(doc_a, number_a, doc_b, number_b): each member (b) with its first partner within two edits in its scope, if that comes earlier.

    Two edits are two replacements (rub out the same two places), a deletion and an insertion (delete one place each),
    a deletion and a replacement (the longer deletes one and rubs one out, the shorter rubs one out) or two deletions
    (the longer has two fewer, or one). Who shares such a form is near for sure, so of each form the first place is
    enough and no pairs are listed. A newline marks what was cut out of a line and takes part in no edit."""
    s, i, j = F.col("s"), F.col("i"), F.col("j")
    length = F.char_length(s)
    piece = lambda a, b: F.substring(s, a, F.greatest(b - a + 1, F.lit(0)))  # noqa: E731  places a to b, from 1
    to_end = lambda a: F.substring(s, a, length)
    both = cores.select("*", F.explode(F.sequence(F.lit(1), length)).alias("i")).where(length > 0).select("*", F.explode(F.sequence(F.lit(1), length)).alias("j"))
    both = both.where((F.substring(s, i, 1) != "\n") & (F.substring(s, j, 1) != "\n"))

    def form(kind: str, total: Column, role: int, when: Column, *parts: Column) -> Column:
        return F.when(when, F.struct(F.xxhash64(F.lit(kind), F.col("scope"), total, *parts).alias("form"), F.lit(role).alias("role")))

    without_i = F.concat(piece(F.lit(1), i - 1), to_end(i + 1))
    rubbed = (piece(F.lit(1), i - 1), piece(i + 1, j - 1), to_end(j + 1))
    early = (F.concat(piece(F.lit(1), i - 1), piece(i + 1, j - 1)), to_end(j + 1))  # i is deleted before j
    late = (piece(F.lit(1), j - 1), F.concat(piece(j + 1, i - 1), to_end(i + 1)))
    forms = F.array(
        form("two replaced", length, 0, i <= j, i, j, *[F.when(i < j, x).otherwise(y) for x, y in zip(rubbed, (rubbed[0], F.lit(""), to_end(i + 1)), strict=True)]),
        form("moved", length, 0, i == j, without_i),
        form("one deleted", length - 1, 1, i == j, without_i),
        form("one deleted, one replaced", length - 1, 1, i < j, *early),
        form("one deleted, one replaced", length - 1, 1, i > j, *late),
        form("one deleted, one replaced", length, 2, i == j, piece(F.lit(1), i - 1), to_end(i + 1)),
        form("two deleted", length - 2, 1, i < j, F.concat(*rubbed)),
    )
    of_two = both.select("doc_id", "number", F.explode(F.array_compact(forms)).alias("x")).select("doc_id", "number", "x.form", "x.role")
    whole = [cores.select("doc_id", "number", F.xxhash64(F.lit(kind), F.col("scope"), length, s).alias("form"), F.lit(2).alias("role")) for kind in ("one deleted", "two deleted")]
    members = of_two.union(whole[0]).union(whole[1])
    # Role 0 meets 0; 1 (the longer) meets 2.
    partner = F.when(F.col("role") == 0, 0).otherwise(3 - F.col("role"))
    first = members.groupBy("form", partner.alias("role")).agg(F.min(F.struct("doc_id", "number")).alias("first"))
    met = members.join(first, ["form", "role"]).where(F.col("first") < F.struct("doc_id", "number"))
    met = met.groupBy("doc_id", "number").agg(F.min("first").alias("first"))
    return met.select(F.col("first.doc_id").alias("doc_a"), F.col("first.number").alias("number_a"), F.col("doc_id").alias("doc_b"), F.col("number").alias("number_b"))


def _common_segments(docs: DataFrame, firsts: DataFrame, hot: DataFrame, edits: int, least_chars: int, few: int, core: int) -> DataFrame:
    """Pairs as ``candidate_pairs`` has them, for keys of more lines than that; every line that is near to an earlier
    one by such a key is the later of some pair.

    Lines that share a segment are compared by the rest of them: with the segment taken out, and without what all
    have in common at both ends. Rests of up to ``core`` characters meet each other, where more than ``few`` share a
    segment by their forms; longer ones meet by segments of their own, and so on where more than ``few`` share one. A rest loses a third of
    its length each time.

    A key is of one length of line, and of each pair that it has to find one is so long. Rests of those are a scope's shortest, so a
    rest is posted only at places that it has against rests of that length."""
    all_lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("number", "raw")).select("doc_id", "number", _trimmed(F.col("raw")).alias("line"))
    # A key is of lines of one length, so only those up to as many longer as edits allow can have it.
    lengths = hot.select(F.explode(F.sequence("length", F.col("length") + edits)).alias("length")).distinct()
    told = [r["length"] for r in lengths.limit(LENGTHS + 1).collect()]
    length = F.char_length("line")
    some = all_lines.where(length.isin(told) if len(told) <= LENGTHS else length >= least_chars)  # lines with keys are long enough
    probing = posted(some, "line", edits).join(hot, "key", "left_semi")
    members = probing.join(firsts.select("doc_id", "number"), ["doc_id", "number"])
    members = stored(members.select("doc_id", "number", "place", "key"), "common-segments")
    strings = _lines_at(docs, members).toDF("of_doc", "of_number", "s")
    level, found, made = members, [], [members]
    places = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(p, ("shorter_by", "i", "move"), strict=True)]) for p in _places(edits)])
    while True:
        on = (F.col("doc_id") == F.col("of_doc")) & (F.col("number") == F.col("of_number"))
        joined = level.join(strings, on & (F.col("own_scope") == F.col("of_scope")) if found else on)
        at = F.get(places, F.col("place"))
        _, start, size = _segment(F.char_length("s"), at["shorter_by"], at["i"], at["move"], edits)
        rest = F.concat(F.substring(F.col("s"), F.lit(1), start - 1), F.lit("\n"), F.substring(F.col("s"), start + size, F.char_length("s")))
        cores = stored(_cores(joined.select(F.col("key").alias("scope"), "doc_id", "number", rest.alias("s")).distinct()), "cores")
        short = cores.where(F.col("least") <= core)
        short = _near_first(short.where(F.col("n") > few)).union(_few_pairs(short.where(F.col("n") <= few), edits))
        long = cores.where(F.col("least") > core)
        deeper = posted(long.select("doc_id", "number", "letters", "scope", F.col("s"), F.col("s").alias("cut"), "least"), "cut", edits, "scope", "least")
        deeper = stored(deeper.drop("least").withColumnRenamed("scope", "own_scope"), "deeper")
        counts = deeper.where(F.col("place") <= edits).groupBy("key").agg(F.count("*").alias("n"))
        again = stored(counts.where(F.col("n") > few).select("key"), "common-keys")
        light = candidate_pairs(deeper.where(F.col("place") <= edits).join(again, "key", "left_anti"), deeper, edits, rests=True)
        found.append(stored(short.union(light).distinct(), "common-pairs"))
        made += [cores, deeper, again]
        if again.isEmpty():
            break
        level = deeper.drop("s", "letters").join(again, "key", "left_semi")
        strings = long.select(F.col("scope").alias("of_scope"), F.col("doc_id").alias("of_doc"), F.col("number").alias("of_number"), "s")
    discard(*made)
    return reduce(DataFrame.union, found)


def near_places(docs: DataFrame, firsts: DataFrame, edits: int, least_chars: int, most: int = COMMON, core: int = CORE, sample: int = COMMON_SAMPLE, few: int = FEW) -> DataFrame:
    """(doc_id, number): first places of lines that are near to a line with an earlier first place."""
    index = firsts.select("doc_id", "number", "length", F.explode(F.array(*[f"k{i}" for i in range(edits + 1)])).alias("key"))
    # Which keys are common decides how their lines are met, not which: a sample of lines tells it well enough.
    counted = index.where(F.pmod(F.xxhash64("doc_id", "number"), F.lit(sample)) == 0).groupBy("key").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    hot = stored(counted.where(F.col("n") * sample > most).select("key", "length"), "common-keys")
    lines = _lines_at(docs, firsts)
    if edits != 2 or hot.isEmpty():  # forms are those of two edits
        pairs = candidate_pairs(index, posted(lines, "line", edits), edits)
    else:
        # No key of these is common, so a task's part of the index is looked up as a table of hashes and the many probing rows aren't sorted.
        pairs = candidate_pairs(index.join(hot, "key", "left_anti").hint("shuffle_hash"), posted(lines, "line", edits), edits)
        pairs = pairs.union(_common_segments(docs, firsts, hot, edits, least_chars, few, core))
    met = _with_line(docs, _with_line(docs, pairs.distinct(), "a"), "b")
    apart = F.abs(F.char_length("line_b") - F.char_length("line_a"))
    met = met.where((apart <= edits) & (F.col("line_a") != F.col("line_b")))
    # Pairs are few bytes and much work: they are dealt out by number, and a counter keeps the tests above that exchange, each letter counted once.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.withColumn("letters_a", letter_counts(F.col("line_a"))).withColumn("letters_b", letter_counts(F.col("line_b")))
    met = met.repartition(parts, "doc_a", "number_a", "doc_b", "number_b").withColumn("at", F.monotonically_increasing_id())
    met = met.where((counts_apart(F.col("letters_a"), F.col("letters_b")) <= 2 * edits) & (F.col("at") >= 0))
    shorter = F.char_length("line_a") <= F.char_length("line_b")
    short, long = F.when(shorter, F.col("line_a")).otherwise(F.col("line_b")), F.when(shorter, F.col("line_b")).otherwise(F.col("line_a"))
    met = met.where((banded_distance(F.split(short, ""), F.split(long, ""), edits) <= edits) & (F.col("at") >= 0))
    place = lambda x: F.struct(F.col(f"doc_{x}").alias("doc_id"), F.col(f"number_{x}").alias("number"))
    return met.select(F.greatest(place("a"), place("b")).alias("later")).select("later.doc_id", "later.number").distinct()


def dedup_lines(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS, least_exact: int | None = None, most: int = COMMON, core: int = CORE, sample: int = COMMON_SAMPLE, few: int = FEW) -> DataFrame:
    """``docs`` with ``text`` cut down to the lines that stay, and a struct ``line_dedup`` of n_lines and n_removed.

    ``least_exact`` is ``least_chars`` unless given.

    Columns other than id and text are joined back by the exchange of the texts itself, which carries them all."""
    whole = docs.select(docs["doc_id"], docs["text"], F.struct(*[docs[c] for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")]).alias("rest"))
    bare = whole.where("doc_id IS NOT NULL")  # everywhere alike, so that one exchange serves all
    least_exact = least_chars if least_exact is None else least_exact
    firsts = stored(_first_places(bare.select("doc_id", "text"), least_chars, least_exact, edits), "first-lines")
    near = near_places(bare, firsts.where("near").drop("near"), edits, least_chars, most, core, sample, few)
    staying = firsts.join(near, ["doc_id", "number"], "left_anti").groupBy(F.col("doc_id").alias("of_doc")).agg(F.collect_list("number").alias("numbers"))
    joined = bare.join(staying, F.col("doc_id") == F.col("of_doc"), "left")
    numbered = joined.select("doc_id", "text", "rest", F.col("numbers").alias("staying"), F.split("text", "\n").alias("lines"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    none = F.array().cast("array<int>")
    compared = F.filter(every, lambda i: F.char_length(_trimmed(F.get(F.col("lines"), i))) >= least_exact)
    gone = F.array_except(compared, F.coalesce("staying", none))
    cut = numbered.select("doc_id", "text", "rest", "lines", gone.alias("gone"))
    text = F.array_join(F.transform(F.array_except(every, "gone"), lambda i: F.get(F.col("lines"), i)), "\n")
    told = F.col("text").isNotNull()
    count = lambda c: F.when(told, F.size(c)).otherwise(0).cast("long")
    done = cut.select("doc_id", F.when(told, text).alias("text"), "rest", F.struct(count("lines").alias("n_lines"), count("gone").alias("n_removed")).alias("line_dedup"))
    bare_lines = F.when(told, F.size(F.split("text", "\n"))).otherwise(0).cast("long")
    unknown = whole.where("doc_id IS NULL").select("doc_id", "text", "rest", F.struct(bare_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed")).alias("line_dedup"))
    done = done.union(unknown)
    columns = [F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return done.select(*columns, "line_dedup")

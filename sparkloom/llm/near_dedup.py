"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

1. Documents with equal shingle sets are one class; only classes go on, so exact copies cost nothing.
2. A signature has ``COORDINATES`` minima. A link at the threshold agrees in about 4 of 5 of them;
   pairs with fewer than ``MATCHES`` agreeing ones can't be links but for a chance of a few in a million.
3. A class is posted under coordinate-value pairs. Those are put in one global order, rare ones first (by
   counts in a bounded sample; any global order is right, rare first is short), and only the first
   ``COORDINATES - MATCHES + 1`` are posted: two signatures agreeing in ``MATCHES`` places share one of them.
4. Posting lists are merged in order of size classes. Members whose sizes can't reach the threshold are
   skipped. A list of up to ``SHORT`` members says all its pairs; a longer one only neighbours in a random
   order of its own, so that work is linear in postings.
5. The pairs' agreeing coordinates are counted over whole signatures; those above the match threshold
   are confirmed on full sets, best pairs first, and confirmed links are united.
6. Of short lists, pairs across what is united by then are confirmed next. Long lists, and lists dealt into parts, that are not one
   component by then are settled whole: members outside the list's largest component meet all others in blocks, first with a byte of each
   coordinate. Only the full sets of members with a partner of another component that agrees in ``LEAST`` bytes (a link fails to with a
   chance of 1e-14) meet again: intersections are counted by merging the sets' own posting lists, and only a forest of the links leaves a
   block. Thus no link between components is lost, and no pairs of a large group are listed.
7. Texts and postings are exchanged only if a bitmap of those asked for has them.

Defined cases: null texts and texts without words have empty sets and link with nothing; repeated rows
are one document; ties of size go by id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import as_bytes, bounded_sample, discard, map_batches, small_batches, stored
from sparkloom.llm.components import Forest, components
from sparkloom.llm.shingles import mixed, set_digest, shingle_set

COORDINATES = 128
MATCHES = 82
SHORT = 9
#: Agreeing bytes of two signatures from which on members of a long list meet with their full sets.
LEAST = 64
#: Members of one side of a block where signatures' bytes meet.
BLOCK_MEMBERS = 8_000
#: Shingles of one side of a block of a long list.
BLOCK_SHINGLES = 1_000_000
#: Postings of one token that meet in one task, about.
LIST = 20_000
#: Signatures whose coordinate values are counted for the global order.
ORDER_SAMPLE = 20_000
#: Best partners of a class that are confirmed first.
FIRST = 2
#: Pairs a merging task remembers to say each once.
REMEMBERED = 200_000
#: Bits of the bitmap by which rows are narrowed before they are exchanged, a power of two; it is broadcast as longs.
BITS = 1 << 24

_rng = np.random.default_rng(64)
_A = _rng.integers(0, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, size=256, dtype=np.uint64)


def signature(values: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Minima of the set under so many hash functions, 32 bits each."""
    best = np.full(coordinates, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(values), 2048):
        some = values[at : at + 2048, None] * _A[None, :coordinates] + _B[None, :coordinates]
        best = np.minimum(best, (some >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return best


def _narrowed(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` isn't among ``wanted`` (one column); all rows of a value stay or go.

    A bitmap of hashes is broadcast, of ``BITS`` bits whatever comes; with many values it only lets more rows through, which the join that
    follows turns down."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    word, place = F.shiftright("_bit", 6), F.col("_bit").bitwiseAND(F.lit(63)).cast("int")
    bits = wanted.select(bit(F.col(wanted.columns[0])).alias("_bit")).groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("_bits"))
    met = rows.withColumn("_bit", bit(F.col(column))).join(F.broadcast(bits), word == F.col("_word"))
    return met.where(F.call_function("shiftright", F.col("_bits"), place).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)


def _sketches(docs: DataFrame, length: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch):
        rows = []
        for text in as_bytes(batch.column(1)):
            values = shingle_set(text, length)
            rows.append((len(values), *set_digest(values), signature(values).tobytes() if len(values) else None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=["doc_id", "n", "d1", "d2", "signature"]
        )

    return map_batches(docs.select(docs["doc_id"], docs["text"]), work, f"doc_id {kind}, n long, d1 long, d2 long, signature binary")


def _tokens(rows: np.ndarray) -> np.ndarray:
    """Coordinate-value pairs of signatures as one 64-bit value each."""
    places = np.arange(rows.shape[1], dtype=np.uint64) << np.uint64(32)
    return mixed(rows.astype(np.uint64) + places[None, :])


def _read(column: pa.Array, coordinates: int = COORDINATES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, coordinates)


def _postings(classes: DataFrame, matches: int, longest: int) -> DataFrame:
    """(token, class_id, n, part): the rarest coordinate-value pairs of each class that any match must share.

    Lists that the sample says to be over ``longest`` are dealt into parts by class. What the parts of
    a list leave apart is settled over the whole list, however few members it has."""
    spark = classes.sparkSession
    kind = classes.schema["class_id"].dataType.simpleString()
    drawn = bounded_sample(classes.select("class_id", "signature"), ["class_id"], ORDER_SAMPLE, "order").select("signature").collect()
    frequent, times = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    if drawn:
        frequent, times = np.unique(_tokens(np.frombuffer(b"".join(r[0] for r in drawn), np.uint32).reshape(-1, COORDINATES)), return_counts=True)
        frequent, times = frequent[times > 1], times[times > 1]
    order = spark.sparkContext.broadcast((frequent, times.astype(np.uint32)))
    share = classes.count() / max(1, len(drawn)) / longest
    prefix = COORDINATES - matches + 1

    def work(batch: pa.RecordBatch):
        tokens = _tokens(_read(batch.column(2)))
        known, count = order.value
        rank = np.ones(tokens.shape, dtype=np.uint32)
        if len(known):
            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            rank = np.where(known[at] == tokens, count[at], rank)
        first = np.lexsort((tokens, rank), axis=1)[:, :prefix]
        own = np.take_along_axis(tokens, first, axis=1).ravel().view(np.int64)
        times = np.take_along_axis(rank, first, axis=1)
        parts = np.where(times > 1, np.ceil(times * share), 1).astype(np.uint64)
        part = mixed(np.bitwise_xor.reduce(tokens, axis=1))[:, None] % parts
        of = pa.array(np.repeat(np.arange(len(tokens)), prefix))
        yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(0).take(of), batch.column(1).take(of), pa.array(part.ravel().astype(np.int32))], names=["token", "class_id", "n", "part"])

    return map_batches(classes.select("class_id", "n", "signature"), work, f"token long, class_id {kind}, n long, part int")


def _merge(postings: DataFrame, percent: int, short: int) -> DataFrame:
    """(a, b, of_short): all pairs of short lists, neighbours of long ones, if their sizes allow the threshold; a pair can come several times."""
    kind = postings.schema["class_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set = set()
        token, held, tail = None, [], None  # of a part of a token's list; held: the list so far while it is short; tail: its last member once it is long
        found: list = []

        def say(x: tuple, y: tuple, of_short: bool) -> None:
            if 100 * min(x[1], y[1]) >= percent * max(x[1], y[1]) and x[0] != y[0]:
                pair = (min(x[0], y[0]), max(x[0], y[0]), of_short)
                if pair not in said:
                    said.add(pair)
                    found.append(pair)

        def close() -> None:
            if tail is None:
                for i, x in enumerate(held):
                    for y in held[:i]:
                        say(x, y, True)

        def flush(of) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([*[pa.array([p[i] for p in found], of) for i in range(2)], pa.array([p[2] for p in found], pa.bool_())], names=["a", "b", "of_short"])
            found.clear()
            return out

        of = None
        for batch in batches:
            of = batch.column(1).type
            for own_token, own, n, part in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (own_token, part) != token:
                    close()
                    token, held, tail = (own_token, part), [], None
                member = (own, n)
                if tail is not None:
                    say(tail, member, False)
                    tail = member
                    continue
                held.append(member)
                if len(held) > short:
                    for x, y in zip(held, held[1:], strict=False):
                        say(x, y, False)
                    held, tail = [], member
            if len(said) > REMEMBERED:
                said.clear()
            yield flush(of)
        close()
        if found:
            yield flush(of)

    order = (F.floor(F.log("n") / math.log(100 / percent)), F.xxhash64("token", "class_id"), F.col("class_id"))
    merged = postings.select("token", "class_id", "n", "part").repartition("token", "part").sortWithinPartitions("token", "part", *order)
    return merged.mapInArrow(run, f"a {kind}, b {kind}, of_short boolean")


def _counted(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """(a, b, of_short, agree) of pairs with enough agreeing coordinates."""
    kind = classes.schema["class_id"].dataType.simpleString()
    of_a = classes.select(F.col("class_id").alias("a"), F.col("signature").alias("sa"))
    of_b = classes.select(F.col("class_id").alias("b"), F.col("signature").alias("sb"))

    def work(batch: pa.RecordBatch):
        agree = (_read(batch.column(3)) == _read(batch.column(4))).sum(axis=1)
        keep = pa.array(agree >= matches)
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(agree, pa.int32())], names=["a", "b", "of_short", "agree"]).filter(keep)

    once = pairs.groupBy("a", "b").agg(F.max("of_short").alias("of_short"))
    joined = once.join(of_a, "a").join(of_b, "b").select("a", "b", "of_short", "sa", "sb")
    return map_batches(joined, work, f"a {kind}, b {kind}, of_short boolean, agree int")


def _sets(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(class_id, members): full sets of ``wanted`` (class_id, d1, d2), read from the texts whose set has the class's digest."""
    kind = wanted.schema["class_id"].dataType.simpleString()
    texts = docs.select(docs["doc_id"].alias("of_doc"), docs["text"].alias("own_text"))
    texts = _narrowed(texts, "of_doc", wanted.select("class_id"))  # texts are what is exchanged most, and few are asked for
    texts = wanted.join(texts, F.col("class_id") == F.col("of_doc")).select("class_id", "d1", "d2", "own_text")

    def make(batch: pa.RecordBatch):
        ids, sets = [], []
        for i, text in enumerate(as_bytes(batch.column(3))):
            values = shingle_set(text, length)
            if set_digest(values) == (batch.column(1)[i].as_py(), batch.column(2)[i].as_py()):
                ids.append(i)
                sets.append(values.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(sets, pa.binary())], names=["class_id", "members"])

    return map_batches(texts, make, f"class_id {kind}, members binary")


def _sets_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(class_id, members) of the classes in ``pairs``; only their texts are read into sets."""
    ends = pairs.select("a").union(pairs.select("b")).distinct().toDF("class_id")
    return _sets(ends.join(classes.select("class_id", "d1", "d2"), "class_id"), docs, length)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst): pairs whose full sets reach the threshold."""
    kind = pairs.schema["a"].dataType.simpleString()

    def compare(batch: pa.RecordBatch):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("a", "b").join(sets.toDF("a", "ma"), "a").join(sets.toDF("b", "mb"), "b").select("a", "b", "ma", "mb")
    return map_batches(joined, compare, f"src {kind}, dst {kind}")


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends aren't in one component yet."""
    of_a, of_b = found.toDF("a", "ca"), found.toDF("b", "cb")
    joined = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _unsettled(postings: DataFrame, found: DataFrame, short: int) -> DataFrame:
    """(group_id, class_id, part, minor): members of long or dealt lists that hold several components, theirs, and whether it isn't the
    group's largest one, which needn't be compared within itself. Lists of one first member are one
    group: near copies share most lists, and those mostly begin with the same one, so that a class is in few groups."""
    counts = postings.groupBy("token").agg(F.count("*").alias("m"), (F.min("part") != F.max("part")).alias("in_parts"))
    listed = _narrowed(postings, "token", counts.where((F.col("m") > short) | F.col("in_parts")).select("token"))
    of = listed.join(found, F.col("class_id") == F.col("node"), "left").select("token", "class_id", F.col("part").alias("dealt"), F.coalesce("component", "class_id").alias("part"))
    of = stored(of, "listed")
    lists = of.groupBy("token").agg(
        F.count("*").alias("m"), F.min("part").alias("low"), F.max("part").alias("high"), F.min("class_id").alias("group_id"), (F.min("dealt") != F.max("dealt")).alias("in_parts")
    )
    mixed_lists = lists.where(((F.col("m") > short) | F.col("in_parts")) & (F.col("low") != F.col("high"))).select("token", "group_id")
    members = of.join(mixed_lists, "token").select("group_id", "class_id", "part").distinct()
    largest = members.groupBy("group_id", "part").agg(F.count("*").alias("m")).groupBy("group_id").agg(F.max_by("part", F.struct("m", "part")).alias("largest"))
    groups = stored(members.join(largest, "group_id").select("group_id", "class_id", "part", (F.col("part") != F.col("largest")).alias("minor")), "groups")
    discard(of)
    return groups


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, counts): values that left[i] shares with each set of ``right``, if any, by merging posting lists of the right sets' members."""
    values = np.concatenate(right) if right else np.empty(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], np.repeat(np.arange(len(right)), np.array([len(x) for x in right], dtype=np.int64))[order]
    for i, own in enumerate(left):
        low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        times = high - low
        if not times.any():
            continue
        at = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        yield i, np.bincount(owners[at], minlength=len(right))


def links_between(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, [j, ...]): sets of ``right`` that reach the threshold with left[i]."""
    sizes = np.array([len(x) for x in right], dtype=np.int64)
    for i, shared in _shared(left, right):
        linked = np.flatnonzero((shared > 0) & (100 * shared >= percent * (len(left[i]) + sizes - shared)))
        if len(linked):
            yield i, linked


def _dealt(members: DataFrame, sized: DataFrame, most: int) -> DataFrame:
    """``members`` (group_id, class_id, minor, and more) with low, high and left, once for each block where they meet: those outside the
    largest component on the left, all on the right. ``sized`` (group_id, n, n_minor): sizes of groups, of which ``most`` a side make a block."""
    blocks = sized.select("group_id", F.ceil(F.col("n") / most).cast("int").alias("blocks"), F.ceil(F.greatest(F.col("n_minor"), F.lit(1)) / most).cast("int").alias("minor_blocks"))
    block = lambda n: F.pmod(F.xxhash64(F.lit("block"), "class_id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda low, high, left: F.struct(low.alias("low"), high.alias("high"), F.lit(left).alias("left"))
    # A member's copies for both sides come out of one row, so that members are made and exchanged once.
    right = F.transform(every("minor_blocks"), lambda low: place(low, F.col("own_block"), False))
    left = F.transform(every("blocks"), lambda high: place(F.col("own_minor"), high, True))
    numbered = members.join(blocks, "group_id").withColumn("own_block", block("blocks")).withColumn("own_minor", block("minor_blocks"))
    places = F.when(F.col("minor"), F.concat(right, left)).otherwise(right)
    return numbered.select(*members.columns, F.explode(places).alias("at")).select(*members.columns, "at.low", "at.high", "at.left")


def _sized(members: DataFrame, size: Column) -> DataFrame:
    return members.groupBy("group_id").agg(F.sum(size).alias("n"), F.sum(F.when(F.col("minor"), size).otherwise(0)).alias("n_minor"))


def _marks(classes: DataFrame) -> DataFrame:
    """(class_id, n, mark): a byte of each coordinate of the signatures."""
    kind = classes.schema["class_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch):
        marks = [row.tobytes() for row in _read(batch.column(2)).astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary())], names=["class_id", "n", "mark"])

    return map_batches(classes.select("class_id", "n", "signature"), work, f"class_id {kind}, n long, mark binary")


def _near(groups: DataFrame, marks: DataFrame, least: int, percent: int, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """(group_id, class_id, minor): members of groups with a partner of another component, one of both outside the largest, whose size allows
    the threshold and whose mark agrees in ``least`` bytes; pairs aren't listed."""
    kind = groups.schema["class_id"].dataType.simpleString()
    asked = _narrowed(marks, "class_id", groups.select("class_id").distinct())
    dealt = _dealt(groups.join(asked, "class_id").select("group_id", "class_id", "part", "minor", "n", "mark"), _sized(groups, F.lit(1)), block_members)

    def meet(table: pa.Table) -> pa.Table:
        on_left, part, n = (table[c].to_numpy(zero_copy_only=False) for c in ("left", "part", "n"))
        marks = np.frombuffer(b"".join(table["mark"].to_pylist()), np.uint8).reshape(len(n), -1)
        tokens = marks.astype(np.uint16) + (np.arange(marks.shape[1], dtype=np.uint16) << np.uint16(8))
        left, right = np.flatnonzero(on_left), np.flatnonzero(~on_left)
        near = np.zeros(len(n), dtype=bool)
        for i, shared in _shared(list(tokens[left]), list(tokens[right])):
            own = left[i]
            sizes = n[right]
            found = (shared >= least) & (part[right] != part[own]) & (100 * np.minimum(sizes, n[own]) >= percent * np.maximum(sizes, n[own]))
            near[own] = found.any()
            near[right[found]] = True
        return table.select(["group_id", "class_id", "minor"]).filter(pa.array(near))

    return dealt.groupBy("group_id", "low", "high").applyInArrow(meet, f"group_id {kind}, class_id {kind}, minor boolean").distinct()


def _settled(groups: DataFrame, classes: DataFrame, docs: DataFrame, length: int, percent: int, block_shingles: int) -> DataFrame:
    """(src, dst): a forest of all links between components of each group: members outside its largest component against all,
    block against block."""
    kind = classes.schema["class_id"].dataType.simpleString()
    wanted = groups.select("class_id").distinct().join(classes.select("class_id", "d1", "d2"), "class_id")
    sets = _sets(wanted, docs, length).toDF("set_id", "members")
    members = groups.join(sets, F.col("class_id") == F.col("set_id")).select("group_id", "class_id", "minor", "members")
    dealt = _dealt(members, _sized(groups.join(classes.select("class_id", "n"), "class_id"), F.col("n")), block_shingles)

    def settle(table: pa.Table) -> pa.Table:
        ids, on_left = table["class_id"].to_pylist(), table["left"].to_numpy(zero_copy_only=False)
        sets_of = [np.frombuffer(x, np.uint64) for x in table["members"].to_pylist()]
        left, right = np.flatnonzero(on_left), np.flatnonzero(~on_left)
        forest = Forest()
        for i, linked in links_between([sets_of[x] for x in left], [sets_of[x] for x in right], percent):
            for j in linked.tolist():
                if ids[left[i]] != ids[right[j]]:
                    forest.link(ids[left[i]], ids[right[j]])
        stars, of = forest.stars(), table["class_id"].type
        return pa.table({"src": pa.array([s[0] for s in stars], of), "dst": pa.array([s[1] for s in stars], of)})

    return dealt.groupBy("group_id", "low", "high").applyInArrow(settle, f"src {kind}, dst {kind}")


def near_duplicates(docs: DataFrame, length: int = 5, percent: int = 80, matches: int = MATCHES, short: int = SHORT, block_shingles: int = BLOCK_SHINGLES, longest: int = LIST) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text).

    ``length`` words make a shingle; documents link where 100 * shared >= ``percent`` * all shingles."""
    spark = docs.sparkSession
    small_batches(spark)
    signed = stored(_sketches(docs, length), "signed-sketches")
    # Differing texts under one repeated id are classes of one id; they go by their own digests.
    signed_classes = stored(
        signed.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("signature").alias("signature")),
        "signed-classes",
    )
    # Signatures are most of these tables and aren't asked for once pairs are counted.
    sketches = stored(signed.drop("signature"), "sketches")
    discard(signed)
    postings = stored(_postings(signed_classes, matches, longest), "postings")
    small_batches(spark, 4_000)
    counted = stored(_counted(_merge(postings, percent, short), signed_classes, matches), "pairs")
    small_batches(spark)
    classes = stored(signed_classes.drop("signature"), "classes")
    marks = stored(_marks(signed_classes), "marks")
    discard(signed_classes)
    order = [F.desc("agree"), "other"]
    ends = counted.select(F.col("a").alias("own"), F.col("b").alias("other"), "agree").union(counted.select("b", "a", "agree"))
    best = ends.withColumn("place", F.row_number().over(Window.partitionBy("own").orderBy(*order))).where(F.col("place") <= FIRST)
    best = stored(best.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).distinct(), "best")
    # Every class of a pair has a best one, so these are all sets that any pair needs: texts are exchanged for them once.
    sets = stored(_sets_of(best, classes, docs, length), "sets")
    links = stored(_confirmed(best, sets, percent), "links")
    found = components(links)
    rest = stored(_across(counted.where("of_short").select("a", "b").join(best, ["a", "b"], "left_anti"), found), "rest")
    more = [links]
    if not rest.isEmpty():
        asked = rest.select("a").union(rest.select("b")).distinct()
        more.append(stored(_confirmed(rest, _narrowed(sets, "class_id", asked), percent), "links"))
        found = components(more[0].union(more[1]))
    discard(sets)
    groups = _unsettled(postings, found, short)
    near = stored(_near(groups, marks, min(matches, LEAST), percent), "near")
    if not near.isEmpty():
        more.append(stored(_settled(near, classes, docs, length, percent, block_shingles), "links"))
    if len(more) > 1:
        found = components(reduce(DataFrame.union, more))
    discard(postings, counted, best, rest, groups, marks, near, *more)
    told = classes.join(found, F.col("class_id") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "class_id").alias("component"))
    return (
        sketches.join(told, ["d1", "d2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").cast("long").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN words IS NULL OR len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS shingles FROM w),
sets AS (SELECT md5(array_to_string(list_sort(shingles), '|')) AS class, min(doc_id) AS class_id, any_value(shingles) AS shingles,
         any_value(len(shingles)) AS n FROM s WHERE len(shingles) > 0 GROUP BY 1),
posted AS (SELECT class_id, n, hash(unnest(shingles)) AS g FROM sets),
common AS (
  SELECT a.class_id AS x, b.class_id AS y, a.n AS nx, b.n AS ny, count(*) AS shared FROM posted a JOIN posted b
  ON a.g = b.g AND a.class_id < b.class_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY 1, 2, 3, 4),
half AS (SELECT x, y FROM common WHERE 100 * shared >= 80 * (nx + ny - shared)),
links AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach(node, seen) AS (SELECT class_id, class_id FROM sets UNION SELECT r.node, l.y FROM reach r JOIN links l ON r.seen = l.x),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(c.component, s.doc_id)::BIGINT AS component_id,
       s.doc_id = coalesce(c.component, s.doc_id) AS kept
FROM s LEFT JOIN sets k ON len(s.shingles) > 0 AND k.class = md5(array_to_string(list_sort(s.shingles), '|')) LEFT JOIN comp c ON c.node = k.class_id
"""

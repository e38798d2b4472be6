"""Interaction of document filters: what each removes, repeats or loses in every order of them.

Five filters fail a document: A under 100 words; B under 80 % distinct words; C over 10 % upper-case A-Z; D any of ``#$%&*|``;
E the same text as a document of smaller id. Duplicates are told by sorting:

1. Rows are range-partitioned by the text's fingerprint (two 64-bit hashes) and id, and a running number parts rows that are
   equal in both, so a group of copies of any size is cut into ranges like anything else. Partitions are sorted by fingerprint, full text, id.
2. One pass over a sorted partition compares each row with its predecessor: the same text as the one before, and an id above the
   first of its text in the partition, make a duplicate. The same pass works out the other failures, as the text is at hand.
3. A text can go on from partition to partition, but only texts under a partition's first and last fingerprints can. The pass
   emits those texts once with their smallest ids (the edges: a few rows a partition), and joining edges tells which texts began with a
   smaller id in another partition. Only rows that came first of their text in a partition still depend on that.
4. Failures become a mask of five bits. Rows are counted by part, mask and labels, and all 120 orders are worked out from those
   counters, which add up over tasks and parts.

Defined cases: null texts are empty, and empty texts are each other's copies; a null id is neither a duplicate nor anyone's
first; rows of equal id and text aren't each other's copies, and each counts; labels of a document given twice count where any has 1; a null lang
is the empty part; very long texts are compared whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, small_batches, stored

#: Filters in the order of the mask's bits, lowest first.
FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT = 80
MOST_UPPER = 10

_ODD = re.compile(rb"[#$%&*|]")
_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
DUPLICATE = 1 << FILTERS.index("E")


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a UTF-8 text fails."""
    words = text.split()
    points = len(text.translate(None, _CONTINUED))
    upper = len(text) - len(text.translate(None, _UPPER))
    failed = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * upper > MOST_UPPER * points, _ODD.search(text) is not None)
    return sum(1 << i for i, x in enumerate(failed) if x)


ROW = "doc_id {kind}, part string, mask int, head string, f1 long, f2 long, edge_text binary"


def _compared(sorted_rows: DataFrame, kind: str) -> DataFrame:
    """Rows with their failures, E as far as their own partition tells, and edges (``edge_text`` not null; ``head`` names a text under a
    partition's first fingerprint, in edges and in the rows that came first of it)."""
    names = [x.split()[0] for x in ROW.format(kind=kind).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_part = TaskContext.get().partitionId()
        first_print = last_print = text = least = None
        heads = 0
        head, edges, id_type = None, [], None  # edges: (doc_id, head, f1, f2, text) of the first and, so far, of the last fingerprint
        last_edges: list[tuple] = []

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (id_type, pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            id_type, found = batch.column(0).type, []
            columns = (batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), *(batch.column(i).to_pylist() for i in (2, 3, 4)))
            for doc_id, own, part, f1, f2 in zip(*columns, strict=True):
                fresh = own != text
                if (f1, f2) != last_print:
                    if last_print is not None and last_print == first_print:
                        edges, last_edges = last_edges, []
                    first_print = first_print or (f1, f2)
                    last_print, last_edges, fresh = (f1, f2), [], True
                if fresh:
                    text, least = own, doc_id
                    head = f"{own_part}:{heads}" if last_print == first_print else None
                    heads += head is not None
                    if doc_id is not None:
                        last_edges.append((doc_id, None, None, head, f1, f2, own))
                copied = doc_id is not None and least is not None and doc_id > least
                found.append((doc_id, part, failures(own) | DUPLICATE * copied, None if copied or doc_id is None else head, None, None, None))
            yield packed(found)
        if id_type is not None and (edges or last_edges):
            yield packed(edges + last_edges)

    return sorted_rows.select("doc_id", "text", "part", "f1", "f2").mapInArrow(run, ROW.format(kind=kind))


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of each row of ``docs`` (doc_id, text, lang): bit i is set if filter i of ``FILTERS`` fails."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"], text.alias("text"), F.coalesce(docs["lang"], F.lit("")).alias("part"))
    rows = rows.withColumns({"f1": F.xxhash64(F.lit(1), "text"), "f2": F.xxhash64(F.lit(2), "text"), "number": F.monotonically_increasing_id()})
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, "f1", "f2", F.asc_nulls_last("doc_id"), "number")
    told = stored(_compared(spread.sortWithinPartitions("f1", "f2", "text", F.asc_nulls_last("doc_id")), kind), "filter-masks")
    edges = told.where("edge_text IS NOT NULL").select("doc_id", "head", "f1", "f2", "edge_text")
    # Edges are a few rows a partition, whatever the documents.
    firsts = edges.groupBy("f1", "f2", "edge_text").agg(F.min("doc_id").alias("first_id"))
    later = edges.where("head IS NOT NULL").join(firsts, ["f1", "f2", "edge_text"]).where(F.col("first_id") < F.col("doc_id"))
    later = later.select(F.col("head").alias("later_head"))
    own = told.where("edge_text IS NULL").select("doc_id", "part", "mask", "head")
    joined = own.join(later, F.col("head") == F.col("later_head"), "left")
    mask = F.when(F.col("later_head").isNotNull(), F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask"))
    found = joined.select("doc_id", "part", mask.alias("mask"))
    found._told = told
    return found


def counters(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, failures and labels."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of_doc")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = masked.join(known, F.col("doc_id") == F.col("of_doc"), "left")
    flag = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("part", "mask", flag("good"), flag("toxic")).groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))


def interactions(counted: DataFrame) -> DataFrame:
    """The report of every order and step, from counters alone."""
    orders = F.array(*[F.lit("".join(x)) for x in itertools.permutations(FILTERS)])
    steps = counted.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bit(step: Column) -> Column:
        return F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.instr(F.lit(FILTERS), F.substring("filter_order", step, 1)))

    own = bit(F.col("step"))
    # Filters of earlier steps, as a mask.
    before = F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda held, i: held + F.when(i < F.col("step"), bit(i)).otherwise(0))
    steps = steps.withColumns({"own": own, "before": before})
    failing = F.col("mask").bitwiseAND(F.col("own")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    removed = failing & ~earlier
    # A document that fails k filters is removed by each of them in a k-th of the orders.
    orders_each = F.lit(len(list(itertools.permutations(FILTERS)))) / F.greatest(F.bit_count("mask"), F.lit(1))
    total = lambda when, what=F.col("n"): F.sum(F.when(when, what).otherwise(0)).cast("long")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~failing & ~earlier).alias("kept"),
        total(removed).alias("removed"),
        total(failing & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(removed & (F.col("good") == 1)).alias("good_lost"),
        total(removed & (F.col("toxic") == 1)).alias("toxic_lost"),
        total(failing, (F.col("n") * orders_each).cast("long")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    masked = masks(docs)
    counted = stored(counters(masked, labels), "filter-counters")
    discard(masked._told)
    return interactions(counted)


_SQL_BIT = "CASE letter WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 ELSE 16 END"
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY x) AS first_id FROM t),
f AS (
  SELECT doc_id, part, (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * len(regexp_extract_all(x, '[A-Z]')) > 10 * length(x) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN first_id < doc_id THEN 16 ELSE 0 END) AS mask FROM w),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1),
m AS (SELECT f.part, f.mask, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
bits AS (SELECT letter, {_SQL_BIT} AS bit FROM letters),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS order_bits
  FROM bits a JOIN bits b ON a.bit <> b.bit JOIN bits c ON c.bit NOT IN (a.bit, b.bit) JOIN bits d ON d.bit NOT IN (a.bit, b.bit, c.bit)
  JOIN bits e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
steps AS (SELECT filter_order, s AS step, order_bits[s] AS own, list_sum(order_bits[1:s - 1])::INT AS before FROM orders, unnest([1, 2, 3, 4, 5]) AS u(s)),
r AS (
  SELECT part, filter_order, step, own, good, toxic, n, mask, mask & own <> 0 AS failing, mask & coalesce(before, 0) <> 0 AS earlier FROM m CROSS JOIN steps),
g AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT failing AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN failing AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN failing AND earlier THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN failing AND NOT earlier AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN failing AND NOT earlier AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM g
"""

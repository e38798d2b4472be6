"""Answers of external sources, landed as JSON text, as columns of one shape; and the driver's loop that asks for them within a budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import scalars

# How many ids the sources take in one request.
PAPERS_A_REQUEST = 400
DOIS_A_REQUEST = 50

# The fields of the sources' answers that are read.
SCHOLAR_FIELDS = "paperId: string, externalIds: struct<DOI:string>, citationCount: long, referenceCount: long, influentialCitationCount: long, venue: string, publicationTypes: array<string>"
WORK_FIELDS = "id: string, doi: string, cited_by_count: long, referenced_works_count: long, type: string, primary_location: struct<source:struct<display_name:string>>"
REGISTRY_FIELDS = "DOI: string, `reference-count`: long, `is-referenced-by-count`: long, `container-title`: array<string>, type: string"


def _text(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def _answer(rows: DataFrame, key: str, source: str, external: Column, doi: Column, citations: Column, references: Column, influential: Column, venue: Column, kind: Column) -> DataFrame:
    return rows.select(
        key,
        F.lit(source).alias("source"),
        external.alias("external_id"),
        scalars.doi(doi).alias("doi"),
        citations.alias("citations"),
        references.alias("references"),
        influential.alias("influential"),
        venue.alias("venue"),
        kind.alias("publication_type"),
    )


def scholar_papers(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, source, external_id, doi, citations, references, influential, venue, publication_type) of one source's papers; what isn't told is null, never 0."""
    r = rows.select(key, F.from_json(payload, f"struct<{SCHOLAR_FIELDS}>").alias("r")).where("r.paperId IS NOT NULL")
    kind = F.array_join("r.publicationTypes", ",")
    return _answer(r, key, "semantic_scholar", _text(F.col("r.paperId")), F.col("r.externalIds.DOI"), F.col("r.citationCount"), F.col("r.referenceCount"), F.col("r.influentialCitationCount"), _text(F.col("r.venue")), _text(kind))


def open_works(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """The same columns of works; an answer may be a work or a list of results, of which the first counts."""
    parsed = rows.select(key, F.from_json(payload, f"results array<struct<{WORK_FIELDS}>>").alias("many"), F.from_json(payload, f"struct<{WORK_FIELDS}>").alias("one"))
    first = F.when(F.col("many.results").isNotNull(), F.get("many.results", F.lit(0))).otherwise(F.col("one"))
    r = parsed.select(key, first.alias("r")).where("r.id IS NOT NULL")
    none = F.lit(None).cast("long")
    return _answer(r, key, "openalex", _text(F.col("r.id")), F.col("r.doi"), F.col("r.cited_by_count"), F.col("r.referenced_works_count"), none, _text(F.col("r.primary_location.source.display_name")), _text(F.col("r.type")))


def registry_works(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """The same columns of a DOI registry's messages."""
    r = rows.select(key, F.from_json(payload, f"message struct<{REGISTRY_FIELDS}>").alias("m")).select(key, F.col("m.message").alias("r")).where("r.DOI IS NOT NULL")
    none = F.lit(None).cast("long")
    return _answer(r, key, "crossref", F.lower("r.DOI"), F.col("r.DOI"), F.col("r.`is-referenced-by-count`"), F.col("r.`reference-count`"), none, _text(F.get("r.`container-title`", F.lit(0))), _text(F.col("r.type")))


def batches(ids: list[str], size: int) -> list[list[str]]:
    """Ids in stripes: one after the other to each batch in turn, so that a batch that fails costs a sample of all and not a stretch."""
    n = max(1, -(-len(ids) // size))
    return [ids[i::n] for i in range(n)] if ids else []


def enriched(ids: list[str], ask: Callable[[list[str]], dict | None], size: int, budget: float, clock: Callable[[], float]) -> tuple[dict, list[str]]:
    """(answers by id, ids not asked or not answered) within ``budget`` seconds of ``clock``. A batch for which ``ask`` gives none is asked for once more, after all others."""
    began, answers, queue, again = clock(), {}, batches(ids, size), []
    left: list[str] = []
    for turn in (queue, again):
        for batch in turn:
            found = ask(batch) if clock() - began < budget else None
            if found is not None:
                answers |= found
            elif turn is queue and clock() - began < budget:
                again.append(batch)
            else:
                left += batch
    return answers, left


def settled(detail: dict | None, related: list | None) -> dict:
    """What is known of a paper from two requests of which either may have failed (none): partial if so."""
    own = detail or {}
    text = lambda v: (v or "").strip() or None
    return {
        "citationCount": own.get("citationCount"),
        "influentialCitationCount": own.get("influentialCitationCount"),
        "referenceCount": own.get("referenceCount"),
        "venue": text(own.get("venue")),
        "tldr": text((own.get("tldr") or {}).get("text")),
        "related": [p for p in related or [] if p.get("title")],
        "partial": detail is None or related is None,
    }

"""Entry functions: one search, one record, one identification, for callers that have a single question."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinledger.functions.requests import LONGEST, parse_requests
from kinledger.operators.corpus import SOURCES
from kinledger.plans import search as plans

CLAIM = "claim_id long, query string, claimed_name string, cin string, website string, email string"


class InvalidInput(ValueError):
    """What a caller asked can't be answered; the text says why."""


def search(entities: DataFrame, query: str, source: str = "all", limit: int | str | None = None, scorer=None) -> DataFrame:
    """Entities (entity_id, score, probability, rank) for a name; 10 unless ``limit`` asks for another number of 1..25."""
    query = " ".join(query.split())
    if len(query) < 2:
        raise InvalidInput("Search term is too short.")
    if len(query) > LONGEST:
        raise InvalidInput(f"Search term is too long (limit {LONGEST} characters).")
    if source != "all" and source not in SOURCES:
        raise InvalidInput(f'Unknown source "{source}". Choose one of: all, {", ".join(SOURCES)}')
    try:
        shown = plans.SHOWN if limit is None else int(float(limit))
    except (ValueError, OverflowError) as e:
        raise InvalidInput(f'"{limit}" is not a number.') from e
    claim = entities.sparkSession.createDataFrame([(0, None, query, None, None, None)], CLAIM)
    return plans.served_search(claim, entities, source, shown, scorer).drop("claim_id").orderBy("rank")


def record(entities: DataFrame, entity_id: str) -> DataFrame:
    """The entity of an id, no row where the id is of no known source or shape."""
    ok = re.fullmatch(rf"(?:{'|'.join(SOURCES)}):[0-9]+", entity_id) is not None
    return entities.where(F.col("id") == entity_id) if ok else entities.limit(0)


def identify(entities: DataFrame, query: str | None = None, company_name: str | None = None, cin: str | None = None, website: str | None = None, email: str | None = None) -> DataFrame:
    """Ranked matches of one request (free text and fields); a request that breaks a rule raises."""
    spark = entities.sparkSession
    asked = spark.createDataFrame([(0, query, company_name, cin, website, email)], CLAIM)
    parsed = parse_requests(asked, ["claim_id"], "query", "claimed_name", "cin", "website", "email").first()
    if parsed.error:
        raise InvalidInput(parsed.error)
    site = parsed.hostname if parsed.email is None or not parsed.email.endswith("@" + (parsed.hostname or "")) else None
    claim = spark.createDataFrame([(0, None, parsed.company_name, parsed.cin, site, parsed.email)], CLAIM)
    return plans.ranked_matches(claim, entities).drop("claim_id").orderBy("rank")

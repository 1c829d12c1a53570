"""Flows that put several operators together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizfit.functions import columns as C
from bizfit.operators import annotate, contacts, match, pages, score, store
from bizfit.operators.shared import cut, spread
from bizfit.operators.store import KeyedTable
from bizfit.sources import readers


def _phone(companies: DataFrame) -> DataFrame:
    return companies.select("id", "name", "city", F.col("website").alias("_site"), F.get("contacts", F.lit(0))["phone"].alias("licence_phone"))


def enrich(companies: DataFrame, fetched: DataFrame, facts: DataFrame, as_of_year: int, refresh: bool, bodies: DataFrame | None = None) -> DataFrame:
    """Companies with a page's signals and contacts folded in (fetched: id, url, html), contacts checked, quality assessed.

    A company without a website gets the page's address if the page proves to be its
    own; a page that doesn't, says nothing about it. A company has one page, behind
    which its about and contact pages are read if ``bodies`` (url, html) has them.
    """
    proven = pages.site_proof(spread(fetched.select("id", "url", "html").join(_phone(companies), "id"))).select("id", "url", "html", "_site", "method")
    proven = cut(proven, "enrich-proven")  # so that the filter doesn't take the proof's expressions in, and read a page once for each of their parts
    own = proven.filter("_site IS NOT NULL OR method IS NOT NULL").select("id", "url", "html")
    own = own if bodies is None else pages.secondary_pages(own, bodies)
    found = cut(pages.page_contacts(pages.page_signals(spread(own), as_of_year)).select("id", "url", F.col("web").alias("_web"), "contact"), "enrich-found")
    rows = companies.join(found.select("id", F.col("url").alias("_url"), "_web"), "id", "left")
    rows = rows.withColumns({"website": F.coalesce(C.blank(F.col("website")), "_url"), "web": F.coalesce("_web", "web")}).drop("_url", "_web")
    folded = pages.fold_contacts(rows, found, refresh=refresh)
    return annotate.quality(contacts.validate_contacts(folded, facts))


def refresh_batch(companies: DataFrame, fetched: DataFrame, facts: DataFrame, as_of_year: int, bodies: DataFrame | None = None) -> DataFrame:
    """Companies of a batch brought up to date with their fetched pages (id, url, html), those behind them (bodies: url, html), and scored.

    Only companies with a page are returned. The result carries cache_key, by which
    history is appended.
    """
    batch = companies.join(fetched.select("id"), "id", "left_semi")
    return score.content_key(score.score_table(enrich(batch, fetched, facts, as_of_year, refresh=True, bodies=bodies), as_of_year), as_of_year)


@dataclass(frozen=True)
class Stores:
    """What a refresh writes: the companies, and the folders of raw payloads and of the score history."""

    companies: KeyedTable
    payloads: str
    scores: str


HISTORY = ["company_id", "cache_key", "score", "confidence", "covered_weight", "scored_at"]


def save_refresh(scored: DataFrame, stores: Stores, at: str, writer: str = "refresh", epoch: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """X3's writes: (K1 companies with the batch in place, K3 raw payloads, K4 score history), as they are after it.

    The companies are the last to change, and their version is the commit. A batch with
    an epoch that is replayed after it, or after it broke off before, leaves what one
    run would: its payloads replace their own, its scores' keys are there, its version is.
    """
    scored, table = cut(scored, "refresh-scored"), stores.companies
    label = None if epoch is None else f"{writer}-{epoch}"
    payloads = store.append_payloads(scored.select("id", "website", "web", "contacts"), "id", stores.payloads, at, label)
    rows = scored.select(F.col("id").alias("company_id"), "cache_key", "score", "confidence", "covered_weight", F.lit(at).alias("scored_at"))
    history = store.append_scores(rows.select(*HISTORY), stores.scores)
    return table.upsert(scored.select(*table.schema.names), writer=writer, epoch=epoch), payloads, history


def refresh_stored(ids: DataFrame, stores: Stores, fetched: DataFrame, facts: DataFrame, as_of_year: int, at: str, writer: str, epoch: int, bodies: DataFrame | None = None) -> None:
    """X4's step: the companies with these ids, as the last step left them, are refreshed and saved, once an epoch."""
    if stores.companies.epoch(writer) >= epoch:
        return
    batch = stores.companies.read().join(ids.select("id").distinct(), "id", "left_semi")
    save_refresh(refresh_batch(batch, fetched, facts, as_of_year, bodies), stores, at, writer, epoch)


def score_list(lists: DataFrame, facts: DataFrame, as_of_year: int) -> tuple[DataFrame, DataFrame]:
    """(a lead list's companies, contacts checked, quality assessed and scored; the report on its columns and rows)."""
    companies, report = readers.lead_list(lists, as_of_year)
    return score.score_table(annotate.quality(contacts.validate_contacts(readers.complete(companies), facts)), as_of_year), report


def collect(
    register: DataFrame, personnel: DataFrame, mapped: DataFrame, fetched: DataFrame, facts: DataFrame, as_of_year: int, limit: int, state: str
) -> tuple[DataFrame, DataFrame]:
    """(scored sample, summary) from the sources to the scores.

    Register rows with their principals are merged with map elements, deduplicated and
    annotated over the full set; then a sample is drawn, whose missing websites are
    looked for among the ``fetched`` pages (url, html), proved, read with the pages
    behind them, and scored. Of several pages with an address the first by its html is read.
    """
    licensed = match.attach_principal(readers.licence_to_company(readers.licence_load(register)), readers.principal_best(personnel).select("licence_number", "person", "person_title"))
    licensed = readers.market_scope(licensed, state)
    merged = readers.complete(match.merge_sources(readers.complete(licensed), readers.complete(mapped))).select(*readers.COMPANY)
    kept = cut(match.dedupe(merged)[0], "collect-kept")
    full = cut(annotate.chain_locations(annotate.peer_density(kept)), "collect-annotated")
    sample = cut(annotate.stratified_sample(full, limit), "collect-sample")
    fetched = cut(fetched.groupBy("url").agg(F.min("html").alias("html")), "collect-pages")
    bare = sample.filter(C.blank(F.col("website")).isNull())
    inferred = pages.candidate_pages(bare, fetched).select("id", "url", "method")
    known = sample.select("id", C.domain(F.col("website")).alias("_host")).join(fetched.select(C.domain(F.col("url")).alias("_host"), "url"), "_host").groupBy("id").agg(F.min("url").alias("url"))
    own = inferred.select("id", "url").unionByName(known.select("id", "url")).join(fetched, "url").select("id", "url", "html")
    scored = cut(score.score_table(enrich(sample, own, facts, as_of_year, refresh=False, bodies=fetched), as_of_year), "collect-scored")
    proofs = pages.match_tally(bare, inferred).select(F.concat(F.lit("website "), "method").alias("what"), F.col("companies").cast("double").alias("value"))
    trades = annotate.trade_counts(scored).select(F.concat(F.lit("industry "), F.coalesce("industry", F.lit("unknown"))).alias("what"), F.col("companies").cast("double").alias("value"))
    spread = [annotate.order_statistics(scored, c).select(F.stack(F.lit(5), *[x for k in ("low", "quarter", "median", "three_quarters", "high") for x in (F.lit(f"{c} {k}"), F.col(k))]).alias("what", "value")) for c in ("score", "data_quality")]
    return scored, proofs.unionByName(trades).unionByName(spread[0]).unionByName(spread[1])

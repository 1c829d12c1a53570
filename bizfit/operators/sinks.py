"""Writers of CRM exports and snapshots. Paths are the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizfit.operators.score import FACTORS, primary_contact, with_total

EXPORT = ["name", "score", "confidence", "coverage", "industry", "city", "state", "postcode", "phone", "email", "contact_name", "contact_title", "website", "business_type", "licence_issued", "source_url"]
# Header names of the three presets, in the order of EXPORT.
PRESETS = {
    "generic": ["Company", "Acquisition Fit", "Confidence", "Thesis Coverage", "Industry", "City", "State", "Postcode", "Phone", "Email", "Contact Name", "Contact Title", "Website", "Ownership Form", "Licensed Since", "Source"],
    "hubspot": ["Name", "acquisition_fit_score", "acquisition_fit_confidence", "acquisition_thesis_coverage", "Industry", "City", "State/Region", "Postal Code", "Phone Number", "Email", "Contact Name", "Job Title", "Website URL", "ownership_form", "licensed_since", "record_source"],
    "salesforce": ["Account Name", "Acquisition_Fit__c", "Acquisition_Confidence__c", "Thesis_Coverage__c", "Industry", "BillingCity", "BillingState", "BillingPostalCode", "Phone", "Email", "Contact_Full_Name__c", "Title", "Website", "Ownership_Form__c", "Licensed_Since__c", "Record_Source__c"],
}


def crm_export(scored: DataFrame, preset: str = "generic", ids: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """K5: sixteen text columns under a preset's headers; null is empty; best score first when written.

    ``ids`` limits it to some companies; ``weights`` rescores rows that carry their factors.
    """
    rows = scored if ids is None else scored.join(ids.select("id").distinct(), "id", "left_semi")
    if weights is not None:
        given = {k: float(weights.get(k, 0.0)) for k in FACTORS}
        added = ["covered_weight", "effective_weights", "contributions", "score_raw", "score", "confidence"]
        rows = with_total(rows.drop(*added), lambda k: F.lit(given[k]))
    best = primary_contact()
    text = {
        "score": F.format_string("%.1f", "score"), "coverage": F.format_string("%.2f", "covered_weight"), "phone": best["phone"], "email": best["email"],
        "contact_name": best["name"], "contact_title": best["title"], "licence_issued": F.date_format("licence_issued", "yyyy-MM-dd"),
    }
    columns = [F.coalesce(text.get(k, F.col(k) if k not in text else None).cast("string"), F.lit("")).alias(h) for k, h in zip(EXPORT, PRESETS[preset], strict=True)]
    return rows.orderBy(F.desc("score"), F.asc("id")).select(*columns)


def write_csv(export: DataFrame, path: str, bom: bool = False) -> None:
    """Ordered part files with a header each; empty values stay empty. With ``bom`` each file starts with the mark that spreadsheets look for."""
    mark = "\ufeff" if bom else ""
    named = export.withColumnRenamed(export.columns[0], mark + export.columns[0])
    named.write.option("header", True).option("emptyValue", "").csv(path)


def write_snapshot(scored: DataFrame, path: str, market: str, sources: list[str], generated_at: str) -> None:
    """K6: rows by score, and a metadata row beside them."""
    scored.orderBy(F.desc("score"), F.asc("id")).write.json(f"{path}/companies")
    meta = scored.sparkSession.createDataFrame([(market, sources, generated_at)], "market string, sources array<string>, generated_at string")
    meta.write.json(f"{path}/meta")

import pytest

from bizfit.operators.score import FACTORS, score_table
from bizfit.plans.demo import nest

COLUMNS = (
    "id string, pos long, name string, website string, industry string, city string, state string, postcode string, latitude double, longitude double, employee_count int, revenue_usd double, "
    "founded_year int, business_type string, has_employees boolean, has_contact boolean, contact_name string, contact_title string, email string, email_status string, phone string, "
    "phone_valid boolean, linkedin_url string, is_decision_maker boolean, crawled boolean, https boolean, mobile_viewport boolean, has_analytics boolean, copyright_year int, "
    "latest_content_year int, page_bytes int, tech string, has_careers_page boolean, has_team_page boolean, web_founded_year int, raw_text_excerpt string, peer_count_in_niche long, "
    "sibling_location_count long"
)
BASE = {"name": "Test Co", "website": "https://test.co", "industry": "hvac", "city": "Columbus", "state": "OH", "has_contact": False, "crawled": False, "has_careers_page": False, "has_team_page": False}
CASES = {
    "golden-ideal": {
        "name": "Whitaker Heating & Cooling", "founded_year": 1979, "employee_count": 38, "revenue_usd": 5.2e6, "peer_count_in_niche": 22, "has_contact": True, "contact_name": "Dale Whitaker",
        "contact_title": "Owner", "email": "dale@whitakerhvac.com", "email_status": "verified", "phone": "+16145550142", "phone_valid": True, "is_decision_maker": True, "crawled": True, "https": False,
        "mobile_viewport": False, "has_analytics": False, "tech": "FrontPage", "copyright_year": 2016, "latest_content_year": 2016, "page_bytes": 41000, "has_team_page": True,
        "raw_text_excerpt": "A family-owned business serving central Ohio since 1979.",
    },
    "golden-too-big": {
        "name": "National Mechanical Group", "founded_year": 1998, "employee_count": 4200, "revenue_usd": 6.8e8, "peer_count_in_niche": 3, "has_contact": True, "email": "info@nmg.com",
        "email_status": "risky", "is_decision_maker": False, "crawled": True, "https": True, "mobile_viewport": True, "has_analytics": True, "tech": "Next.js", "latest_content_year": 2026,
        "page_bytes": 180000, "has_careers_page": True, "raw_text_excerpt": "A portfolio company of Meridian Capital Partners.",
    },
    "golden-sparse": {"name": "Unknown Services LLC", "website": None},
    "golden-dormant": {
        "name": "Old Town Plumbing", "founded_year": 1972, "employee_count": 6, "revenue_usd": 4.8e5, "peer_count_in_niche": 140, "crawled": True, "https": False, "mobile_viewport": False,
        "has_analytics": False, "copyright_year": 2011, "latest_content_year": 2011, "page_bytes": 900, "raw_text_excerpt": "Owner-operated since 1972.",
    },
}
# The six factors in order, then the total.
EXPECTED = {
    "golden-ideal": [90.2, 100, 89, 90, 82, 32, 86.7],
    "golden-too-big": [0, 0, 0, 58, 12, 88, 15.4],
    "golden-sparse": [35, 30, 50, 45, 0, 50, 34.4],
    "golden-dormant": [79, 10, 76, 45, 0, 2, 42.2],
}


def test_golden_scores(spark):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows = [tuple((BASE | case | {"id": k, "pos": n}).get(c) for c in names) for n, (k, case) in enumerate(CASES.items())]
    got = {r["id"]: [*(r[f"f_{k}"]["score"] for k in FACTORS), r["score"]] for r in score_table(nest(spark.createDataFrame(rows, COLUMNS)), 2026).collect()}
    assert got.keys() == EXPECTED.keys()
    for k, want in EXPECTED.items():
        assert got[k] == pytest.approx(want, abs=0.05), k

import __spark_entry__
from bizfit.sources import readers

REGISTER = (
    "pos long, LicenseNumber string, BusinessName string, BusinessType string, City string, State string, `ZIP Code` string, County string, PhoneNumber string, IssueDate string, "
    "`Classification(s)` string, WorkersCompCoverageType string"
)


def licence(pos, number, name="Acme", classes="C36", cover=None, issued="05/23/1987"):
    return (pos, number, name, "Corporation", "LOS ANGELES", "CA", "900011234", "Los Angeles", None, issued, classes, cover)


def test_register(spark):
    rows = [
        licence(1, "10", cover="Workers' Compensation Insurance"), licence(2, "10", name="Later"), licence(3, None), licence(4, "11", classes="B"), licence(5, "12", classes="B | C36", cover="Exempt"),
        licence(6, "13", name=" "), licence(7, "14", classes="C-10/C20", issued="13/45/2001"), licence(8, "15", classes=None),
    ]
    got = readers.licence_to_company(readers.licence_load(spark.createDataFrame(rows, REGISTER))).collect()
    assert {(r["id"], r["name"], r["industry"], r["has_employees"], r["founded_year"], r["postcode"]) for r in got} == {
        ("cslb:10", "Acme", "Plumbing", True, 1987, "90001"), ("cslb:12", "Acme", "Plumbing", False, 1987, "90001"), ("cslb:14", "Acme", "Electrical", None, None, "90001"),
    }


def test_scope(spark):
    rows = spark.createDataFrame([("a", "ca", "Orange", "Pasadena "), ("b", "CA", "Orange", None), ("c", "NV", "Clark", "PASADENA")], "id string, state string, county string, city string")
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(readers.market_scope(rows)) == {"a", "b", "c"}
    assert ids(readers.market_scope(rows, "CA")) == {"a", "b"}
    assert ids(readers.market_scope(rows, "CA", ["ORANGE"], ["pasadena"])) == {"a"}


def test_principals(spark):
    rows = [(1, "9", "  ", "Owner"), (2, "9", "SMITH JOHN  Q", "Officer | Sole Owner"), (3, "9", "LATER", None), (4, "8", "O'NEIL", " | "), (5, None, "X", "Y")]
    got = readers.principal_best(spark.createDataFrame(rows, "pos long, `LIC-NO` string, Name string, `EMP-Titl-CDE` string"))
    assert {tuple(r) for r in got.select("licence_number", "person", "person_title").collect()} == {("9", "John Q Smith", "Sole Owner"), ("8", "O'Neil", None)}


def test_leads(spark):
    rows = spark.createDataFrame([(0, "Acme", "Other", "x.com", "11-50", "$5.2M"), (1, " ", None, None, None, None)], "pos long, `Company Name` string, Business string, Website string, Employees string, `Estimated Revenue` string")
    kept, report = readers.lead_list(rows, 2026)
    assert [tuple(r) for r in kept.select("id", "name", "website", "employee_count", "revenue_usd").collect()] == [("import:0", "Acme", "https://x.com", 50, 5.2e6)]
    assert tuple(report.first()) == (1, 1, "Business")


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Short values, other characters, and values after a name that is a candidate itself."""

from bizfit.llm.secrets import candidates, scan

SCHEMA = "doc_id long, text string, source string"
TEXTS = {
    1: ('password = "Tr0ub4dor3x"', "Tr0ub4dor3x"),
    2: ("password: 'hunter2Secret!9' and more", "hunter2Secret!9"),
    3: ('passwd="p@ssw0rd-Long$ecret1"', "p@ssw0rd-Long$ecret1"),
    4: ('awsSecretAccessKey = "wJalrXUtnFEMIK7MDENGbPxRfiCY"', "wJalrXUtnFEMIK7MDENGbPxRfiCY"),
    5: ('clientSecretValue: "zX81kQ9vLm27TtRw55Ye"', "zX81kQ9vLm27TtRw55Ye"),
    6: ("API_TOKEN=abc123x next", "abc123x"),
}


def test_values_assigned_to_credentials_are_candidates(spark):
    docs = spark.createDataFrame([(k, f"some words\n{t}", "src/app.py") for k, (t, _) in TEXTS.items()], SCHEMA)
    rows = candidates(docs).collect()
    found = {(r["doc_id"], r["candidate"]): r["before"] for r in rows}
    assert {(k, v) for k, (_, v) in TEXTS.items()} <= set(found) and len(rows) == len(found)
    assert found[4, TEXTS[4][1]].endswith('awsSecretAccessKey = "')
    out = {(r["doc_id"], r["candidate"]): r["probability"] for r in scan(docs).collect()}
    assert all(out[k, v] > 0.5 for k, (_, v) in TEXTS.items())

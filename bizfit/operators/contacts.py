"""Contact verdicts: e-mail syntax and mail facts, phone numbers.

E-mail syntax is one regular expression over the usual address form; quoted local
parts and internationalised domains are called malformed. Phones follow the North
American plan only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizfit.functions import columns as C
from bizfit.operators.score import ROLES

# Fixed values.
DISPOSABLE = [
    "mailinator.com", "guerrillamail.com", "10minutemail.com", "tempmail.com", "throwawaymail.com", "yopmail.com", "trashmail.com", "sharklasers.com",
    "getnada.com", "temp-mail.org", "fakeinbox.com", "maildrop.cc", "dispostable.com", "mailnesia.com", "spamgourmet.com", "mytemp.email",
]
FREE_MAIL = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "me.com", "msn.com", "live.com", "comcast.net", "sbcglobal.net",
    "verizon.net", "att.net", "protonmail.com",
]
SYNTAX = r"^[a-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*@([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z][a-z0-9-]*[a-z0-9]$"


def email_verdicts(emails: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds email_normalised, status, is_role, is_free_mail and reasons to rows with ``email``.

    ``facts`` has a row per domain: mx_hosts (null: the lookup failed, empty: none)
    and exists. A domain not in it counts as a failed lookup.
    """
    rows = emails.withColumn("email_normalised", F.lower(F.trim("email")))
    rows = rows.withColumn("_domain", F.substring_index("email_normalised", "@", -1)).join(facts.toDF("_domain", "_mx", "_exists"), "_domain", "left")
    bad = ~F.coalesce(F.col("email_normalised").rlike(SYNTAX), F.lit(False))
    throwaway, none = F.col("_domain").isin(DISPOSABLE), F.size("_mx") == 0
    role, free = F.substring_index("email_normalised", "@", 1).isin(ROLES) & ~bad, F.col("_domain").isin(FREE_MAIL) & ~bad
    status = (
        F.when(bad, "invalid").when(throwaway, "risky").when(F.col("_mx").isNull(), "unknown")
        .when(none & (F.col("_exists") == False), "invalid").when(none, "risky").otherwise("verified")  # noqa: E712
    )
    say = [
        (bad, "malformed address"), (role, "shared role address"), (free, "consumer mailbox"), (~bad & throwaway, "disposable provider"),
        (~bad & ~throwaway & F.col("_mx").isNull(), "lookup did not complete"), (~bad & ~throwaway & none & (F.col("_exists") == False), "domain does not resolve"),  # noqa: E712
        (~bad & ~throwaway & none & F.coalesce(F.col("_exists"), F.lit(True)), "no mail exchanger"), (~bad & ~throwaway & (F.size("_mx") > 0), "domain accepts mail"),
    ]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), t) for c, t in say]))
    return rows.withColumns({"status": status, "is_role": role, "is_free_mail": free, "reasons": reasons}).drop("_domain", "_mx", "_exists")


def phones(rows: DataFrame) -> DataFrame:
    """Adds phone_e164 (null if impossible) and phone_ok."""
    e164, ok = C.phone_e164(F.col("phone"))
    return rows.withColumns({"phone_e164": e164, "phone_ok": F.coalesce(ok, F.lit(False))})


def flat_contacts(companies: DataFrame) -> DataFrame:
    """S8 (down): a row per contact with its place."""
    return companies.select("id", F.posexplode("contacts").alias("place", "c")).select("id", "place", "c.*")


def nest_contacts(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """S8 (up): contacts[] in order of place; companies without any get an empty array."""
    fields = [c for c in contacts.columns if c not in ("id", "place")]
    rows = contacts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", F.struct(*fields).alias("c")))).alias("_cs"))
    rows = rows.select("id", F.transform("_cs", lambda x: x["c"]).alias("_cs"))
    kept = companies.join(rows, "id", "left")
    return kept.withColumn("contacts", F.coalesce("_cs", F.slice("contacts", F.lit(1), F.lit(0)))).drop("_cs")


def validate_contacts(companies: DataFrame, facts: DataFrame) -> DataFrame:
    """Every contact's e-mail status and phone checked; a phone that can't be parsed keeps its spelling."""
    flat = phones(email_verdicts(flat_contacts(companies), facts))
    fixed = flat.select(
        "id", "place", "name", "title", F.when(F.col("email").isNull(), None).otherwise(F.col("email_normalised")).alias("email"),
        F.when(F.coalesce("email", F.lit("")) == "", F.lit("unknown")).otherwise(F.col("status")).alias("email_status"), F.coalesce("phone_e164", "phone").alias("phone"),
        F.when(F.col("phone").isNotNull(), F.col("phone_ok")).alias("phone_valid"), "linkedin_url", "is_decision_maker",
    )
    return nest_contacts(companies, fixed)

"""Queries over the driver's tables, named by the blueprint's operator ids, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizfit.functions import columns as C
from bizfit.operators import annotate, contacts, match, pages, score, search, sinks, store
from bizfit.operators.shared import cut, fresh_path
from bizfit.plans.demo import AS_OF_YEAR, FLAT, PAGES, companies, flat, nest
from bizfit.plans.demo import pages as demo_pages
from bizfit.streaming.refresh import refreshes, stream_history

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


HOST = r"nullif(regexp_replace(regexp_replace(split_part(string_split(regexp_extract(regexp_replace(lower(trim({0})), '^[^/?#]*?://', ''), '^([^/?#]*)', 1), '@')[-1], ':', 1), '^[./]+|[./]+$', '', 'g'), '^www\.', ''), '')"
PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[&+]', ' and ', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
KEYS = f"""
WITH f AS ({FLAT}), h AS (SELECT *, {HOST.format('website')} AS key_domain, {PLAIN} AS plain, CASE WHEN contains(email, '@') THEN {HOST.format("string_split(email, '@')[-1]")} END AS key_email_domain FROM f),
k AS (SELECT *, CASE WHEN array_to_string(string_split(key_domain, '.')[-2:], '.') IN ({_in(C.COMPOUND_SUFFIXES)}) THEN array_to_string(string_split(key_domain, '.')[-3:], '.')
                ELSE array_to_string(string_split(key_domain, '.')[-2:], '.') END AS key_reg_domain,
        coalesce(nullif(array_to_string([t for t in string_split(plain, ' ') if t NOT IN ({_in(C.LEGAL_SUFFIXES + C.NOISE_WORDS)})], ' '), ''), plain) AS key_name FROM h),
n AS (SELECT *, left(split_part(key_name, ' ', 1), 4) AS key_block_name,
        CASE WHEN length(regexp_replace(postcode, '\\D', '', 'g')) >= 5 THEN left(regexp_replace(postcode, '\\D', '', 'g'), 5) END AS key_postcode,
        CASE WHEN length(regexp_replace(phone, '\\D', '', 'g')) >= 10 THEN right(regexp_replace(phone, '\\D', '', 'g'), 10) END AS key_phone10 FROM k)
"""
for _id, _key in (("N1_key_domain", "key_domain"), ("N2_key_reg_domain", "key_reg_domain"), ("N3_key_name", "key_name"), ("N4_key_block_name", "key_block_name"), ("N5_key_postcode", "key_postcode")):
    query(_id, f"{KEYS} SELECT id, {_key} FROM n")(lambda s, d, k=_key: match.standardise(companies(s, d)).select("id", k))
query("N6_key_email_domain", f"{KEYS} SELECT id, key_email_domain FROM n")(lambda s, d: flat(s, d).select("id", C.email_domain(F.col("email")).alias("key_email_domain")))
query("N7_key_phone10", f"{KEYS} SELECT id, key_phone10 FROM n")(lambda s, d: flat(s, d).select("id", C.phone10(F.col("phone")).alias("key_phone10")))
query("N8_display_name", f"SELECT id, array_to_string(list_transform(string_split(upper(name), ' '), lambda w: CASE WHEN w = 'LLC' THEN w ELSE w[1] || lower(w[2:]) END), ' ') AS display_name FROM ({FLAT})")(lambda s, d: flat(s, d).select("id", C.display_name(F.upper("name")).alias("display_name")))

BLOCKS = f"""{KEYS}, b AS (
  SELECT pos, unnest(list_distinct(list_filter([
    'd:' || key_reg_domain, 'n:' || lower(key_block_name || ':' || key_postcode), 'n:' || lower(key_block_name || ':' || city), 'p:' || key_phone10,
    CASE WHEN key_email_domain LIKE '%.%' AND key_email_domain IS DISTINCT FROM key_reg_domain THEN 'e:' || key_email_domain END], lambda x: x IS NOT NULL))) AS block FROM n),
z AS (SELECT block, count(*) AS members FROM b GROUP BY block)"""
HAVERSINE = """CASE WHEN {a}.latitude IS NULL OR {a}.longitude IS NULL OR {b}.latitude IS NULL OR {b}.longitude IS NULL THEN NULL ELSE 2 * 6371.0 * asin(sqrt(least(1.0,
  pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2)))) END"""
PAIRS = f"{BLOCKS}, c AS (SELECT DISTINCT x.pos AS a, y.pos AS b FROM b x JOIN b y USING (block) JOIN z USING (block) WHERE members BETWEEN 2 AND 50 AND x.pos < y.pos)"


def _blocked(s: SparkSession, d: str) -> DataFrame:
    return match.blocked(companies(s, d))


query("D1_blocking_keys", f"{BLOCKS} SELECT pos, block FROM b")(lambda s, d: _blocked(s, d).select("pos", F.explode("block_keys").alias("block")))
query("D2_block_sizes", f"{BLOCKS} SELECT block, members FROM z")(lambda s, d: match.block_sizes(_blocked(s, d)))
query("J4_block_pairs", f"{PAIRS} SELECT a, b FROM c")(lambda s, d: match.candidate_pairs(_blocked(s, d)))


#: Pairs that no distance rules out: one without coordinates is never ruled out.
NEAR = f"{PAIRS}, near AS (SELECT a, b FROM c JOIN f p ON p.pos = a JOIN f q ON q.pos = b WHERE p.latitude IS NULL OR p.longitude IS NULL OR q.latitude IS NULL OR q.longitude IS NULL OR {HAVERSINE.format(a='p', b='q')} <= 0.75)"


@query("D3_geo_guard", f"{NEAR} SELECT a, b FROM near")
def geo_guard(s: SparkSession, d: str) -> DataFrame:
    rows = _blocked(s, d)
    side = lambda p: rows.select(F.col("pos").alias(p), F.col("latitude").alias(f"la_{p}"), F.col("longitude").alias(f"lo_{p}"))
    far = C.haversine_km(F.col("la_a"), F.col("lo_a"), F.col("la_b"), F.col("lo_b")) > match.SAME_PREMISES_KM
    return match.candidate_pairs(rows).join(side("a"), "a").join(side("b"), "b").filter(~F.coalesce(far, F.lit(False))).select("a", "b")


#: 100 * 2 * LCS / (length a + length b) of the sorted tokens: the table of common subsequences is filled a character of x a step.
VERDICTS = f"""{NEAR.replace("WITH f AS", "WITH RECURSIVE f AS", 1)},
w AS (SELECT a, b, array_to_string(list_sort(string_split(p.key_name, ' ')), ' ') AS x, array_to_string(list_sort(string_split(q.key_name, ' ')), ' ') AS y,
  p.key_reg_domain AS da, q.key_reg_domain AS db, p.key_postcode AS za, q.key_postcode AS zb, p.city AS ca, q.city AS cb FROM near JOIN n p ON p.pos = a JOIN n q ON q.pos = b),
t AS (SELECT DISTINCT x, y FROM w),
lcs(x, y, i, line) AS (SELECT x, y, 0, list_transform(range(length(y) + 1), lambda j: 0) FROM t
  UNION ALL SELECT x, y, i + 1, list_transform(range(length(y) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE list_max(list_transform(range(1, j + 1), lambda k: greatest(line[k + 1], line[k] + CAST(x[i + 1] = y[k] AS INT)))) END)
  FROM lcs WHERE i < length(x)),
v AS (SELECT w.*, CASE WHEN x = '' AND y = '' THEN 100e0 ELSE 200e0 * list_max(line) / (length(x) + length(y)) END AS similarity FROM w JOIN lcs USING (x, y) WHERE i = length(x)),
judged AS (SELECT a, b, similarity, CASE WHEN da = db AND similarity >= 60 THEN 'same domain (' || da || ')' WHEN similarity >= 90 THEN 'near-identical name'
  WHEN similarity >= 80 AND za = zb THEN 'similar name at the same postcode (' || za || ')' WHEN similarity >= 80 AND lower(ca) = lower(cb) AND ca <> '' THEN 'similar name in the same city (' || ca || ')' END AS reason FROM v),
accepted AS (SELECT * FROM judged WHERE reason IS NOT NULL)"""
query("D5_pair_verdict", f"{VERDICTS} SELECT a, b, similarity, reason FROM accepted")(lambda s, d: match.judged_pairs(_blocked(s, d)))
query("D4_name_similarity", f"{VERDICTS} SELECT a, b, similarity FROM accepted")(lambda s, d: match.judged_pairs(_blocked(s, d)).select("a", "b", "similarity"))
COMPLETE = "(CASE WHEN coalesce(email, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(phone, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(contact_name, '') <> '' THEN 1 ELSE 0 END)"


@query("D6_completeness", f"SELECT id, {COMPLETE} AS contact_fields, CAST(crawled AS INT) AS crawled, CAST(website IS NOT NULL AS INT) + 3 + CAST(founded_year IS NOT NULL AS INT) + CAST(employee_count IS NOT NULL AS INT) AS fields FROM ({FLAT})")
def completeness(s: SparkSession, d: str) -> DataFrame:
    return companies(s, d).select("id", match.completeness().alias("k")).select("id", "k.*")


#: Links that need no similarity: rows with one phone number and one registrable domain.
SAME = f"{KEYS}, e AS (SELECT pos AS a, min(pos) OVER (PARTITION BY key_phone10, city) AS b FROM n WHERE key_phone10 IS NOT NULL UNION ALL SELECT pos, min(pos) OVER (PARTITION BY key_reg_domain, city) FROM n WHERE key_reg_domain IS NOT NULL)"


@query("D7_components", f"""WITH RECURSIVE e0 AS (SELECT * FROM ({SAME} SELECT a, b FROM e WHERE a <> b)), g AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
r(node, seen) AS (SELECT a, a FROM g UNION SELECT r.node, g.b FROM r JOIN g ON r.seen = g.a) SELECT node, min(seen) AS component FROM r GROUP BY node""")  # fmt: skip
def components(s: SparkSession, d: str) -> DataFrame:
    keyed = match.standardise(companies(s, d)).withColumn("phone10", C.phone10(F.get("contacts", F.lit(0))["phone"]))
    link = lambda k: keyed.filter(F.col(k).isNotNull()).select(F.col("pos").alias("a"), F.min("pos").over(Window.partitionBy(k, "city")).alias("b"))
    return match.connected_components(link("phone10").unionByName(link("key_reg_domain")), "a", "b", within_tasks=True)


#: Components of the accepted pairs, and each component's members with the order in which they are preferred.
GROUPED = f"""{VERDICTS}, g AS (SELECT a, b FROM accepted UNION SELECT b, a FROM accepted), r(node, seen) AS (SELECT a, a FROM g UNION SELECT r.node, g.b FROM r JOIN g ON r.seen = g.a),
m AS (SELECT node AS pos, min(seen) AS grp FROM r GROUP BY node),
k AS (SELECT f.*, m.grp, row_number() OVER (PARTITION BY m.grp ORDER BY {COMPLETE} DESC, CAST(crawled AS INT) DESC,
  CAST(website IS NOT NULL AS INT) + CAST(founded_year IS NOT NULL AS INT) + CAST(employee_count IS NOT NULL AS INT) DESC, f.pos) AS turn FROM m JOIN f ON f.pos = m.pos)"""
SURVIVORS = f"""{GROUPED.replace("k AS (SELECT f.*", "k0 AS (SELECT f.*", 1)}, top AS (SELECT * FROM k0 WHERE turn = 1),
given AS (SELECT grp, arg_min(website, pos) FILTER (WHERE website IS NOT NULL) AS site, arg_min(founded_year, pos) FILTER (WHERE founded_year IS NOT NULL) AS founded,
  arg_min({{'a': latitude, 'b': longitude}}, pos) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS place, max(CAST(has_contact AS INT)) AS contacts,
  arg_min(employee_count, pos) FILTER (WHERE employee_count IS NOT NULL) AS staff, arg_min(revenue_usd, pos) FILTER (WHERE revenue_usd IS NOT NULL) AS sales, arg_min(peer_count_in_niche, pos) FILTER (WHERE peer_count_in_niche IS NOT NULL) AS peers,
  arg_min({{'y': latest_content_year, 'b': page_bytes}}, pos) FILTER (WHERE crawled) AS page, arg_min({{'n': contact_name, 'e': email, 'p': phone}}, pos) FILTER (WHERE has_contact) AS person FROM k0 GROUP BY grp)
SELECT id, pos, name, coalesce(website, site) AS website, industry, city, state, postcode, coalesce(founded_year, founded) AS founded_year, coalesce(employee_count, staff) AS employee_count, coalesce(revenue_usd, sales) AS revenue_usd,
  coalesce(peer_count_in_niche, peers) AS peer_count_in_niche, coalesce(latitude, place.a) AS latitude, coalesce(longitude, place.b) AS longitude, contacts AS n_contacts, CASE WHEN has_contact THEN contact_name ELSE person.n END AS contact_name,
  CASE WHEN has_contact THEN email ELSE person.e END AS email, CASE WHEN has_contact THEN phone ELSE person.p END AS phone, CASE WHEN crawled THEN latest_content_year ELSE page.y END AS latest_content_year, CASE WHEN crawled THEN page_bytes ELSE page.b END AS page_bytes
  FROM top JOIN given USING (grp)
UNION ALL SELECT id, pos, name, website, industry, city, state, postcode, founded_year, employee_count, revenue_usd, peer_count_in_niche, latitude, longitude, CAST(has_contact AS INT), contact_name, email, phone, latest_content_year, page_bytes FROM f WHERE pos NOT IN (SELECT pos FROM m)"""


@query("D8_survivorship", SURVIVORS)
def survivorship(s: SparkSession, d: str) -> DataFrame:
    rows = match.dedupe(companies(s, d))[0]
    first = F.get("contacts", F.lit(0))
    columns = ["id", "pos", "name", "website", "industry", "city", "state", "postcode", "founded_year", "employee_count", "revenue_usd", "peer_count_in_niche", "latitude", "longitude"]
    return rows.select(*columns, F.size("contacts").alias("n_contacts"), first["name"].alias("contact_name"), first["email"].alias("email"), first["phone"].alias("phone"), "web.latest_content_year", "web.page_bytes")


AUDIT = f"""{GROUPED.replace("k AS (SELECT f.*", "k0 AS (SELECT f.*", 1)}, links AS (SELECT a AS pos, similarity, reason FROM accepted UNION ALL SELECT b, similarity, reason FROM accepted),
why AS (SELECT pos, similarity, reason FROM links QUALIFY row_number() OVER (PARTITION BY pos ORDER BY similarity DESC, reason DESC) = 1)
SELECT t.id AS kept_id, k0.id AS dropped_id, reason, round(similarity, 1) AS similarity FROM k0 JOIN k0 t ON t.grp = k0.grp AND t.turn = 1 JOIN why ON why.pos = k0.pos WHERE k0.turn > 1"""
query("D9_match_audit", AUDIT)(lambda s, d: match.dedupe(companies(s, d))[1])

# ---- merge and joins ----
SPLIT = f"{KEYS}, p AS (SELECT *, coalesce(upper(trim(city)), '') AS kc FROM n WHERE pos % 2 = 0), s AS (SELECT *, coalesce(upper(trim(city)), '') AS kc FROM n WHERE pos % 2 = 1), first AS (SELECT key_name, kc, min(pos) AS pos FROM p GROUP BY ALL)"


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = companies(s, d).withColumn("name", F.regexp_replace("name", r" \d+", ""))
    return rows.filter("pos % 2 = 0"), rows.filter("pos % 2 = 1")


MERGED = SPLIT.replace(f"({FLAT})", f"(SELECT * REPLACE (regexp_replace(name, ' \\d+', '') AS name) FROM ({FLAT}))", 1)
MERGED += """, gives AS (SELECT key_name, kc, arg_min(nullif(trim(website), ''), pos) FILTER (WHERE nullif(trim(website), '') IS NOT NULL) AS site,
  arg_min({'a': latitude, 'b': longitude}, pos) FILTER (WHERE latitude IS NOT NULL) AS place, count(*) AS k FROM s GROUP BY ALL)"""


@query("J1_merge_sources", MERGED + """ SELECT p.id, coalesce(p.website, CASE WHEN first.pos IS NOT NULL THEN site END) AS website, coalesce(p.latitude, CASE WHEN first.pos IS NOT NULL THEN place.a END) AS latitude,
  CASE WHEN first.pos IS NOT NULL THEN coalesce(k, 0) ELSE 0 END AS enriched_by FROM p LEFT JOIN first ON p.pos = first.pos LEFT JOIN gives ON gives.key_name = p.key_name AND gives.kc = p.kc
  UNION ALL SELECT s.id, website, latitude, 0 FROM s ANTI JOIN first USING (key_name, kc)""")  # fmt: skip
def merge_sources(s: SparkSession, d: str) -> DataFrame:
    return match.merge_sources(*_halves(s, d)).select("id", "website", "latitude", "enriched_by")


@query("J2_merge_unmatched", MERGED + " SELECT s.id FROM s ANTI JOIN first USING (key_name, kc)")
def merge_unmatched(s: SparkSession, d: str) -> DataFrame:
    return match.merge_sources(*_halves(s, d)).filter("pos % 2 = 1").select("id")


query("U1_union_sources", f"SELECT id FROM ({FLAT})")(lambda s, d: match.merge_sources(*[companies(s, d).filter(f"pos % 2 = {k}").withColumn("name", F.col("id")) for k in (0, 1)]).select("id"))


@query("J3_attach_principal", f"SELECT id, CASE WHEN has_contact AND pos % 3 = 0 THEN 'Person ' || CAST(pos AS STRING) ELSE contact_name END AS contact_name FROM ({FLAT})")
def attach_principal(s: SparkSession, d: str) -> DataFrame:
    rows = companies(s, d).withColumn("licence_number", F.col("pos").cast("string"))
    people = rows.filter("pos % 3 = 0").select("licence_number", F.concat(F.lit("Person "), "licence_number").alias("person"), F.lit("Owner").alias("person_title"))
    return match.attach_principal(rows, people).select("id", F.get("contacts", F.lit(0))["name"].alias("contact_name"))


@query("J9_select_ids", f"SELECT id FROM ({FLAT}) WHERE 'cust:' || CAST(pos AS STRING) IN (SELECT 'cust:' || CAST(o_custkey AS STRING) FROM orders)")
def select_ids(s: SparkSession, d: str) -> DataFrame:
    ids = s.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("id"))
    return search.select_ids(companies(s, d), ids).select("id")


@query("J10_overlay_refreshed", f"""WITH n AS (SELECT 'cust:' || CAST(o_custkey AS STRING) AS id, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1)
SELECT f.id, coalesce(n.v, f.revenue_usd) AS revenue_usd FROM ({FLAT}) f LEFT JOIN n USING (id)""")  # fmt: skip
def overlay(s: SparkSession, d: str) -> DataFrame:
    new = s.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_totalprice").alias("revenue_usd"), "o_orderkey")
    return search.overlay(flat(s, d).select("id", "revenue_usd"), new, "o_orderkey")


HISTORY = "SELECT o_custkey AS company_id, o_orderkey AS score_id, o_orderdate AS scored_at FROM orders SEMI JOIN customer ON o_custkey = c_custkey"


@query("J12_history_join", HISTORY)
@query("W6_history_newest", HISTORY)
def history(s: SparkSession, d: str) -> DataFrame:
    scores = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("score_id"), F.col("o_orderdate").alias("scored_at"))
    return search.history(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id")), scores)


# ---- neighbourhood, quality ----
@query("J5_peers_radius", f"WITH f AS ({FLAT}) SELECT x.id, count(y.id) - 1 AS peers FROM f x JOIN f y ON x.industry = y.industry AND {HAVERSINE.format(a='x', b='y')} <= 15 WHERE x.latitude IS NOT NULL AND y.latitude IS NOT NULL GROUP BY x.id")
def peers_radius(s: SparkSession, d: str) -> DataFrame:
    rows = companies(s, d)
    return rows.join(annotate.radius_counts(rows, "industry"), ["industry", "latitude", "longitude"]).select("id", (F.col("within") - 1).alias("peers"))


PEERS = f"""WITH f AS ({FLAT}), g AS (SELECT x.id, count(y.id) - 1 AS peers FROM f x JOIN f y ON x.industry = y.industry AND {HAVERSINE.format(a='x', b='y')} <= 15 WHERE x.latitude IS NOT NULL AND y.latitude IS NOT NULL GROUP BY x.id)
SELECT f.id, coalesce(g.peers, count(*) OVER (PARTITION BY industry, postcode) - 1) AS peer_count_in_niche FROM f LEFT JOIN g USING (id)"""
query("A1_peer_density", PEERS)(lambda s, d: annotate.peer_density(companies(s, d)).select("id", "peer_count_in_niche"))


@query("A9_peers_unmeasured", f"SELECT count(*) FILTER (WHERE pos % 10 = 0 OR pos % 6 = 0 AND latitude IS NULL) AS unmeasured FROM ({FLAT})")
def peers_unmeasured(s: SparkSession, d: str) -> DataFrame:
    """Over companies some of which have no industry, or neither coordinates nor a postcode."""
    lost = {"industry": F.when(F.expr("pos % 10 <> 0"), F.col("industry")), "postcode": F.when(F.expr("pos % 6 <> 0"), F.col("postcode")), "peer_count_in_niche": F.lit(None).cast("long")}
    return annotate.peers_unmeasured(annotate.peer_density(companies(s, d).withColumns(lost)))


CHAINS = f"{KEYS}, c AS (SELECT key_name, count(DISTINCT CASE WHEN latitude IS NOT NULL THEN CAST(round(latitude, 3) AS STRING) || ',' || CAST(round(longitude, 3) AS STRING) ELSE id END) AS k FROM n GROUP BY 1) SELECT id, k AS sibling_location_count FROM n JOIN c USING (key_name)"
query("A2_chain_locations", CHAINS)(lambda s, d: annotate.chain_locations(companies(s, d)).select("id", "sibling_location_count"))
query("A3_chain_flag_count", f"SELECT count(*) FILTER (WHERE sibling_location_count >= 3) AS in_chains FROM ({CHAINS})")(lambda s, d: annotate.chain_flag_count(annotate.chain_locations(companies(s, d))))
CHECKS = [
    (0.20, "no phone number", "coalesce(phone, '') <> ''"), (0.10, "phone not validated", "coalesce(phone_valid, FALSE)"), (0.15, "no email address", "coalesce(email, '') <> ''"),
    (0.10, "email unverified", "coalesce(email_status = 'verified', FALSE)"), (0.15, "no named owner", "is_decision_maker AND contact_name IS NOT NULL"), (0.10, "no website", "website IS NOT NULL"),
    (0.05, "website not crawled", "crawled"), (0.05, "no ownership form", "business_type IS NOT NULL"), (0.05, "no founding or licence date", "founded_year IS NOT NULL"), (0.05, "no postcode or coordinates", "TRUE"),
]
_gaps = ", ".join(f"CASE WHEN NOT ({c}) THEN '{g}' END" for w, g, c in sorted(CHECKS, key=lambda x: -x[0]))
QUALITY = f"SELECT id, round(({' + '.join(['0e0'] + [f'CASE WHEN {c} THEN {w}e0 ELSE 0e0 END' for w, _, c in CHECKS])}) * 100, 1) AS data_quality, concat_ws('|', {_gaps}) AS gaps FROM ({FLAT})"
query("A4_quality", QUALITY)(lambda s, d: annotate.quality(companies(s, d)).select("id", "data_quality", F.array_join("quality_issues", "|").alias("gaps")))


@query("A5_facets", f"SELECT count(*) AS companies, string_agg(DISTINCT industry, '|' ORDER BY industry) AS industry, string_agg(DISTINCT city, '|' ORDER BY city) AS city, string_agg(DISTINCT business_type, '|' ORDER BY business_type) AS business_type FROM ({FLAT})")
def facets(s: SparkSession, d: str) -> DataFrame:
    return annotate.facets(companies(s, d)).select("companies", *[F.array_join(c, "|").alias(c) for c in ("industry", "city", "business_type")])


def _nth(k: str, v: str) -> str:
    return f"max({v}) FILTER (WHERE r = {k})"


@query("A6_score_distribution", f"WITH q AS ({QUALITY}), o AS (SELECT data_quality AS v, row_number() OVER (ORDER BY data_quality) - 1 AS r, count(*) OVER () AS n FROM q) SELECT min(v) AS low, {_nth('n // 4', 'v')} AS quarter, {_nth('n // 2', 'v')} AS median, {_nth('3 * n // 4', 'v')} AS three_quarters, max(v) AS high FROM o")
def distribution(s: SparkSession, d: str) -> DataFrame:
    return annotate.order_statistics(annotate.quality(companies(s, d)), "data_quality")


query("A7_trade_counts", f"SELECT industry, count(*) AS companies FROM ({FLAT}) GROUP BY 1")(lambda s, d: annotate.trade_counts(companies(s, d)))
query("W1_first_sighting", f"SELECT city, min(pos) AS pos FROM ({FLAT}) GROUP BY 1")(lambda s, d: match.first_sighting(companies(s, d), "city").select("city", "pos"))
SAMPLED = f"""WITH f AS (SELECT id, pos, industry, website, website IS NOT NULL AS site FROM ({FLAT})), t AS (SELECT industry, count(*) AS n, count(website) AS sites, min(pos) AS first FROM f GROUP BY 1),
q AS (SELECT *, greatest(1, CAST(round_even(250e0 * n / sum(n) OVER (), 0) AS BIGINT)) AS quota, row_number() OVER (ORDER BY n DESC, first) AS turn FROM t), p AS (SELECT *, greatest(quota - sites, 0) AS rest FROM q),
k AS (SELECT f.*, quota, rest, turn, greatest(1, (n - sites) // nullif(rest, 0)) AS step, row_number() OVER (PARTITION BY f.industry, site ORDER BY pos) - 1 AS k FROM f JOIN p USING (industry)),
c AS (SELECT *, CASE WHEN site THEN k < quota ELSE coalesce(rest > 0 AND k % step = 0 AND k // step < rest, FALSE) END AS picked FROM k)
SELECT id, industry, website FROM c ORDER BY CASE WHEN picked THEN turn ELSE 1000000 END, CASE WHEN picked AND NOT site THEN 1 ELSE 0 END, pos LIMIT 250"""
query("W2_stratified_sample", SAMPLED)(lambda s, d: annotate.stratified_sample(companies(s, d), 250).select("id", "industry", "website"))

# ---- search ----
TERMS = [
    ("F1_search_terms", search.Filters(q="blue inc"), "contains(lower(name || '~' || city || '~' || industry), 'blue') AND contains(lower(name || '~' || city || '~' || industry), 'inc')"),
    ("F2_search_equals", search.Filters(industry="machinery", business_type="SOLE OWNER"), "lower(industry) = 'machinery' AND lower(business_type) = 'sole owner'"),
    ("F3_search_tristate", search.Filters(has_employees=False), "has_employees = FALSE"),
    ("F4_search_min_age", search.Filters(min_age=40), f"founded_year <= {AS_OF_YEAR - 40}"),
]
for _id, _f, _sql in TERMS:
    query(_id, f"SELECT id, name FROM ({FLAT}) WHERE {_sql}")(lambda s, d, f=_f: search.search(companies(s, d), f, AS_OF_YEAR).select("id", "name"))
query("F6_lookup_id", f"SELECT id, name FROM ({FLAT}) WHERE id = 'cust:7'")(lambda s, d: search.lookup(companies(s, d), "cust:7").select("id", "name"))

# ---- scores ----
TEXT = "coalesce(raw_text_excerpt, '') || ' ' || name"


def _hit(p: str) -> str:
    return f"regexp_matches(t, '(?i){p}')"


def _best(patterns) -> str:
    return "CASE " + " ".join(f"WHEN {_hit(p)} THEN {v}e0" for p, _, v in sorted(patterns, key=lambda x: -x[2])) + " END"


def _band(v: str, lo: float, hi: float) -> str:
    a, b = lo * 0.5, hi * 1.5
    return f"CASE WHEN {v} BETWEEN {lo}::DOUBLE AND {hi}::DOUBLE THEN 100e0 WHEN {v} <= {a}::DOUBLE OR {v} >= {b}::DOUBLE THEN 0e0 WHEN {v} < {lo}::DOUBLE THEN 100e0 * ({v} - {a}::DOUBLE) / {lo - a}::DOUBLE WHEN {v} > {hi}::DOUBLE THEN 100e0 * ({b}::DOUBLE - {v}) / {b - hi}::DOUBLE END"


def _add(c: str, v: str) -> str:
    return f"CASE WHEN {c} THEN {v} ELSE 0e0 END"


SITE = "website IS NOT NULL"
_flag = lambda c, v: f"{_add(f'{c} = FALSE', f'{v}e0')} + {_add(c, f'-{v / 2}e0')}"
SCORES = f"""
WITH f AS (SELECT *, {TEXT} AS t FROM ({FLAT})),
a AS (SELECT *, CASE lower(business_type) {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in score.FILED.items())} END AS filed, {_best(score.OWNERSHIP)} AS claim, {_best(score.TENURE)} AS told,
  {AS_OF_YEAR} - coalesce(founded_year, web_founded_year) AS age, {AS_OF_YEAR} - coalesce(latest_content_year, copyright_year) AS stale,
  {_band('employee_count::DOUBLE', 10, 100)} AS b1, {_band('revenue_usd', 1e6, 1e7)} AS b2, {' OR '.join(_hit(p) for p, _ in score.BACKED)} AS backed,
  regexp_matches(coalesce(contact_title, ''), '{score.DECISION}') AS chief FROM f),
b AS (SELECT *, CASE WHEN age >= 25 THEN least(24e0, 8e0 + (age - 25) * 0.6e0) END AS tenure, coalesce(filed >= coalesce(claim, -1e9), FALSE) AS by_filing, coalesce(age < 8, FALSE) AS young FROM a),
s AS (SELECT *,
  greatest(0e0, least(100e0, 35e0 + {_add('by_filing', 'filed')} + {_add('NOT by_filing AND claim IS NOT NULL', 'claim')} + {_add('young', '-18e0')}
    + {_add('NOT young AND tenure IS NOT NULL AND tenure >= coalesce(told, -1e9)', 'tenure')} + {_add('NOT young AND told IS NOT NULL AND coalesce(tenure < told, TRUE)', 'told')}
    + {_add('sibling_location_count >= 3', '-32e0')} + {_add('backed', '-45e0')} + {_add('is_decision_maker', '8e0')})) AS succession,
  CASE WHEN b1 IS NOT NULL OR b2 IS NOT NULL THEN (coalesce(b1, 0e0) + coalesce(b2, 0e0)) / (CAST(b1 IS NOT NULL AS INT) + CAST(b2 IS NOT NULL AS INT)) WHEN has_employees = FALSE THEN 12e0 WHEN has_employees THEN 55e0 ELSE 30e0 END AS buy_box,
  CASE WHEN {SITE} THEN greatest(0e0, least(100e0, 28e0 + {_flag('https', 11.0)} + {_flag('mobile_viewport', 13.0)} + {_flag('has_analytics', 9.0)} + {_add("lower(tech) IN ('frontpage', 'joomla')", '13e0')} + {_add("lower(tech) = 'next.js'", '-12e0')}
    + {_add('stale >= 2', 'least(15e0, 4e0 * stale)')} + {_add('stale < 2', '-8e0')})) ELSE 50e0 END AS digital_gap,
  CASE WHEN peer_count_in_niche IS NULL THEN 45e0 WHEN peer_count_in_niche <= 2 THEN 25e0 WHEN peer_count_in_niche <= 7 THEN 58e0 WHEN peer_count_in_niche <= 40 THEN 90e0 WHEN peer_count_in_niche <= 90 THEN 70e0 ELSE 45e0 END AS fragmentation,
  greatest(0e0, least(100e0, 0e0 + {_add('email IS NOT NULL', "CASE email_status WHEN 'verified' THEN CASE WHEN email LIKE 'info@%' THEN 20e0 ELSE 30e0 END WHEN 'risky' THEN 12e0 WHEN 'invalid' THEN -10e0 ELSE 8e0 END")}
    + {_add('phone IS NOT NULL', 'CASE WHEN phone_valid THEN 22e0 ELSE 10e0 END')} + {_add('contact_name IS NOT NULL AND chief', '30e0')} + {_add('contact_name IS NOT NULL AND NOT chief', '12e0')} + {_add('linkedin_url IS NOT NULL', '12e0')})) AS contactability,
  greatest(0e0, least(100e0, 50e0 + {_add('stale <= 1', '22e0')} + {_add('stale >= 4', '-28e0')} + {_add('has_careers_page', '16e0')} + {_add('has_team_page', '10e0')} + {_add('crawled AND page_bytes < 2000', '-20e0')})) AS health,
  by_filing OR claim IS NOT NULL OR young OR tenure IS NOT NULL OR told IS NOT NULL OR sibling_location_count >= 3 OR backed OR is_decision_maker AS m_succession,
  b1 IS NOT NULL OR b2 IS NOT NULL OR has_employees IS NOT NULL AS m_buy_box,
  {SITE} AND (https IS NOT NULL OR mobile_viewport IS NOT NULL OR has_analytics IS NOT NULL OR coalesce(lower(tech) IN ('frontpage', 'joomla', 'next.js'), FALSE) OR stale IS NOT NULL) AS m_digital_gap,
  peer_count_in_niche IS NOT NULL AS m_fragmentation,
  NOT has_contact OR email IS NOT NULL OR phone IS NOT NULL OR contact_name IS NOT NULL OR linkedin_url IS NOT NULL AS m_contactability,
  coalesce(stale <= 1, FALSE) OR coalesce(stale >= 4, FALSE) OR has_careers_page OR has_team_page OR coalesce(crawled AND page_bytes < 2000, FALSE) AS m_health
FROM b)"""
for _k in score.FACTORS:
    _id = {"succession": "E1a", "buy_box": "E1b", "digital_gap": "E1c", "fragmentation": "E1d", "contactability": "E1e", "health": "E1f"}[_k]
    query(f"{_id}_f_{_k}", f"{SCORES} SELECT id, {_k} AS factor_score, m_{_k} AS measured FROM s")(
        lambda s, d, k=_k: score.with_factors(companies(s, d), AS_OF_YEAR).select("id", F.col(f"f_{k}.score").alias("factor_score"), F.col(f"f_{k}.measured").alias("measured"))
    )


def _total_sql(weights: dict[str, str]) -> str:
    ks = score.FACTORS
    total = " + ".join(weights[k] for k in ks)
    w = ", ".join(f"CASE WHEN {total} > 0 THEN {weights[k]} / ({total}) ELSE {1 / 6!r}::DOUBLE END AS w_{k}" for k in ks)
    covered = " + ".join(f"CASE WHEN m_{k} THEN w_{k} ELSE 0e0 END" for k in ks)
    e = ", ".join(f"CASE WHEN covered < 0.25e0 THEN w_{k} WHEN m_{k} THEN w_{k} / covered ELSE 0e0 END AS e_{k}" for k in ks)
    raw = " + ".join(f"{k} * e_{k}" for k in ks)
    return f", w AS (SELECT *, {w} FROM v), c AS (SELECT *, {covered} AS covered FROM w), e AS (SELECT *, {e} FROM c), r AS (SELECT *, greatest(0e0, least(100e0, {raw})) AS score_raw FROM e)"


DEFAULT = _total_sql({k: f"{v}e0" for k, v in score.WEIGHTS.items()})
TOTAL = f"{SCORES}, v AS (SELECT * FROM s){DEFAULT}"


def scored(s: SparkSession, d: str) -> DataFrame:
    return score.score_table(companies(s, d), AS_OF_YEAR)


def totals(s: SparkSession, d: str) -> DataFrame:
    return score.score_table(companies(s, d), AS_OF_YEAR, explain=False)


query("E6_score_table", f"{TOTAL} SELECT id, score_raw, round(covered, 4) AS covered_weight FROM r")(lambda s, d: totals(s, d).select("id", "score_raw", "covered_weight"))
query("E4_total_score", f"{TOTAL} SELECT id, score_raw, {', '.join(f'{k} * e_{k} AS c_{k}' for k in score.FACTORS)} FROM r")(lambda s, d: totals(s, d).select("id", "score_raw", *[F.col("contributions")[k].alias(f"c_{k}") for k in score.FACTORS]))
query("E3_effective_weights", f"{TOTAL} SELECT id, {', '.join(f'e_{k}' for k in score.FACTORS)} FROM r")(lambda s, d: totals(s, d).select("id", *[F.col("effective_weights")[k].alias(f"e_{k}") for k in score.FACTORS]))
_n = lambda *cs: " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in cs)
_told = "(b1 IS NULL AND b2 IS NULL AND has_employees IS NOT NULL)"
_flags = ("https", "mobile_viewport", "has_analytics")
#: What each factor has found, and what it missed.
SIGNALS = {
    "succession": (
        _n("by_filing", "NOT by_filing AND claim IS NOT NULL", "young", "NOT young AND tenure IS NOT NULL AND tenure >= coalesce(told, -1e9)", "NOT young AND told IS NOT NULL AND coalesce(tenure < told, TRUE)", "sibling_location_count >= 3", "backed", "is_decision_maker"),
        _n("NOT by_filing AND claim IS NULL", "age IS NULL", "coalesce(raw_text_excerpt, '') = ''", "NOT coalesce(is_decision_maker, FALSE)"),
    ),
    "buy_box": (_n("b1 IS NOT NULL", "b2 IS NOT NULL", _told), _n(f"b1 IS NULL AND NOT {_told}", f"b2 IS NULL AND NOT {_told}", _told, _told)),
    "digital_gap": (
        _n(*[f"{SITE} AND {f} IS NOT NULL" for f in _flags], f"{SITE} AND lower(tech) IN ('frontpage', 'joomla', 'next.js')", f"{SITE} AND stale IS NOT NULL"),
        _n(*[f"{SITE} AND {f} IS NULL" for f in _flags], f"{SITE} AND tech IS NULL", f"{SITE} AND stale IS NULL", *[f"NOT ({SITE})"] * 3),
    ),
    "fragmentation": (_n("peer_count_in_niche IS NOT NULL"), _n("peer_count_in_niche IS NULL")),
    "contactability": (_n("email IS NOT NULL", "phone IS NOT NULL", "contact_name IS NOT NULL", "linkedin_url IS NOT NULL"), _n("email IS NULL", "phone IS NULL", "contact_name IS NULL")),
    "health": (_n("stale <= 1", "stale >= 4", "has_careers_page", "has_team_page", "crawled AND page_bytes < 2000"), _n("stale IS NULL", "NOT coalesce(has_careers_page, FALSE)", "NOT crawled")),
}
_sure = lambda found, missed: f"CASE WHEN ({found}) >= 2 AND ({found}) >= 0.66e0 * (({found}) + ({missed})) THEN 'high' WHEN ({found}) + ({missed}) > 0 AND ({found}) >= 0.34e0 * (({found}) + ({missed})) THEN 'medium' ELSE 'low' END"
CONFIDENCE = f"""{TOTAL}, y AS (SELECT *, {', '.join(f'{_sure(*SIGNALS[k])} AS conf_{k}' for k in score.FACTORS)} FROM r),
o AS (SELECT *, {' + '.join(f"CASE conf_{k} WHEN 'high' THEN 1e0 WHEN 'medium' THEN 0.55e0 ELSE 0.15e0 END * w_{k}" for k in score.FACTORS)} AS sure FROM y)"""
SURE = "CASE WHEN sure >= 0.7e0 THEN 'high' WHEN sure >= 0.4e0 THEN 'medium' ELSE 'low' END"
query("E5_overall_confidence", f"{CONFIDENCE} SELECT id, {SURE} AS confidence, {', '.join(f'conf_{k}' for k in score.FACTORS)} FROM o")(lambda s, d: scored(s, d).select("id", "confidence", *[F.col(f"f_{k}")["confidence"].alias(f"conf_{k}") for k in score.FACTORS]))
query("E1h_evidence_excerpt")(lambda s, d: scored(s, d).select("id", F.explode("f_succession.evidence").alias("e")).select("id", "e.*"))
query("E7_content_key")(lambda s, d: score.content_key(companies(s, d), AS_OF_YEAR).select("id", "cache_key"))
query("W3_rank_by_score", f"{TOTAL} SELECT id, score_raw, row_number() OVER (ORDER BY round(score_raw, 1) DESC, id) AS place FROM r")(lambda s, d: search.in_order(score.ranked(totals(s, d))).select("id", "score_raw", "place"))
query("F5_min_score", f"{TOTAL} SELECT id FROM r WHERE round(score_raw, 1) >= 60")(lambda s, d: search.min_score(totals(s, d), 60.0).select("id"))
query("W4_page_slice", f"{TOTAL} SELECT id, round(score_raw, 1) AS score, count(*) OVER () AS total FROM r ORDER BY score DESC, id LIMIT 20 OFFSET 20")(lambda s, d: search.page(totals(s, d), 20, 20).select("id", "score", "total"))
_natural = r"regexp_replace(regexp_replace(lower(name), '([0-9]+)', '000000000000000000\1', 'g'), '0+([0-9]{18})', '\1', 'g')"


@query("W4_deep_page", f"{TOTAL} SELECT id, round(score_raw, 1) AS score, row_number() OVER (ORDER BY round(score_raw, 1) DESC, id) AS place FROM r QUALIFY place BETWEEN 1001 AND 1050")
def deep_page(s: SparkSession, d: str) -> DataFrame:
    """A page far down a ranking that is kept in slabs of 200 places."""
    return search.keep_ranking(score.ranked(totals(s, d).select("id", "score")), fresh_path(s, "ranking"), 200).page(1000, 50)


query("W5_sort_modes", f"{TOTAL} SELECT id, name, round(score_raw, 1) AS score, row_number() OVER (ORDER BY {_natural}, round(score_raw, 1) DESC, id) AS place FROM r")(lambda s, d: search.in_order(search.sort_modes(totals(s, d), "name")).select("id", "name", "score", "place"))


@query("E8_rescore_changed", f"{TOTAL} SELECT id, score_raw FROM r WHERE pos % 3 = 0")
def rescore_changed(s: SparkSession, d: str) -> DataFrame:
    rows = companies(s, d)
    old = cut(score.content_key(rows.filter("pos % 3 <> 0"), AS_OF_YEAR).select("cache_key"), "score-keys")
    return score.rescore_changed(rows, old, AS_OF_YEAR).select("id", "score_raw")


#: The scenarios come from the orders: one weight vector per order priority.
VECTORS = "SELECT o_orderpriority AS scenario, " + ", ".join(f"avg(CAST(o_orderkey % {k + 3} AS DOUBLE)) AS x_{f}" for k, f in enumerate(score.FACTORS)) + " FROM {0} GROUP BY o_orderpriority"


@query("J11_scenario_cross", f"{SCORES}, x AS ({VECTORS.format('orders')}), v AS (SELECT * FROM s, x){_total_sql({k: f'x_{k}' for k in score.FACTORS})} SELECT scenario, id, round(score_raw, 6) AS score_raw FROM r")
def scenario_cross(s: SparkSession, d: str) -> DataFrame:
    vectors = s.sql(VECTORS.format("{o}"), o=s.read.parquet(f"{d}/orders.parquet")).toDF("scenario", *score.FACTORS)
    return score.what_if(score.with_factors(companies(s, d), AS_OF_YEAR), vectors).select("scenario", "id", F.round("score_raw", 6).alias("score_raw"))


@query("E2_weights_norm", f"WITH x AS ({VECTORS.format('orders')}) SELECT scenario, {', '.join(f'x_{k} / ({chr(43).join(f' x_{j} ' for j in score.FACTORS)}) AS w_{k}' for k in score.FACTORS)} FROM x")
def weights_norm(s: SparkSession, d: str) -> DataFrame:
    vectors = s.sql(VECTORS.format("{o}"), o=s.read.parquet(f"{d}/orders.parquet"))
    return vectors.select("scenario", *[v.alias(f"w_{k}") for k, v in score.normalised(lambda k: F.col(f"x_{k}")).items()])


@query("X5_what_if", f"""{SCORES}, x AS ({VECTORS.format('orders')}), v AS (SELECT * FROM s, x){_total_sql({k: f'x_{k}' for k in score.FACTORS})}
SELECT scenario, id, round(round(score_raw, 6), 1) AS score, row_number() OVER (PARTITION BY scenario ORDER BY round(round(score_raw, 6), 1) DESC, id) AS place FROM r""")  # fmt: skip
def what_if(s: SparkSession, d: str) -> DataFrame:
    rows = scenario_cross(s, d).withColumn("score", F.round("score_raw", 1))
    return score.places(rows.drop("score_raw"))


# ---- contacts ----
MAIL = f"'{pages.EMAIL}'"


@query("J6_mail_facts", f"""WITH e AS (SELECT id, lower(email) AS email, string_split(lower(email), '@')[-1] AS dom FROM ({FLAT}) WHERE email IS NOT NULL), k AS (SELECT *, length(dom) % 5 AS kind FROM e)
SELECT id, CASE WHEN contains(email, ' ') THEN 'invalid' WHEN dom = 'yopmail.com' THEN 'risky' WHEN kind = 0 THEN 'unknown' WHEN kind = 1 THEN 'invalid' WHEN kind = 2 THEN 'risky' ELSE 'verified' END AS status,
  email LIKE 'info@%' AS is_role FROM k""")  # fmt: skip
@query("C1_email_verdict", f"""WITH e AS (SELECT id, lower(email) AS email, split_part(lower(email), '@', 2) AS dom FROM ({FLAT}) WHERE email IS NOT NULL)
SELECT id, CASE WHEN contains(email, ' ') THEN 'invalid' WHEN dom = 'yopmail.com' THEN 'risky' ELSE list_extract(['unknown', 'invalid', 'risky', 'verified', 'verified'], CAST(length(dom) % 5 AS INT) + 1) END AS status,
  starts_with(email, 'info@') AS is_role FROM e""")  # fmt: skip
def email_verdict(s: SparkSession, d: str) -> DataFrame:
    return contacts.email_verdicts(flat(s, d).filter("email IS NOT NULL").select("id", "email"), mail_facts(s, d)).select("id", "status", "is_role")


def mail_facts(s: SparkSession, d: str) -> DataFrame:
    """What a lookup says of the demo's mail domains, by the length of their names: it fails, there is no such domain, no exchanger, one, or two."""
    dom = flat(s, d).filter("email IS NOT NULL").select(C.email_domain(F.col("email")).alias("domain")).filter("domain IS NOT NULL").distinct()
    kind, none = F.char_length("domain") % 5, F.array().cast("array<string>")
    mx = F.when(kind == 0, None).when(kind <= 2, none).when(kind == 3, F.array(F.lit("mx1"))).otherwise(F.array(F.lit("mx1"), F.lit("mx2")))
    return dom.select("domain", mx.alias("mx"), F.when(kind > 0, kind > 1).alias("exists"))


@query("C2_phone_e164", rf"WITH p AS (SELECT id, regexp_replace(phone, '\D', '', 'g') AS g FROM ({FLAT}) WHERE phone IS NOT NULL) SELECT id, CASE WHEN regexp_matches(g, '^1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}$') THEN '+1' || right(g, 10) END AS phone_e164 FROM p")
def phone_e164(s: SparkSession, d: str) -> DataFrame:
    return contacts.phones(flat(s, d).filter("phone IS NOT NULL")).select("id", "phone_e164")


@query("C3_validate_contacts", rf"""WITH e AS (SELECT *, lower(trim(email)) AS mail, split_part(lower(trim(email)), '@', 2) AS dom, regexp_replace(phone, '\D', '', 'g') AS g FROM ({FLAT}) WHERE has_contact),
p AS (SELECT *, regexp_matches(g, '^1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}$') AS ok FROM e)
SELECT id, 0 AS place, contact_name AS name, contact_title AS title, mail AS email, CASE WHEN mail IS NULL THEN 'unknown' WHEN contains(mail, ' ') THEN 'invalid' WHEN dom = 'yopmail.com' THEN 'risky'
  ELSE list_extract(['unknown', 'invalid', 'risky', 'verified', 'verified'], CAST(length(dom) % 5 AS INT) + 1) END AS email_status,
  CASE WHEN ok THEN '+1' || right(g, 10) ELSE phone END AS phone, CASE WHEN phone IS NOT NULL THEN ok END AS phone_valid, linkedin_url, is_decision_maker FROM p""")  # fmt: skip
def validate_contacts(s: SparkSession, d: str) -> DataFrame:
    return contacts.flat_contacts(contacts.validate_contacts(companies(s, d), mail_facts(s, d)))


@query("S8_assemble_nested", f"SELECT id, CAST(has_contact AS INT) AS n_contacts, email FROM ({FLAT})")
def assemble(s: SparkSession, d: str) -> DataFrame:
    rows = companies(s, d)
    return contacts.nest_contacts(rows, contacts.flat_contacts(rows)).select("id", F.size("contacts").alias("n_contacts"), F.get("contacts", F.lit(0))["email"].alias("email"))


# ---- pages ----
def _pages(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/pages.parquet")


def visible_sql(html: str, tags: tuple[str, ...] = ("script", "style", "noscript", "svg", "template")) -> str:
    """The visible text of an expression with markup."""
    for t in tags:
        html = rf"regexp_replace({html}, '(?is)<{t}\b.*?</{t}\s*>', ' ', 'g')"
    html = rf"regexp_replace(regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for e, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        html = f"replace({html}, '{e}', '{c}')"
    return rf"trim(regexp_replace({html}, '\s+', ' ', 'g'))"


VISIBLE = visible_sql("html")
query("P1_visible_text", f"SELECT page_id, {VISIBLE} AS visible_text FROM pages")(lambda s, d: _pages(s, d).select("page_id", pages.visible_text(F.col("html")).alias("visible_text")))
query("P6_excerpt", f"SELECT page_id, nullif(left({VISIBLE}, 6000), '') AS excerpt FROM pages")(lambda s, d: pages.page_signals(_pages(s, d), AS_OF_YEAR).select("page_id", F.col("web.raw_text_excerpt").alias("excerpt")))
_markers = " OR ".join(f"contains(lower(html), '{m.replace(chr(39), chr(39) * 2)}')" for m in pages.ANALYTICS)
query("P3_site_flags", f"""SELECT page_id, starts_with(lower(url), 'https://') AS https, {_markers} AS has_analytics, length(html) AS page_bytes, regexp_matches(lower(html), 'name=["'']?viewport') AS mobile_viewport,
  regexp_matches(lower(html), '{pages.CAREERS.replace("'", "''")}') AS has_careers_page, regexp_matches(lower(html), '{pages.TEAM}') AS has_team_page FROM pages""")(  # fmt: skip
    lambda s, d: pages.page_signals(_pages(s, d), AS_OF_YEAR).select("page_id", "web.https", "web.has_analytics", F.col("web.page_bytes").cast("long").alias("page_bytes"), "web.mobile_viewport", "web.has_careers_page", "web.has_team_page")
)
_hints = ", ".join(f"CASE WHEN contains(lower(html), '{m}') THEN '{name}' END" for m, name in pages.TECH)
query("P2_tech_hints", rf"""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter([{_hints}, CASE WHEN regexp_matches(lower(html), 'jquery[-./]1\.\d') THEN 'jquery 1' END,
  lower(regexp_extract(regexp_extract(html, '(?is)<meta[^>]*name=["'']generator["''][^>]*content=["'']([^"'']*)', 1), '^(\S+)', 1))], lambda x: coalesce(x, '') <> ''))), '|') AS tech_hints FROM pages""")(  # fmt: skip
    lambda s, d: pages.page_signals(_pages(s, d), AS_OF_YEAR).select("page_id", F.array_join("web.tech_hints", "|").alias("tech_hints"))
)


def _years_sql(text: str, pattern: str, low: int, high: int) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '{pattern}', 1), lambda y: TRY_CAST(y AS INT)), lambda y: y BETWEEN {low} AND {high})"


query("P4_year_signals", f"""SELECT page_id, {_years_sql('html', pages.COPYRIGHT, 1990, AS_OF_YEAR + 1)}[1] AS copyright_year, list_max({_years_sql(VISIBLE, pages.ANY_YEAR, 1950, AS_OF_YEAR)}) AS latest_content_year,
  {_years_sql(VISIBLE, pages.FOUNDED, 1800, AS_OF_YEAR)}[1] AS founded_year FROM pages""")(  # fmt: skip
    lambda s, d: pages.page_signals(_pages(s, d), AS_OF_YEAR).select("page_id", "web.copyright_year", "web.latest_content_year", "web.founded_year")
)
_sentences = rf"list_transform(string_split(regexp_replace({VISIBLE}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda t: trim(t))"
query("P5_mentions", f"SELECT page_id, array_to_string(list_filter({_sentences}, lambda t: length(t) BETWEEN 15 AND 400 AND regexp_matches(t, '{pages.OWNERSHIP}'))[1:{pages.MENTIONS}], '|') AS owner_mentions FROM pages")(lambda s, d: pages.page_signals(_pages(s, d), AS_OF_YEAR).select("page_id", F.array_join("web.owner_mentions", "|").alias("owner_mentions")))
#: Of the demo's pages: links as they are resolved here have one of a few forms.
LINKS = rf"""WITH p AS (SELECT url, html, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS root FROM ({PAGES})),
a AS (SELECT url, host, root, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>', 1) AS hs, list_transform(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"[^"]*"[^>]*>(.*?)</a', 1), lambda x: trim(regexp_replace(x, '(?s)<[^>]*>', '', 'g'))) AS ts FROM p),
u AS (SELECT url, host, root, unnest(range(len(hs))) AS place, hs, ts FROM a), l AS (SELECT url, host, root, place, replace(hs[place + 1], '&amp;', '&') AS href, ts[place + 1] AS said FROM u),
r AS (SELECT *, regexp_replace(href, '(?s)#.*$', '') AS ref, regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS dir FROM l WHERE href <> '' AND NOT regexp_matches(href, '{pages.NOT_A_PAGE}')),
f AS (SELECT url, host, place, said, href, CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ref WHEN starts_with(ref, '/') THEN root || ref
  WHEN starts_with(ref, '../') THEN root || regexp_replace(CASE WHEN dir = '' THEN '/' ELSE dir END, '[^/]+/$', '') || substr(ref, 4) ELSE root || CASE WHEN dir = '' THEN '/' ELSE dir END || ref END AS link FROM r WHERE ref <> ''),
k AS (SELECT url, link, place, CASE WHEN regexp_matches(said || ' ' || href, '{pages.ABOUT}') THEN 0 WHEN regexp_matches(said || ' ' || href, '{pages.CONTACT}') THEN 1 END AS kind FROM f WHERE lower(regexp_extract(link, '^[^:/?#]+://([^/?#]*)', 1)) = host)
SELECT url, link, place, kind FROM k QUALIFY row_number() OVER (PARTITION BY url, link ORDER BY place) = 1"""
query("P7_page_links", LINKS)(lambda s, d: pages.page_links(demo_pages(s, d)))
_quoted = lambda t: t.replace("'", "''")
_FIRST, _SECOND = rf"'\b({_quoted(pages.PERSON)})\s*[,\-–—]\s*({pages.TITLES})\b'", rf"'\b({pages.TITLES})\s*[:\-–—]\s*({_quoted(pages.PERSON)})\b'"


def contact_sql(table: str) -> str:
    """P8 and P9 of a table of pages: page_id, id where there is one, name, title, email, phone, linkedin_url; null where a page has none."""
    pairs = lambda p, n, t: f"list_filter(list_zip(regexp_extract_all(v, {p}, {n}), regexp_extract_all(v, {p}, {t})), lambda x: NOT regexp_matches(x[1], '{pages.NOT_A_NAME}'))"
    return f"""SELECT * EXCLUDE (v, html, who), who[1] AS name, who[2] AS title, list_filter(list_transform(regexp_extract_all(html, {MAIL}), lambda e: lower(e)), lambda e: NOT regexp_matches(e, '{pages.ASSETS}'))[1] AS email,
  nullif(regexp_extract(v, '{pages.PHONE}', 0), '') AS phone, nullif(regexp_extract(html, '{pages.LINKEDIN}', 0), '') AS linkedin_url
  FROM (SELECT *, list_concat({pairs(_FIRST, 1, 2)}, {pairs(_SECOND, 2, 1)})[1] AS who FROM (SELECT *, {VISIBLE} AS v FROM ({table})))"""


query("P9_decision_maker", f"SELECT page_id, name, title, email FROM ({contact_sql('SELECT page_id, html FROM pages')})")(
    lambda s, d: pages.page_contacts(pages.page_signals(_pages(s, d), AS_OF_YEAR)).select("page_id", "contact.name", "contact.title", "contact.email")
)


def _documents_as_pages(s: SparkSession, d: str) -> DataFrame:
    """The documents hold addresses and numbers, which the pages don't."""
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lit("https://docs.example/").alias("url"), F.col("text").alias("html"))


def _document_contacts(s: SparkSession, d: str, what: str) -> DataFrame:
    """Written before they are filtered: the filter would take the expressions in, and make a text visible once for each of their parts."""
    found = pages.page_contacts(pages.page_signals(_documents_as_pages(s, d), AS_OF_YEAR)).select("doc_id", f"contact.{what}")
    return cut(found, "document-contacts").filter(F.col(what).isNotNull())


_said = f"string_split(regexp_replace({visible_sql('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
query("P5_document_mentions", f"SELECT doc_id, array_to_string(list_filter(list_transform({_said}, lambda t: trim(t)), lambda t: length(t) BETWEEN 15 AND 400 AND regexp_matches(t, '(?i)\\b(licensed|the)\\b'))[1:{pages.MENTIONS}], '|') AS mentions FROM documents")(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(pages.mentions(pages.visible_text(F.col("text")), r"(?i)\b(licensed|the)\b"), "|").alias("mentions")).withColumn("mentions", F.col("mentions"))
)
FOUND = f"""SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, {MAIL}), lambda e: lower(e)), lambda e: NOT regexp_matches(e, '{pages.ASSETS}'))[1] AS email,
  nullif(regexp_extract({visible_sql("coalesce(text, '')")}, '{pages.PHONE}', 0), '') AS phone FROM documents"""
query("P8_document_emails", f"SELECT doc_id, email FROM ({FOUND}) WHERE email IS NOT NULL")(
    lambda s, d: _document_contacts(s, d, "email")
)
query("P8_document_phones", f"SELECT doc_id, phone FROM ({FOUND}) WHERE phone IS NOT NULL")(
    lambda s, d: _document_contacts(s, d, "phone")
)
WITH_SECONDARY = f"""WITH g AS ({PAGES}), k AS (SELECT * FROM ({LINKS}) WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY kind, place) <= 2),
m AS (SELECT k.url, string_agg(g.html, chr(10) ORDER BY k.kind, k.place, g.html) AS more FROM k JOIN g ON g.url = k.link GROUP BY 1) SELECT page_id, id, html || coalesce(chr(10) || more, '') AS html FROM g LEFT JOIN m USING (url)"""
SECONDARY = f"SELECT page_id, sha256(html) AS html_sha256 FROM ({WITH_SECONDARY})"
query("J8_secondary_pages", SECONDARY)(lambda s, d: pages.secondary_pages(demo_pages(s, d), demo_pages(s, d)).select("page_id", F.sha2("html", 256).alias("html_sha256")))

#: No demo name has a word of a trade, so a name gives two spellings at most: with and without generic and short words.
TOKENS = "list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"
TRIES = f"""WITH f AS ({FLAT}), t AS (SELECT id, name, city, phone, list_filter({TOKENS}, lambda t: t NOT IN ({_in(pages.NOT_IN_DOMAIN)})) AS ts FROM f),
o AS (SELECT *, list_filter(ts, lambda t: t NOT IN ({_in(pages.GENERIC)}) AND length(t) > 2) AS own, array_to_string(ts, '') AS a FROM t),
s AS (SELECT *, array_to_string(own, '') AS b, length(a) BETWEEN 4 AND 28 AS ok_a FROM o),
c AS (SELECT id, name, city, phone, own, unnest(list_concat(CASE WHEN ok_a THEN ['https://' || a || '.com', 'https://' || a || '.net'] ELSE [] END,
  CASE WHEN a <> b AND length(b) BETWEEN 4 AND 28 THEN CASE WHEN ok_a THEN ['https://' || b || '.com'] ELSE ['https://' || b || '.com', 'https://' || b || '.net'] END ELSE [] END)) AS url FROM s),
r AS (SELECT *, CASE WHEN ends_with(url, '.net') THEN 1 WHEN url = 'https://' || array_to_string(list_filter({TOKENS}, lambda t: t NOT IN ({_in(pages.NOT_IN_DOMAIN)})), '') || '.com' THEN 0 ELSE 2 END AS turn FROM c),
tries AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) - 1 AS rank FROM r)"""
query("P11_candidate_domains", f"{TRIES} SELECT id, rank, url FROM tries")(lambda s, d: pages.candidate_domains(companies(s, d)))


def proof_sql(name: str, city: str, phone: str, html: str) -> str:
    """P12 as an expression of a company's name, city, phone and a page's html."""
    bare = html
    for t in ("script", "style", "noscript"):
        bare = rf"regexp_replace({bare}, '(?is)<{t}\b.*?</{t}\s*>', ' ', 'g')"
    text = f"""lower({visible_sql(f"regexp_replace({bare}, '(?is)^.*<body[^>]*>', '')")})"""
    parked = " OR ".join(f"contains(left({text}, 4000), '{m}')" for m in pages.PARKED)
    digits = f"regexp_replace({text} || ' ' || {bare}, '[^0-9]', '', 'g')"
    tokens = f"list_filter({TOKENS.replace('name', name)}, lambda t: t NOT IN ({_in(pages.GENERIC)}) AND length(t) > 2)"
    return f"""CASE WHEN length({html}) < 600 OR {parked} THEN NULL WHEN contains({digits}, right(regexp_replace({phone}, '[^0-9]', '', 'g'), 10)) THEN 'phone'
  WHEN len({tokens}) > 0 AND list_bool_and(list_transform({tokens}, lambda t: contains({text}, t))) AND contains({text}, lower({city})) THEN 'name' END"""


PROVEN = f"""{TRIES}, g AS ({PAGES}), m AS (SELECT tries.id, rank, g.url, {proof_sql('tries.name', 'tries.city', 'tries.phone', 'g.html')} AS method FROM tries JOIN g ON {HOST.format('g.url')} = {HOST.format('tries.url')}),
best AS (SELECT id, url, method FROM m WHERE method IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, url) = 1)"""
query("J7_candidate_pages", f"{PROVEN} SELECT id, url, method FROM best")(lambda s, d: pages.candidate_pages(companies(s, d), demo_pages(s, d)))
query("A8_match_tally", f"{PROVEN} SELECT coalesce(method, 'unproven') AS method, count(*) AS companies FROM f LEFT JOIN best USING (id) GROUP BY 1")(
    lambda s, d: pages.match_tally(companies(s, d), pages.candidate_pages(companies(s, d), demo_pages(s, d)))
)

# ---- sinks, streams ----
_text = lambda c: f"coalesce(CAST({c} AS STRING), '')"
EXPORTED = f"""{CONFIDENCE}
SELECT name AS "Company", printf('%.1f', round(score_raw, 1)) AS "Acquisition Fit", {SURE} AS "Confidence", printf('%.2f', round(covered, 4)) AS "Thesis Coverage", {_text('industry')} AS "Industry", {_text('city')} AS "City",
  {_text('state')} AS "State", {_text('postcode')} AS "Postcode", {_text('phone')} AS "Phone", {_text('email')} AS "Email", {_text('contact_name')} AS "Contact Name", {_text('contact_title')} AS "Contact Title",
  {_text('website')} AS "Website", {_text('business_type')} AS "Ownership Form", '' AS "Licensed Since", '' AS "Source" FROM o"""  # fmt: skip
query("K5_crm_export", EXPORTED)(lambda s, d: sinks.crm_export(scored(s, d)))


@query("K1_company_upsert", f"SELECT id, CASE WHEN pos % 5 = 0 THEN upper(name) ELSE name END AS name FROM ({FLAT})")
def company_upsert(s: SparkSession, d: str) -> DataFrame:
    rows = companies(s, d)
    table = store.keyed_table(rows, fresh_path(s, "companies"), "id")
    return table.upsert(rows.filter("pos % 5 = 0").withColumn("name", F.upper("name"))).select("id", "name")


@query("K4_score_append", f"{TOTAL} SELECT id FROM r")
def score_append(s: SparkSession, d: str) -> DataFrame:
    rows, path = score.content_key(companies(s, d), AS_OF_YEAR).select("id", "pos", "cache_key"), fresh_path(s, "scores")
    for part in (rows.filter("pos % 2 = 0"), rows, rows):
        history = store.append_scores(part, path)
    return history.select("id")


query("K3_raw_payload_append", f"SELECT id AS company_id, '2026-09-01' AS fetched_at, CAST(has_contact AS INT) AS n_contacts, raw_text_excerpt AS excerpt FROM ({FLAT})")(lambda s, d: store.append_payloads(companies(s, d).select("id", "web", "contacts"), "id", fresh_path(s, "payloads"), "2026-09-01").select(
    "company_id", "fetched_at", F.coalesce(F.json_array_length(F.get_json_object("payload", "$.contacts")), F.lit(0)).alias("n_contacts"), F.get_json_object("payload", "$.web.raw_text_excerpt").alias("excerpt")))
EVENTS = "SELECT DISTINCT user_id AS company_id, event_type, value FROM events"


@query("X4_refresh_stream", EVENTS)
def refresh_stream(s: SparkSession, d: str) -> DataFrame:
    return stream_history(s, d, s.read.parquet(f"{d}/events.parquet").schema).select("company_id", "event_type", "value")


@query("X4_refresh_batch", EVENTS)
def refresh_batch(s: SparkSession, d: str) -> DataFrame:
    return refreshes(s.read.parquet(f"{d}/events.parquet")).select("company_id", "event_type", "value")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best companies, with what their scores are made of."""
    best = search.page(score.score_table(nest(flat(spark, sf_dir)), AS_OF_YEAR, explain=False), 0, 20)
    return best.select("id", "name", "score", "confidence", "covered_weight")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

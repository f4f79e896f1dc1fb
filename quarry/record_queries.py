"""Registered queries of the evidence, record, review, validation, state and crawl operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import urls
from quarry.functions.html import plain, title
from quarry.operators import evidence, records, reviews, state, validate
from quarry.operators.quality import violations
from quarry.plans.shared import shared_table, table
from quarry.streaming import crawl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Observations: an order is one of its customer's priority, made with a method that the key tells.
_VALUE = "CASE o_orderkey % 7 WHEN 0 THEN 'Unknown' WHEN 1 THEN NULL ELSE o_orderstatus END"
_METHOD = "CASE o_orderkey % 5 WHEN 0 THEN 'x_generic_lab_link' WHEN 1 THEN 'personal_site' ELSE 'directory' END"


def _observed(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate", "o_orderstatus", f"{_VALUE} as value", f"{_METHOD} as method")
    last = F.max_by(F.struct("value", "method", "o_orderdate", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("s")
    own = rows.where(F.col("o_orderkey") % 2 == part).groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("field")).agg(last)
    proof = F.struct(F.lit("http://x.org").alias("source"), F.col("s.o_orderdate").alias("observed_at"), F.col("s.method").alias("method"), F.col("s.o_orderstatus").alias("evidence"))
    return own.select("entity", "field", F.col("s.value").alias("value"), F.array(proof).alias("proofs"))


def _merged(before: DataFrame, batch: DataFrame) -> DataFrame:
    return evidence.merge_observed(before, batch, F.col("field") == "2-HIGH", ("1-URGENT",))


def merge_observed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _merged(_observed(spark, sf_dir, 0), _observed(spark, sf_dir, 1))
    return out.select("entity", "field", "value", "action", F.size("proofs").cast("long").alias("proofs"), F.col("other.value").alias("other_value"), evidence.newest(F.col("proofs")).alias("newest"))


_SIDES = f"""WITH r AS (
  SELECT o_custkey AS entity, o_orderpriority AS field, o_orderkey % 2 AS part, {_VALUE} AS value, {_METHOD} AS method, o_orderdate AS at, o_orderstatus AS ev,
    row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderkey % 2 ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders
), b AS (
  SELECT coalesce(o.entity, n.entity) AS entity, coalesce(o.field, n.field) AS field, o.entity IS NOT NULL AS hasold, n.entity IS NOT NULL AS hasnew, o.value AS ov, n.value AS nv, o.method AS om, n.method AS nm,
    o.at AS oat, n.at AS nat, o.ev AS oe, n.ev AS ne, coalesce(o.value <> 'Unknown', FALSE) AS had, coalesce(n.value <> 'Unknown', FALSE) AS has
  FROM (SELECT * FROM r WHERE k = 1 AND part = 0) o FULL JOIN (SELECT * FROM r WHERE k = 1 AND part = 1) n ON o.entity = n.entity AND o.field = n.field
), m AS (
  SELECT *, CASE WHEN NOT hasnew OR nv = 'Unknown' THEN 'kept' WHEN nv IS NULL THEN 'proved'
    WHEN had AND ov <> nv AND field = '2-HIGH' AND nm LIKE '%_generic_lab_link' AND om NOT LIKE '%_generic_lab_link' THEN 'additional'
    WHEN had AND ov <> nv AND nat < oat AND NOT (field = '2-HIGH' AND om LIKE '%_generic_lab_link' AND nm NOT LIKE '%_generic_lab_link') THEN 'outdated'
    WHEN had AND ov <> nv AND field = '1-URGENT' AND om = 'personal_site' AND nm <> 'personal_site' THEN 'additional' WHEN had AND ov <> nv THEN 'replaced' WHEN had THEN 'proved' ELSE 'set' END AS action FROM b
)"""
SQL["merge_observed_fields"] = _SIDES + """
SELECT entity, field, CASE WHEN action IN ('set', 'replaced') THEN nv ELSE ov END AS value, action,
  CAST(CASE WHEN action = 'kept' AND NOT hasold THEN NULL WHEN action IN ('set', 'proved') AND hasold AND hasnew AND NOT (oat = nat AND om = nm AND oe = ne) THEN 2 ELSE 1 END AS BIGINT) AS proofs,
  CASE action WHEN 'replaced' THEN ov WHEN 'additional' THEN nv END AS other_value,
  CASE WHEN action = 'replaced' THEN nat WHEN action IN ('set', 'proved') THEN greatest(coalesce(oat, nat), coalesce(nat, oat)) ELSE oat END AS newest FROM m"""


def merge_observed_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batch merged once more changes no value and no proof of any entity: a fixpoint, but for what was set aside."""
    batch = _observed(spark, sf_dir, 1)
    once = shared_table(evidence.state_of(_merged(_observed(spark, sf_dir, 0), batch)))
    twice = evidence.state_of(_merged(once, batch))
    same = once.alias("a").join(twice.alias("b"), evidence.KEYS)
    changed = ~F.col("a.value").eqNullSafe(F.col("b.value")) | ~F.col("a.proofs").eqNullSafe(F.col("b.proofs"))
    return same.agg(F.count("*").alias("rows"), F.count_if(changed).alias("changed"))


SQL["merge_observed_again"] = _SIDES + " SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM m"


def latest_check_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    one = lambda part: e.where(F.col("event_id") % 2 == part).groupBy(F.col("user_id").alias("entity")).agg(F.max_by(F.struct(F.when(F.col("event_type") == "error", "fetch_failed").otherwise("verified").alias("status"), F.col("ts").alias("observed_at")), F.struct("value", "event_id")).alias("s")).select("entity", "s.*")
    return evidence.latest_checks(one(1), one(0)).select("entity", "status", "observed_at", F.col("history.status").alias("old_status"), F.col("history.observed_at").alias("old_at"))


SQL["latest_check_wins"] = """WITH r AS (
  SELECT user_id AS entity, event_id % 2 AS part, CASE event_type WHEN 'error' THEN 'fetch_failed' ELSE 'verified' END AS status, ts, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY value DESC, event_id DESC) AS k FROM events
), b AS (
  SELECT coalesce(o.entity, n.entity) AS entity, o.status AS os, o.ts AS ot, n.status AS ns, n.ts AS nt, n.ts IS NOT NULL AND (o.ts IS NULL OR n.ts >= o.ts) AS takes
  FROM (SELECT * FROM r WHERE k = 1 AND part = 0) o FULL JOIN (SELECT * FROM r WHERE k = 1 AND part = 1) n ON o.entity = n.entity
)
SELECT entity, CASE WHEN takes THEN ns ELSE os END AS status, CASE WHEN takes THEN nt ELSE ot END AS observed_at,
  CASE WHEN takes AND ot IS NOT NULL AND (os <> ns OR ot <> nt) THEN os END AS old_status, CASE WHEN takes AND ot IS NOT NULL AND (os <> ns OR ot <> nt) THEN ot END AS old_at FROM b"""


def _links(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(condition).select(F.col("l_orderkey").alias("entity"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("target"))


def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("identity"))
    return orders.select("identity", (F.col("identity") - F.col("identity") % 2).alias("entity"))


def relationships_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a baseline that are gone, where two records became one and their targets likewise."""
    now = _links(spark, sf_dir, "l_quantity <= 45").withColumn("entity", F.col("entity") - F.col("entity") % 2)
    return evidence.relationships_lost(_links(spark, sf_dir, "l_linenumber <= 3"), now, _owners(spark, sf_dir))


SQL["relationships_preserved"] = """WITH owners AS (SELECT o_orderkey AS identity, o_orderkey - o_orderkey % 2 AS owner FROM orders),
b AS (SELECT DISTINCT l_orderkey AS entity, l_returnflag AS kind, l_partkey AS target, coalesce(owner, l_partkey) AS too FROM lineitem LEFT JOIN owners ON l_partkey = identity WHERE l_linenumber <= 3),
h AS (SELECT DISTINCT w.identity AS entity, l_returnflag AS kind, coalesce(t.owner, l_partkey) AS too FROM lineitem LEFT JOIN owners t ON l_partkey = t.identity JOIN owners w ON w.owner = l_orderkey - l_orderkey % 2 WHERE l_quantity <= 45)
SELECT DISTINCT entity, kind, target FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.entity = b.entity AND h.kind = b.kind AND h.too = b.too)"""


def ambiguous_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 997).alias("identity"), (F.col("o_custkey") % 50).alias("entity"))
    return evidence.ambiguous_owners(claims)


SQL["ambiguous_identities"] = "SELECT o_orderkey % 997 AS identity, count(DISTINCT o_custkey % 50) AS owners, min(o_custkey % 50) AS first_owner FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey % 50) > 1"

_PERSON = {
    "website": "CASE c_custkey % 3 WHEN 0 THEN 'http://p.org/' || CAST(c_custkey AS VARCHAR(19)) WHEN 1 THEN 'Not found' ELSE NULL END",
    "email": "CASE WHEN c_custkey % 4 = 0 THEN 'a' || CAST(c_custkey AS VARCHAR(19)) || '@x.org' ELSE 'Unknown' END",
    "summary": "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Public page' ELSE repeat('word ', CAST(c_custkey % 40 AS INT)) END",
    "title": "CASE c_custkey % 4 WHEN 0 THEN 'Professor' WHEN 1 THEN 'Lecturer' WHEN 2 THEN 'Associate Professor' ELSE '' END",
    "confidence": "CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN NULL ELSE 'medium' END",
}


def consolidated_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", *[f"{e} as {n}" for n, e in _PERSON.items()])
    c = F.col
    rank = records.person_quality(F.lit(None).cast("string"), c("website"), c("email"), F.lit("http://x.org/p"), c("summary"), F.lit(1))
    values = {
        "website": records.best_known(c("website"), F.struct(rank, -c("c_custkey"))), "email": records.best_known(c("email"), F.struct(rank, -c("c_custkey"))),
        "summary": records.best_summary(c("summary"), -c("c_custkey")), "title": records.best_title(c("title"), -c("c_custkey")), "confidence": records.best_confidence(c("confidence")),
    }
    out = records.consolidated(rows, F.concat_ws("|", c("c_nationkey").cast("string"), "c_mktsegment"), [rank], values, "c_custkey")
    return out.select("key", F.col("best.c_custkey").alias("best"), "records", F.array_min("merged_ids").alias("least_id"), "website", "email", F.length("summary").cast("long").alias("summary_chars"), "title", "confidence")


SQL["consolidated_people"] = "WITH t AS (SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) || '|' || c_mktsegment AS key, " + ", ".join(f"{e} AS {n}" for n, e in _PERSON.items()) + """ FROM customer), q AS (
  SELECT *, coalesce(website NOT IN ('Not found', 'Unknown', ''), FALSE) AS w, email <> 'Unknown' AS e, length(trim(summary)) >= 90 AND lower(summary) NOT LIKE 'public %' AS s,
    CASE title WHEN 'Professor' THEN 4 WHEN 'Lecturer' THEN 2 WHEN 'Associate Professor' THEN 5 ELSE 0 END AS ts, CASE coalesce(confidence, 'medium') WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS cs FROM t
), r AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY w DESC, e DESC, s DESC, id) AS k, row_number() OVER (PARTITION BY key ORDER BY w DESC, w DESC, e DESC, s DESC, id) AS kw,
    row_number() OVER (PARTITION BY key ORDER BY e DESC, w DESC, e DESC, s DESC, id) AS ke, row_number() OVER (PARTITION BY key ORDER BY summary <> '' DESC, s DESC, length(summary) DESC, id) AS ks,
    row_number() OVER (PARTITION BY key ORDER BY ts DESC, id) AS kt, row_number() OVER (PARTITION BY key ORDER BY cs DESC) AS kc FROM q
)
SELECT key, max(CASE WHEN k = 1 THEN id END) AS best, count(*) AS records, min(id) AS least_id, max(CASE WHEN kw = 1 AND w THEN website END) AS website, max(CASE WHEN ke = 1 AND e THEN email END) AS email,
  CAST(max(CASE WHEN ks = 1 AND summary <> '' THEN length(summary) END) AS BIGINT) AS summary_chars, max(CASE WHEN kt = 1 THEN title END) AS title, max(CASE WHEN kc = 1 THEN coalesce(confidence, 'medium') END) AS confidence
FROM r GROUP BY key"""


def merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, contacts, people and affiliations of orders, each entry once."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CASE l_partkey % 4 WHEN 0 THEN 'ftp://x' ELSE 'http://x.org/' || CAST(l_partkey % 3 AS VARCHAR(9)) END as url", "CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag END as label",
        "CASE WHEN l_linenumber % 3 = 0 THEN 'phone' ELSE 'email' END as type", "CASE l_partkey % 3 WHEN 0 THEN 'info@x.org' WHEN 1 THEN 'A@x.org' ELSE 'a@x.org' END as value", "CAST(NULL AS STRING) as href",
        "CASE WHEN l_partkey % 5 = 0 THEN '' ELSE l_shipmode_ END as name".replace("l_shipmode_", "l_linestatus"), "l_returnflag as role", "l_linestatus as department", "CASE WHEN l_quantity > 25 THEN 'Professor' ELSE 'Lecturer' END as title",
        "CAST(l_suppkey % 3 AS STRING) as source",
    )
    key, place = "l_orderkey", ["l_linenumber"]
    one = lambda df, kind, entry: df.select(key, F.lit(kind).alias("list"), entry.alias("entry"))
    links = one(records.merged_links(rows.select(key, "l_linenumber", "label", "url"), key, [*place, "label"]), "link", F.concat_ws(" ", "label", "url"))
    contacts = one(records.merged_contacts(rows.select(key, "l_linenumber", "type", "value", "href"), key, [*place, "value"]), "contact", F.concat_ws(" ", "type", "value"))
    people = one(records.merged_people(rows.select(key, "l_linenumber", "name", "role"), key, place), "person", F.concat_ws(" ", "name", "role"))
    units = one(records.merged_affiliations(rows, key), "unit", F.concat_ws(" ", "department", "title", F.array_join("sources", ",")))
    return links.unionByName(contacts).unionByName(people).unionByName(units)


SQL["merged_lists"] = """WITH t AS (
  SELECT l_orderkey, l_linenumber AS ln, CASE l_partkey % 4 WHEN 0 THEN 'ftp://x' ELSE 'http://x.org/' || CAST(l_partkey % 3 AS VARCHAR) END AS url, CASE WHEN l_linenumber % 2 = 0 THEN 'Source' ELSE l_returnflag END AS label,
    CASE WHEN l_linenumber % 3 = 0 THEN 'phone' ELSE 'email' END AS type, CASE l_partkey % 3 WHEN 0 THEN 'info@x.org' WHEN 1 THEN 'A@x.org' ELSE 'a@x.org' END AS value, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE l_linestatus END AS name,
    l_returnflag AS role, l_linestatus AS department, CASE WHEN l_quantity > 25 THEN 'Professor' ELSE 'Lecturer' END AS title, CAST(l_suppkey % 3 AS VARCHAR) AS source FROM lineitem
)
SELECT l_orderkey, 'link' AS list, label || ' ' || url AS entry FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, url ORDER BY ln, label) AS k FROM t WHERE url LIKE 'http%') WHERE k = 1
UNION ALL SELECT l_orderkey, 'contact', type || ' ' || value FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, type, lower(value) ORDER BY ln, value) AS k FROM t WHERE type <> 'email' OR value <> 'info@x.org') WHERE k = 1
UNION ALL SELECT l_orderkey, 'person', name || ' ' || role FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, name, role ORDER BY ln) AS k FROM t WHERE name <> '') WHERE k = 1
UNION ALL SELECT l_orderkey, 'unit', department || ' ' || CASE WHEN bool_or(title = 'Professor') THEN 'Professor' ELSE 'Lecturer' END || ' ' || string_agg(DISTINCT source, ',' ORDER BY source) FROM t GROUP BY l_orderkey, department"""


def identity_key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    keys = {"name": F.when(F.col("c_acctbal") < 0, F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment")), "email": F.when(F.col("c_custkey") % 10 == 0, F.floor(F.col("c_custkey") / 30).cast("string"))}
    return records.identity_edges(rows, "c_custkey", keys)


SQL["identity_key_edges"] = """WITH k AS (
  SELECT c_custkey AS id, 'name' AS kind, CAST(c_nationkey AS VARCHAR) || '|' || c_mktsegment AS key FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'email', CAST(c_custkey // 30 AS VARCHAR) FROM customer WHERE c_custkey % 10 = 0
)
SELECT DISTINCT id AS u, v FROM (SELECT id, min(id) OVER (PARTITION BY kind, key) AS v FROM k) WHERE id <> v"""


def legacy_cleanup_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rules = {
        "negative balance": ("c_acctbal", c("c_acctbal") < 0, F.lit(0.0)), "large balance": ("c_acctbal", c("c_acctbal") > 9000, F.lit(9000.0)), "furniture is no segment": ("c_mktsegment", c("c_mktsegment") == "FURNITURE", F.lit(None).cast("string")),
        "every fifth": ("c_mktsegment", c("c_custkey") % 5 == 0, F.lit("OTHER")),
    }
    return records.cleaned(table(spark, sf_dir, "customer"), "c_custkey", rules)[1].select("c_custkey", "field", "replacement", "reason")


SQL["legacy_cleanup_log"] = """
SELECT c_custkey, 'c_acctbal' AS field, CASE WHEN c_acctbal < 0 THEN '0.0' ELSE '9000.0' END AS replacement, CASE WHEN c_acctbal < 0 THEN 'negative balance' ELSE 'large balance' END AS reason FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000
UNION ALL SELECT c_custkey, 'c_mktsegment', CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE 'OTHER' END, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'furniture is no segment' ELSE 'every fifth' END FROM customer WHERE c_mktsegment = 'FURNITURE' OR (c_custkey % 5 = 0 AND c_mktsegment <> 'OTHER')"""


def review_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions about pages, with proofs of every kind; the rules that each breaks."""
    p = table(spark, sf_dir, "pages").select("page_id", "html", F.coalesce("url", F.lit("")).alias("url"))
    heading = plain(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1))
    k = F.col("page_id") % 7
    captures = p.select(
        F.col("page_id").alias("capture"), F.when(F.col("page_id") % 17 == 0, "fetch_failed").otherwise("ok").alias("status"), F.col("html").alias("body"), F.sha2("html", 256).alias("sha256"),
        F.lit("2024-01-01").alias("observed_at"), F.col("url").alias("final_url"), F.array(F.lit("a"), F.lit("b")).alias("redirects"),
    )
    kind = F.when(k == 0, "document_title").when(k == 2, "document_heading").when(k == 3, "redirect_chain").when(k == 4, "html_attribute").otherwise("main_text_quote")
    quote = F.when(k == 0, title(F.col("html"))).when(k == 1, "no such words anywhere").when(k == 2, heading).when(k == 3, "a -> b").when(k == 4, F.lit("charset = utf-8")).otherwise(F.substring(heading, 1, 12))
    proof = F.struct(
        F.when(F.col("page_id") % 11 == 0, -1).otherwise(F.col("page_id")).alias("capture"), F.when(k == 5, "0").otherwise(F.sha2("html", 256)).alias("sha256"), F.lit("2024-01-01").alias("observed_at"),
        F.col("url").alias("final_url"), kind.alias("kind"), quote.alias("evidence"), F.lit("charset").alias("label"), F.lit("utf-8").alias("target"),
    )
    decisions = p.select(
        F.col("page_id").alias("decision"), F.when(F.col("page_id") % 19 == 0, "erase").otherwise("merge").alias("action"), F.col("page_id").alias("subject"),
        F.when(F.col("page_id") % 10 == 9, F.col("page_id") - 1).otherwise(F.col("page_id") + 1_000_000).alias("target"), F.when(F.col("page_id") % 13 == 0, " ").otherwise("same site").alias("reason"),
        F.when(F.col("page_id") % 23 == 0, "old").otherwise(F.lit("h")).alias("sha256"), F.array(proof).alias("proofs"),
    )
    ids = p.select(F.col("page_id").alias("id")).unionByName(p.where("page_id % 29 <> 0").select((F.col("page_id") + 1_000_000).alias("id")))
    known = ids.select("id", F.array().cast("array<bigint>").alias("alias_ids"), F.lit("h").alias("sha256"))
    out = reviews.verify(decisions, known, captures, reviews.SCHEMAS["identity_merge"])
    return out.select("decision", F.array_join("failures", ",").alias("failures"))


SQL["review_verification"] = r"""WITH p AS (
  SELECT page_id AS i, html, page_id % 7 AS k,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS h,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS plain,
    regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages
), f AS (
  SELECT i, CASE WHEN i % 19 = 0 THEN 'action' END AS a, CASE WHEN i % 10 = 8 AND EXISTS (SELECT 1 FROM pages WHERE page_id = i + 1) THEN 'cyclic' END AS c, CASE WHEN i % 13 = 0 THEN 'no_reason' END AS r,
    CASE WHEN i % 23 = 0 THEN 'record_changed' END AS rc, CASE WHEN i % 10 <> 9 AND i % 29 = 0 THEN 'no_target' END AS nt,
    CASE WHEN i % 11 = 0 THEN 'no_capture' WHEN i % 17 = 0 THEN 'capture_failed' WHEN k = 5 THEN 'body_changed'
      WHEN CASE k WHEN 0 THEN trim(t) = '' WHEN 1 THEN TRUE WHEN 2 THEN h = '' WHEN 3 THEN FALSE WHEN 4 THEN NOT contains(html, 'charset="utf-8"') ELSE h = '' OR NOT contains(plain, trim(regexp_replace(substr(h, 1, 12), '\s+', ' ', 'g'))) END THEN 'evidence_not_found' END AS e FROM p
)
SELECT i AS decision, array_to_string(list_sort(list_filter([a, c, r, rc, nt, e], lambda x: x IS NOT NULL)), ',') AS failures FROM f"""


def review_apply_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers merged into their neighbours: aliases taken over, orders' references moved, merged records archived."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_custkey") + 1_000_000).alias("alias_ids"), "c_mktsegment")
    aims = c.where("id % 4 = 1").select(F.col("id").alias("decision"), F.col("id").alias("subject"), (F.col("id") - 1).alias("target"), F.lit("same person").alias("reason"))
    refs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderpriority")
    kept, moved, gone = reviews.apply_merges(c, aims, refs)
    counts = moved.groupBy("id").agg(F.count("*").alias("references"))
    left = kept.join(counts, "id", "left").select("id", F.array_join(F.transform("alias_ids", lambda a: a.cast("string")), ",").alias("aliases"), F.coalesce("references", F.lit(0)).alias("references"), F.lit(False).alias("archived"))
    return left.unionByName(gone.select("id", F.lit("").alias("aliases"), F.lit(0).cast("long").alias("references"), F.lit(True).alias("archived")))


SQL["review_apply_merges"] = """WITH r AS (SELECT DISTINCT CASE WHEN o_custkey % 4 = 1 THEN o_custkey - 1 ELSE o_custkey END AS id, o_orderpriority FROM orders), n AS (SELECT id, count(*) AS n FROM r GROUP BY id)
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 AND EXISTS (SELECT 1 FROM customer x WHERE x.c_custkey = customer.c_custkey + 1) THEN array_to_string([c_custkey + 1, c_custkey + 1000000, c_custkey + 1000001], ',') ELSE CAST(c_custkey + 1000000 AS VARCHAR) END AS aliases,
  coalesce(n, 0) AS "references", FALSE AS archived FROM customer LEFT JOIN n ON n.id = c_custkey WHERE c_custkey % 4 <> 1
UNION ALL SELECT c_custkey, '', 0, TRUE FROM customer WHERE c_custkey % 4 = 1"""

_RECORD = {
    "institution": "CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE 'U' END", "status": "CASE o_orderkey % 5 WHEN 0 THEN 'Recruiting' WHEN 1 THEN 'Maybe' ELSE 'Unknown' END",
    "said": "CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'We are hiring' END", "link": "CASE o_orderkey % 3 WHEN 0 THEN 'http://x.org/a' WHEN 1 THEN 'http://x.org/b' ELSE 'x.org' END",
    "rating": "CASE o_orderkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'not_found' WHEN 2 THEN 'guessed' ELSE 'no_reviews' END", "score": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 8 AS DOUBLE) END",
    "seen": "CASE o_orderkey % 6 WHEN 0 THEN '2030-01-01' WHEN 1 THEN 'yesterday' ELSE '2023-05-05' END", "course": "CASE o_orderkey % 7 WHEN 0 THEN 'later' ELSE 'current' END",
}


def record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus", *[f"{e} as {n}" for n, e in _RECORD.items()])
    c, today = F.col, F.lit("2024-06-01").cast("date")
    urls_ = F.array(F.lit("http://x.org/a"), F.lit("http://x.org/c"))
    proofs = F.array(F.struct(F.lit("email").alias("field"), c("link").alias("source"), c("seen").alias("observed_at"), c("said").alias("evidence")))
    courses = F.array(F.struct(
        F.lit("A 1").alias("code"), F.lit("Fall 2024").alias("term"), F.lit("http://x.org/c").alias("source"), F.lit("2024-01-01").alias("observed_at"), c("said").alias("evidence"), c("course").alias("status"),
        F.when(c("o_orderkey") % 9 == 0, "low").otherwise("high").alias("confidence"), F.lit("ok").alias("verification"),
    ))
    impact = F.struct(F.lit(1.0).alias("value"), F.lit(2020).alias("year"), F.lit("s").alias("source"), F.when(c("o_orderkey") % 8 == 0, "odd").otherwise("verified").alias("status"))
    people = F.array(F.struct(F.lit("scholar").alias("kind"), c("link").alias("url"), F.lit("Not found").alias("search_url"), F.lit("http://x.org/c").alias("source"), F.lit("found").alias("status"), c("seen").alias("checked")))
    rules = (
        validate.common(c("institution"), F.lit("D"), F.array(F.when(c("o_orderkey") % 12 == 0, "").otherwise("A"))) | validate.sources(F.array(c("link"), F.lit("http://x.org/c")))
        | validate.recruiting(c("status"), c("said"), c("link"), urls_) | validate.evidence(proofs, urls_, today) | validate.courses(courses, urls_, today)
        | validate.verification(F.when(c("o_orderkey") % 14 == 0, "sure").otherwise("source_checked"), F.array(F.when(c("o_orderkey") % 15 == 0, "name").otherwise("email")), proofs, c("o_orderkey") % 16 == 0)
        | validate.rating(c("rating"), c("score"), F.lit(5), F.col("o_orderkey") % 2, F.lit("http://x.org/r"), F.lit(True)) | validate.publication(F.lit("T"), F.lit(2020), c("link"), F.lit(None).cast("string"), impact)
        | validate.profiles(people, ("found", "not_found")) | validate.metric_sources(F.array(F.struct(F.lit("s").alias("source"), c("link").alias("url"))))
    )
    return violations(rows, "o_orderkey", rules).groupBy("rule").agg(F.count("*").alias("records"), F.min(F.col("key").cast("long")).alias("first_record"))


_BROKEN = {
    "institution": "trim(institution) = ''", "areas": "k % 12 = 0", "sources_invalid": "link = 'x.org'", "recruiting_status": "status = 'Maybe'", "recruiting_text": "status = 'Recruiting' AND said = ''",
    "recruiting_url": "status = 'Recruiting' AND link = 'x.org'", "recruiting_source": "status = 'Recruiting' AND link <> 'http://x.org/a'", "evidence_text": "link = 'x.org' OR said = ''", "evidence_source": "link <> 'http://x.org/a'",
    "evidence_date": "seen <> '2023-05-05'", "course_fields": "said = ''", "course_status": "course = 'later'", "course_unconfirmed": "k % 9 = 0", "verification_status": "k % 14 = 0", "fields_verified": "k % 15 = 0",
    "link_review": "k % 16 = 0", "rating_status": "rating = 'guessed'", "rating_score": "rating = 'verified' AND NOT coalesce(score BETWEEN 1 AND 5, FALSE)", "rating_count": "rating = 'verified' AND k % 2 = 0",
    "rating_unverified": "rating <> 'verified' AND score IS NOT NULL", "publication_url": "link = 'x.org'", "impact_status": "k % 8 = 0", "profile_urls": "link = 'x.org'", "metric_source": "link = 'x.org'",
}
SQL["record_rules"] = "WITH t AS (SELECT o_orderkey AS k, " + ", ".join(f"{e} AS {n}" for n, e in _RECORD.items()) + " FROM orders) " + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) AS records, min(k) AS first_record FROM t WHERE {b} HAVING count(*) > 0" for n, b in _BROKEN.items()
)

_ASKED = """CASE event_id % 6 WHEN 0 THEN '?q=a+b%20c&sort=rating' WHEN 1 THEN '?type=labs&evidence=ratings,bogus,courses' WHEN 2 THEN '?checked=1&saved=0&status=Recruiting' WHEN 3 THEN '?type=nothing&sort=odd&area=ai&field=cs'
  WHEN 4 THEN '' ELSE '?school=eng&dept=CSE&evidence=bogus' END"""


def reader_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").selectExpr("event_id", f"{_ASKED} as asked")
    s = state.read_url(F.col("asked"), ("professors", "labs"))
    fit = state.normalized(s, known_departments={"CSE": "eng"}, known_areas={"ai": "math"})
    return t.withColumn("s", s).select(
        "event_id", F.col("s.query").alias("query"), F.col("s.type").alias("type"), F.col("s.sort").alias("sort"), F.col("s.evidence").alias("evidence"), F.col("s.verified_only").alias("verified_only"),
        state.write_url(F.col("s")).alias("written"), F.array_join(F.transform(state.active_filters(F.col("s")), lambda a: F.concat_ws("=", a["key"], a["value"])), ";").alias("active"), fit["area"].alias("area"),
        fit["department"].alias("department"), state.narrowed(F.col("s"), "division", F.lit("med"))["department"].alias("after_division"),
    )


SQL["reader_state"] = f"""WITH t AS (SELECT event_id, event_id % 6 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'a b c' ELSE '' END AS query, CASE k WHEN 1 THEN 'labs' ELSE 'all' END AS type, CASE k WHEN 0 THEN 'rating' ELSE 'relevance' END AS sort, CASE k WHEN 1 THEN 'courses,ratings' ELSE 'all' END AS evidence, k = 2 AS verified_only,
  CASE k WHEN 0 THEN '?q=a+b+c&sort=rating' WHEN 1 THEN '?type=labs&evidence=courses%2Cratings' WHEN 2 THEN '?status=Recruiting&checked=1' WHEN 3 THEN '?field=cs&area=ai' WHEN 4 THEN '' ELSE '?school=eng&dept=CSE' END AS written,
  CASE k WHEN 1 THEN 'evidence:courses=courses;evidence:ratings=ratings' WHEN 2 THEN 'verified_only=Source checked;recruiting=Recruiting' WHEN 3 THEN 'area=ai' WHEN 5 THEN 'department=CSE' ELSE '' END AS active,
  'all' AS area, CASE k WHEN 5 THEN 'CSE' ELSE 'all' END AS department, 'all' AS after_division FROM t"""

_READER = {
    "name": "c_name", "recruiting": "CASE c_custkey % 4 WHEN 0 THEN 'Recruiting' WHEN 1 THEN NULL ELSE 'Unknown' END", "courses": "CAST(c_custkey % 3 AS INT)", "checked": "c_custkey % 2 = 0", "needs_review": "c_custkey % 5 = 0",
    "rating_score": "CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 50 AS DOUBLE) / 10 END", "rating_count": "CAST(c_custkey % 1200 AS INT)",
}


def filtered_sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recruiting records with courses that need review or are rated, by rating: the first two pages of forty."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", *[f"{e} as {n}" for n, e in _READER.items()])
    rows = rows.withColumn("ratings", F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("rateMyPI"))).otherwise(F.array().cast("array<string>")))
    kept = state.matches(rows, {"recruiting": "Recruiting", "evidence": "courses,needs_review"}, F.lit(True))
    return records.paged(kept, state.order_by("rating"), 1).select("c_custkey", "name", state.rating_value(F.col("rating_score"), F.col("rating_count")).alias("rated"))


SQL["filtered_sorted_page"] = "WITH t AS (SELECT c_custkey, " + ", ".join(f"{e} AS {n}" for n, e in _READER.items()) + """ FROM customer)
SELECT c_custkey, name, CASE WHEN rating_score IS NULL THEN -1 ELSE rating_score * 1000 + least(rating_count, 999) END AS rated FROM t
WHERE recruiting = 'Recruiting' AND courses > 0 AND (NOT checked OR needs_review) ORDER BY 3 DESC, name LIMIT 80"""


def reader_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and numbers for a reader, and papers that share words with their record."""
    c = F.col
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "CASE c_custkey % 4 WHEN 0 THEN 'emeritus' WHEN 1 THEN 'listed_in_official_directory' ELSE NULL END as legacy", "CASE c_custkey % 3 WHEN 0 THEN 'adjunct' WHEN 1 THEN 'odd' ELSE NULL END as appointment",
        "CASE c_custkey % 5 WHEN 0 THEN '-1' WHEN 1 THEN 'n/a' WHEN 2 THEN NULL ELSE CAST(c_custkey AS STRING) END as citations",
    )
    m = state.academic_metrics(c("citations"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("OpenAlex"), c("c_custkey") % 2 == 0)
    return rows.withColumn("m", m).select("c_custkey", state.faculty_label(c("legacy"), c("appointment")).alias("label"), state.numeric_metric(c("citations")).alias("numeric"), c("m.citations").alias("citations"), c("m.status").alias("status"))


SQL["reader_labels"] = """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Emeritus faculty' WHEN c_custkey % 3 = 0 THEN 'Adjunct faculty · directory' WHEN c_custkey % 4 = 1 THEN 'Listed in official directory' ELSE 'Status not verified' END AS label,
  c_custkey % 5 IN (3, 4) AS numeric, CASE WHEN c_custkey % 5 IN (3, 4) AND c_custkey % 2 = 0 THEN CAST(c_custkey AS DOUBLE) ELSE -1.0 END AS citations,
  CASE WHEN c_custkey % 5 NOT IN (3, 4) THEN 'Not verified' WHEN c_custkey % 2 = 0 THEN 'OpenAlex verified' ELSE 'OpenAlex needs review' END AS status FROM customer"""


def relevant_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as papers, ranked by the words that they share with the benchmark item of the same number."""
    from quarry.functions.labels import token_set

    items = table(spark, sf_dir, "benchmark").select("item_id", token_set(F.col("text")).alias("own"))
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", (F.col("doc_id") % 40).alias("item_id"), token_set(F.col("text")).alias("tokens"), F.col("n_chars").cast("string").alias("date"))
    return state.relevant(docs.join(items, "item_id"), "item_id", "doc_id", F.col("own"), F.col("tokens"), F.col("date"))


SQL["relevant_papers"] = r"""WITH w AS (
  SELECT text, id, kind, list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(strip_accents(regexp_replace(text, '<[^>]*>', ' ', 'g'))), '[^\p{L}\p{N}@.+-]+', ' ', 'g')), '\s+'),
    lambda x: length(x) > 2 AND NOT regexp_full_match(x, '\d+') AND NOT list_contains(['and', 'array', 'course', 'department', 'for', 'from', 'into', 'the', 'their', 'with'], x))) AS ts, d
  FROM (SELECT text, item_id AS id, 0 AS kind, '' AS d FROM benchmark UNION ALL SELECT text, doc_id, 1, CAST(n_chars AS VARCHAR) FROM documents WHERE text IS NOT NULL)
), s AS (SELECT i.id AS item_id, d.id AS doc_id, d.d, len(list_intersect(i.ts, d.ts)) AS shared FROM w d JOIN w i ON d.kind = 1 AND i.kind = 0 AND i.id = d.id % 40)
SELECT item_id, doc_id, CAST(shared AS INTEGER) AS shared, CAST(row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, d DESC, doc_id) AS INTEGER) AS place FROM s WHERE shared > 0"""

_SEED = """CASE event_id % 9 WHEN 0 THEN 'https://X.edu/p/' || CAST(event_id % 50 AS VARCHAR(9)) WHEN 1 THEN 'https://x.edu/p/' || CAST(event_id % 50 AS VARCHAR(9)) || '#top' WHEN 2 THEN 'https://10.0.0.1/x' WHEN 3 THEN 'https://x.edu/a.pdf'
  WHEN 4 THEN 'https://x.edu/a b' ELSE 'https://h' || CAST(event_id % 4 AS VARCHAR(9)) || '.x.edu/q/' || CAST(event_id % 70 AS VARCHAR(9)) END"""


def _seeded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", f"{_SEED} as url", "event_type as department", "CASE WHEN event_id % 2 = 0 THEN 'profile' ELSE 'directory' END as kind", "'s' as source", "CAST(user_id % 4 AS INT) as depth")
    return crawl.seeds(rows.where("event_id % 2 = 0").drop("event_id", "user_id"), rows.where("event_id % 2 = 1").drop("event_id", "user_id"))


def crawl_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, contexts, rejected = _seeded(spark, sf_dir)
    counted = contexts.groupBy("url_key").agg(F.count("*").alias("contexts"))
    own = items.join(counted, "url_key").select(F.col("url_key").alias("url"), "depth", "contexts", "state")
    return own.unionByName(rejected.groupBy("url").agg(F.lit(None).cast("int").alias("depth"), F.count("*").alias("contexts"), F.first("status").alias("state")))


_SEEDED = f"""WITH r AS (SELECT event_id, {_SEED} AS raw, event_type, CASE WHEN event_id % 2 = 0 THEN 'profile' ELSE 'directory' END AS kind, CAST(user_id % 4 AS INTEGER) AS depth FROM events),
u AS (SELECT *, replace(replace(raw, 'X.edu', 'x.edu'), '#top', '') AS url, contains(raw, ' ') OR contains(raw, '10.0.0.1') AS bad FROM r)"""
SQL["crawl_seeds"] = _SEEDED + """
SELECT url, min(depth) AS depth, count(DISTINCT event_type || kind) AS contexts, 'pending' AS state FROM u WHERE NOT bad AND url NOT LIKE '%.pdf' GROUP BY url
UNION ALL SELECT raw, NULL, count(DISTINCT event_type || kind), 'invalid_literal_uri_not_requested' FROM u WHERE bad GROUP BY raw"""


def crawl_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue after a batch of answers, its scope judged again, and opened once more."""
    items = _seeded(spark, sf_dir)[0]
    k = F.regexp_extract("url", r"(\d+)$", 1).cast("int") % 5
    queue = items.withColumn("attempts", F.coalesce(k, F.lit(0)) % 3)
    answers = queue.select("url_key", F.when(k == 0, "ok").when(k <= 2, "fetch_error").otherwise("denied").alias("status"), (k <= 2).alias("retryable"), F.when(k == 1, 5000.0).alias("not_before")).where(k != 4)
    after = crawl.settled(queue, answers, F.lit(1000.0))
    judged = crawl.scoped(after, crawl.scope_reason(F.col("url"), F.array(F.lit("directory")), F.col("depth"), urls.host_within(F.col("url"), "x.edu"), 2))
    opened = crawl.resumed(judged, F.lit(True), F.col("url"), F.lit(None).cast("double"), F.lit(2000.0))
    return opened.select("url_key", "state", "attempts", "retry_at", "scope_reason", crawl.intervals(urls.host(F.col("url")), ("h1.x.edu",)).alias("interval"))


SQL["crawl_outcomes"] = _SEEDED + """, q AS (
  SELECT url, min(depth) AS depth, CAST(regexp_extract(url, '(\\d+)$', 1) AS INTEGER) % 5 AS k FROM u WHERE NOT bad AND url NOT LIKE '%.pdf' GROUP BY url
), a AS (
  SELECT *, k % 3 + CASE WHEN k <> 4 THEN 1 ELSE 0 END AS attempts FROM q
), s AS (
  SELECT *, CASE WHEN k = 4 THEN 'pending' WHEN k = 0 THEN 'done' WHEN k <= 2 AND attempts < 3 THEN 'pending' ELSE 'unresolved' END AS s1, CASE WHEN k IN (1, 2) AND attempts < 3 THEN greatest(CASE WHEN k = 1 THEN 5000.0 ELSE 0.0 END, 1000 + 30 * pow(2, attempts)) ELSE 0.0 END AS r1,
    CASE WHEN depth > 2 THEN 'too_deep' END AS reason FROM a
), z AS (SELECT *, CASE WHEN reason IS NOT NULL AND s1 IN ('pending', 'unresolved') THEN 'scope_excluded' ELSE s1 END AS s2 FROM s)
SELECT url AS url_key, CASE WHEN s2 = 'unresolved' AND attempts < 3 THEN 'pending' ELSE s2 END AS state, attempts, CASE WHEN s2 = 'unresolved' AND attempts < 3 THEN 2000 + 30 * pow(2, attempts) ELSE r1 END AS retry_at, reason AS scope_reason,
  CASE WHEN url LIKE '%//h1.x.edu/%' THEN 10.0 ELSE 1.0 END AS "interval" FROM z"""


def crawl_next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _seeded(spark, sf_dir)[0]
    answers = table(spark, sf_dir, "events").where("user_id < 4").select(F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(".x.edu")).alias("host"), F.col("event_id").cast("double").alias("at"), F.when(F.col("user_id") == 2, 429).otherwise(200).alias("status"), F.lit(None).cast("double").alias("retry_after"))
    hosts = crawl.deferred(spark.createDataFrame([("h3.x.edu", 5.0, 1)], "host string, not_before double, failures int"), answers)
    return crawl.next_batch(items, hosts, F.lit(100.0), 3, 8).select("url_key", "host", "turn", "depth")


SQL["crawl_next_batch"] = _SEEDED + """, h AS (SELECT max(event_id) AS seen, count(*) AS n FROM events WHERE user_id = 2), q AS (
  SELECT url, min(depth) AS depth, regexp_extract(url, '//([^/]*)', 1) AS host FROM u WHERE NOT bad AND url NOT LIKE '%.pdf' GROUP BY url
), n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY depth, url) AS turn FROM q WHERE host <> 'h2.x.edu' OR (SELECT n = 0 OR seen + least(3600, 60 * pow(2, least(n - 1, 6))) <= 100 FROM h))
SELECT url AS url_key, host, CAST(turn AS INTEGER) AS turn, depth FROM n WHERE turn <= 3 ORDER BY turn, depth, url LIMIT 8"""


def selectors_rebound(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _seeded(spark, sf_dir)[0]
    decisions = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("http://www.h"), (F.col("c_custkey") % 6).cast("string"), F.lit(".x.edu/q/"), (F.col("c_custkey") % 90).cast("string"), F.lit("/")).alias("selector"))
    return crawl.rebound(decisions, items)


SQL["selectors_rebound"] = _SEEDED + """, q AS (SELECT DISTINCT url FROM u WHERE NOT bad AND url NOT LIKE '%.pdf'), d AS (SELECT c_custkey, 'h' || CAST(c_custkey % 6 AS VARCHAR) || '.x.edu/q/' || CAST(c_custkey % 90 AS VARCHAR) AS loose FROM customer)
SELECT c_custkey, coalesce(q.url, 'http://www.' || loose || '/') AS selector FROM d LEFT JOIN q ON q.url = 'https://' || loose"""

QUERIES |= {
    f.__name__: f
    for f in (
        merge_observed_fields, merge_observed_again, latest_check_wins, relationships_preserved, ambiguous_identities, consolidated_people, merged_lists, identity_key_edges, legacy_cleanup_log, review_verification,
        review_apply_merges, record_rules, reader_state, filtered_sorted_page, reader_labels, relevant_papers, crawl_seeds, crawl_outcomes, crawl_next_batch, selectors_rebound,
    )
}

"""The registered queries of the engine over the driver's tables, each beside its SQL.

Every query runs over its whole tables. A limit stands only where the operator is a top-k.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import page_queries, record_queries, text_queries
from quarry.functions import dates, html, text, urls
from quarry.operators import merge, quality, resolve, search, temporal
from quarry.plans import graph
from quarry.plans.shared import stored, table
from quarry.streaming import queue, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- text

NORMAL = "trim(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^\\p{{L}}\\p{{N}}@.+-]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({NORMAL.format('text')}) AS normal_md5 FROM documents")
def text_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("normal_md5"))


@query(
    f"""SELECT {NORMAL.format('p_name')} AS normal_name, min(p_partkey) AS first_key, count(*) AS copies
    FROM part WHERE p_name IS NOT NULL AND p_name NOT IN ('', 'Not found', 'Unknown') GROUP BY 1 HAVING {NORMAL.format('p_name')} <> ''"""
)
def distinct_normalized_keep_first(spark, sf):
    rows = table(spark, sf, "part").where(text.is_known(F.col("p_name"))).withColumn("normal_name", text.normalize(F.col("p_name")))
    return rows.where("normal_name <> ''").groupBy("normal_name").agg(F.min("p_partkey").alias("first_key"), F.count("*").alias("copies"))


@query(
    """SELECT doc_id, lower(nullif(regexp_extract(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}'), '')) AS email FROM documents"""
)
def first_email_extract(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.first_email(F.col("text")).alias("email"))


@query(
    """WITH e AS (SELECT doc_id, source, lower(nullif(regexp_extract(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}'), '')) AS email FROM documents),
    s AS (SELECT email, count(DISTINCT source) AS owners FROM e WHERE email IS NOT NULL GROUP BY email)
    SELECT doc_id, CASE WHEN owners >= 3 THEN NULL ELSE e.email END AS email FROM e LEFT JOIN s ON e.email = s.email"""
)
def shared_mailbox_null(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", text.first_email(F.col("text")).alias("email"))
    owners = rows.where("email is not null").groupBy("email").agg(F.count_distinct("source").alias("owners"))
    return rows.join(owners.where("owners >= 3"), "email", "left").select("doc_id", F.when(F.col("owners").isNull(), F.col("email")).alias("email"))


@query(
    """WITH f AS (SELECT doc_id, text, instr(lower(text), 'that the') AS no, instr(lower(text), 'with the') AS yes FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN no > 0 THEN 'no' WHEN yes > 0 THEN 'yes' ELSE 'unknown' END AS status,
      CASE WHEN no > 0 OR yes > 0 THEN trim(regexp_replace(substr(text, greatest(CASE WHEN no > 0 THEN no ELSE yes END - 110, 1),
        CASE WHEN no > 0 THEN no ELSE yes END + 8 + 130 - greatest(CASE WHEN no > 0 THEN no ELSE yes END - 110, 1)), '\\s+', ' ', 'g')) ELSE '' END AS snippet FROM f"""
)
def detect_phrase_snippet(spark, sf):
    """Negative phrases are looked for first."""
    rows = table(spark, sf, "documents").where("text is not null")
    no, yes = F.instr(F.lower("text"), "that the"), F.instr(F.lower("text"), "with the")
    at = F.when(no > 0, no).otherwise(yes)
    return rows.select(
        "doc_id", F.when(no > 0, "no").when(yes > 0, "yes").otherwise("unknown").alias("status"),
        F.when(at > 0, text.snippet(F.col("text"), at, F.lit(8))).otherwise("").alias("snippet"),
    )


@query(
    """SELECT doc_id, list_filter(regexp_split_to_array(replace(replace(replace(coalesce(text, ''), '. ', '.' || chr(1)), '! ', '!' || chr(1)), '? ', '?' || chr(1)), chr(1)),
      lambda s: length(s) BETWEEN 60 AND 260 AND (contains(lower(s), 'the') OR contains(lower(s), 'ung')))[1] AS summary
    FROM (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM documents)"""
)
def summary_first_sentence(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    return rows.select("doc_id", text.first_sentence(F.col("text"), ["the", "ung"]).alias("summary"))


TAGS = {"english function words": r"the|and|of", "german function words": r"der|die|und", "spanish function words": r"que|los|una", "french function words": r"les|une|dans"}


@query(
    "SELECT doc_id, tag FROM documents, (VALUES "
    + ", ".join(f"('{k}', '(?:^|[^a-z])(?:{v})(?:[^a-z]|$)')" for k, v in TAGS.items())
    + ") AS t(tag, pattern) WHERE regexp_matches(lower(text), pattern)"
)
def tag_regex_dictionary(spark, sf):
    """Label dictionary: each label's pattern as whole words. One pass: the labels are an array of conditions, not a join."""
    low = F.lower("text")
    tags = F.array_compact(F.array(*[F.when(low.rlike(f"(?:^|[^a-z])(?:{p})(?:[^a-z]|$)"), F.lit(k)) for k, p in TAGS.items()]))
    return table(spark, sf, "documents").select("doc_id", F.explode(tags).alias("tag"))


# --- search


def _index(spark, sf):
    """The normal forms, written once: searches read them and compute none."""
    return stored(spark, f"search index of {sf}", lambda: _built(spark, sf))


def _built(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    first = F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^\n]*", 0)
    return search.build_index(docs, first, F.col("lang"), F.col("source"), F.col("source"), F.col("text"))


_FACTS = "4 * coalesce(quality, 0)"
INDEX_SQL = f"""idx AS (SELECT d.doc_id, lang, source, coalesce(quality, 0) AS quality, ' ' || {NORMAL.format('text')} || ' ' AS hay,
  ' ' || {NORMAL.format("regexp_extract(coalesce(text, ''), '^[^' || chr(10) || ']*')")} || ' ' AS nm, ' ' || {NORMAL.format('lang')} || ' ' AS ar,
  ' ' || {NORMAL.format('source')} || ' ' AS dp FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _place_sql(w: str) -> str:
    inside = f"WHEN contains(nm, '{w}') THEN 8" if len(w) > 3 else ""
    has = f"contains({{0}}, '{w}')" if len(w) > 2 else f"contains({{0}}, ' {w}')"
    return (
        f"CASE WHEN starts_with(nm, ' {w}') THEN 18 WHEN contains(nm, ' {w}') THEN 14 {inside} WHEN {has.format('ar')} THEN 7 "
        f"WHEN {has.format('dp')} THEN 6 WHEN {has.format('hay')} THEN 2 ELSE 0 END"
    )


def _search_sql(terms: list[list[str]], phrase: str, need: int) -> str:
    match = ["(" + " OR ".join(f"contains(hay, '{w}')" if len(w) > 2 else f"contains(hay, ' {w}')" for w in t) + ")" for t in terms]
    best = [f"CASE WHEN greatest({', '.join(_place_sql(w) for w in t)}) = 0 THEN 1 ELSE greatest({', '.join(_place_sql(w) for w in t)}) END" for t in terms]
    score = "4 * quality" + "".join(f" + CASE WHEN {m} THEN 20 + {b} ELSE 0 END" for m, b in zip(match, best, strict=True))
    if phrase:
        score += f" + CASE WHEN contains(nm, '{phrase}') THEN 25 WHEN contains(hay, '{phrase}') THEN 8 ELSE 0 END"
    matched = " + ".join(f"CAST({m} AS INT)" for m in match)
    return f"SELECT doc_id, {matched} AS matched, CAST({score} AS DOUBLE) AS score FROM idx WHERE {matched} >= {need}"


_TWO = search.compile_query("Nation the", {"nation": ["tion"]})


@query(f"WITH {INDEX_SQL} {_search_sql([['nation', 'tion'], ['the']], 'nation the', 2)} ORDER BY score DESC, doc_id LIMIT 40")
def search_ranked(spark, sf):
    """The first page of a ranked search: a top-k."""
    out = search.search(_index(spark, sf), _TWO, F.expr(_FACTS))
    return out.select("doc_id", "matched", "score").orderBy(F.desc("score"), "doc_id").limit(40)


@query(f"WITH {INDEX_SQL} {_search_sql([['nation', 'tion'], ['the']], 'nation the', 2)}")
def search_all_matches(spark, sf):
    return search.search(_index(spark, sf), _TWO, F.expr(_FACTS)).select("doc_id", "matched", "score")


@query(f"WITH {INDEX_SQL} {_search_sql([['the'], ['zzqx'], ['and']], 'the zzqx and', 2)}")
def search_relaxed(spark, sf):
    """No record has all three terms, so two are enough."""
    out = search.search_relaxed(_index(spark, sf), search.compile_query("the zzqx and"), F.expr(_FACTS))
    return out.select("doc_id", "matched", "score")


@query(f"SELECT p_partkey FROM part WHERE contains(' ' || {NORMAL.format('p_name')} || ' ', ' al') OR contains(' ' || {NORMAL.format('p_name')} || ' ', ' sm')")
def search_short_term_word_start(spark, sf):
    rows = table(spark, sf, "part").withColumn("haystack", text.padded(F.col("p_name")))
    return rows.where(search.term_matches(search.Term("al", ["al", "sm"]))).select("p_partkey")


@query(
    """SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(strip_accents(coalesce(text, ''))), '[^\\p{L}\\p{N}]+')) AS token FROM documents)
    WHERE regexp_full_match(token, '\\p{L}{3,}') GROUP BY token"""
)
def vocabulary_df(spark, sf):
    return search.vocabulary(table(spark, sf, "documents"), F.col("text"))


@query(
    """WITH v AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(strip_accents(coalesce(text, ''))), '[^\\p{L}\\p{N}]+')) AS token FROM documents) WHERE regexp_full_match(token, '\\p{L}{3,}') GROUP BY token),
    c AS (SELECT token, df, substr(token, 1, 9) AS st, damerau_levenshtein('wrothless', token) AS w, damerau_levenshtein('wrothless', substr(token, 1, 9)) AS p FROM v WHERE substr(token, 1, 1) = 'w' OR substr(token, 2, 1) = 'r'),
    r AS (SELECT CASE WHEN w <= 2 THEN token ELSE st END AS text, CASE WHEN w <= 2 THEN 2 * w WHEN length(token) > 9 AND p <= 2 THEN 5 END AS rank, df FROM c)
    SELECT text, CAST(sum(df) AS BIGINT) AS df FROM r WHERE rank = (SELECT min(rank) FROM r) AND NOT EXISTS (SELECT 1 FROM v WHERE contains(token, 'wrothless')) GROUP BY text ORDER BY 2 DESC, 1 LIMIT 4"""
)
def spelling_corrections(spark, sf):
    """A transposition and what it may stand for."""
    return search.corrections(search.vocabulary(table(spark, sf, "documents"), F.col("text")), "wrothless")


@query(
    f"""WITH e AS (SELECT 'brand' AS kind, p_brand AS label, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY 2),
    s AS (SELECT *, ' ' || {NORMAL.format('label')} || ' ' AS l FROM e),
    r AS (SELECT kind, label, n, CASE WHEN trim(l) = 'br' THEN 10 WHEN starts_with(l, ' br') THEN 8 WHEN contains(l, ' br') THEN 6 END AS rank_score FROM s),
    p AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY rank_score DESC, n DESC, label) AS INT) AS place FROM r WHERE rank_score IS NOT NULL)
    SELECT * FROM p WHERE place <= CASE kind WHEN 'brand' THEN 5 ELSE 3 END"""
)
def suggest_group_topk(spark, sf):
    part = table(spark, sf, "part")
    entries = [part.groupBy(F.col(c).alias("label")).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "label", "n") for k, c in (("brand", "p_brand"), ("type", "p_type"))]
    return search.suggestions(entries[0].unionByName(entries[1]), "br", {"brand": 5, "type": 3})


_CHOSEN = {"p_brand": "p_size >= 1 AND p_brand LIKE 'Brand#1%'", "p_type": "p_type LIKE '%E%'", "p_size": "p_size <= 25"}


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, count(DISTINCT p_partkey) AS n FROM part WHERE "
        + " AND ".join(f"({v})" for k, v in _CHOSEN.items() if k != c)
        + " GROUP BY 2"
        for c in _CHOSEN
    )
)
def facet_self_excluding(spark, sf):
    return search.self_excluding_facets(table(spark, sf, "part"), {c: F.expr(v) for c, v in _CHOSEN.items()}, "p_partkey")


@query(
    """SELECT c_mktsegment, o_orderstatus, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
    GROUP BY GROUPING SETS ((c_mktsegment), (o_orderstatus), (o_orderpriority), (c_mktsegment, o_orderstatus), ())"""
)
def facet_grouping_sets(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    keys = ["c_mktsegment", "o_orderstatus", "o_orderpriority"]
    return rows.groupingSets([[k] for k in keys] + [keys[:2], []], *keys).agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT r_name, n_name, count(s_suppkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT r_name, n_name, n, n / nullif(sum(n) OVER (PARTITION BY r_name), 0) AS share FROM c QUALIFY row_number() OVER (PARTITION BY r_name ORDER BY n DESC, n_name) <= 3"""
)
def facet_topn_children(spark, sf):
    """Drill-down: the first three children of each parent, with their share of it."""
    counted = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = nations.join(counted, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("r_name", "n_name", F.coalesce("n", F.lit(0)).alias("n"))
    parent = Window.partitionBy("r_name")
    rows = rows.withColumns({"share": F.col("n") / F.nullif(F.sum("n").over(parent), F.lit(0)), "k": F.row_number().over(parent.orderBy(F.desc("n"), "n_name"))})
    return rows.where("k <= 3").drop("k")


@query(
    """SELECT s_suppkey, CASE WHEN s_acctbal IS NULL OR n IS NULL THEN -1.0 ELSE round(s_acctbal, 2) * 1000 + least(n, 999) END AS rating_order
    FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey"""
)
def rating_sort(spark, sf):
    """Score before number; what is missing sorts last and is never zero."""
    n = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    value = F.round("s_acctbal", 2) * 1000 + F.least(F.col("n"), F.lit(999))
    return rows.select("s_suppkey", F.coalesce(value, F.lit(-1.0)).alias("rating_order"))


# --- merging


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def latest_observation_wins(spark, sf):
    rows = table(spark, sf, "events").where("value is not null").select("user_id", "event_type", "ts", "event_id", "value")
    return merge.latest(rows, ["user_id", "event_type"], "ts", ["event_id"])


@query(
    """SELECT event_id, user_id, event_type, ts, value, next_value, replaced_at FROM (SELECT *, lead(value) OVER w AS next_value, lead(ts) OVER w AS replaced_at FROM events
    WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE next_value <> value"""
)
def observation_history(spark, sf):
    rows = table(spark, sf, "events").where("value is not null").select("event_id", "user_id", "event_type", "ts", "value")
    return merge.history(rows, ["user_id", "event_type"], "value", "ts", ["event_id"])


@query(
    """SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'source_checked' WHEN arg_max(event_type, (ts, event_id)) <> 'error' THEN 'needs_review' ELSE 'unavailable' END AS status
    FROM events GROUP BY user_id"""
)
def verification_status_case(spark, sf):
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("checked"), last.alias("last"))
    return rows.select("user_id", merge.status_of(F.col("checked"), F.when(F.col("last") == "error", "error").otherwise("ok")).alias("status"))


@query("SELECT sha256(props) AS fingerprint, min(event_id) AS event_id, count(*) AS times FROM events WHERE props IS NOT NULL GROUP BY 1")
def patch_idempotent_fingerprint(spark, sf):
    rows = table(spark, sf, "events").where("props is not null").select("event_id", F.sha2("props", 256).alias("fingerprint"))
    return merge.apply_once(rows, "event_id").select("fingerprint", "event_id", "times")


@query(
    """WITH p AS (SELECT l_partkey, l_returnflag, avg(l_quantity) AS score, count(*) AS reviews FROM lineitem GROUP BY 1, 2)
    SELECT l_partkey, arg_max(l_returnflag, (reviews, l_returnflag)) AS platform, round(arg_max(score, (reviews, l_returnflag)), 6) AS score, max(reviews) AS reviews FROM p GROUP BY 1"""
)
def best_rating_argmax(spark, sf):
    rated = table(spark, sf, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("platform")).agg(F.avg("l_quantity").alias("score"), F.count("*").alias("reviews"))
    return merge.best_rating(rated, "l_partkey", "platform", "score", "reviews").withColumn("score", F.round("score", 6))


@query(
    """SELECT c_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority, arg_min(o_orderstatus, CASE WHEN o_orderstatus <> 'O' THEN (o_totalprice, o_orderkey) END)
    AS settled_status FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1"""
)
def golden_record_best_known(spark, sf):
    """Each field has its own order of preference, and unknown values never win."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    newest = F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("priority")
    settled = rows.withColumn("s", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")))
    one = merge.golden(settled, "c_custkey", {"settled_status": F.col("s")}, [F.col("o_totalprice"), F.col("o_orderkey")])
    return rows.groupBy("c_custkey").agg(newest).join(one, "c_custkey")


@query(
    """SELECT p_brand, p_type, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS kept, count(*) AS merged, list_sort(list(DISTINCT p_size)) AS sizes FROM part GROUP BY 1, 2"""
)
def consolidate_by_key_quality(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand", "p_type").agg(
        F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("kept"), F.count("*").alias("merged"), F.array_sort(F.collect_set("p_size")).alias("sizes")
    )


# --- resolution

_NAMED = "SELECT {k} AS id, {n} AS nation, lower(regexp_replace({c}, '[^A-Za-z0-9]+', ' ', 'g')) AS name FROM {t}"


@query(
    """SELECT text, min(doc_id) AS root, doc_id FROM (SELECT md5(text) AS text, doc_id, min(doc_id) OVER (PARTITION BY text) AS m FROM documents WHERE text IS NOT NULL) GROUP BY text, doc_id, m""".replace(
        "SELECT text, min(doc_id) AS root, doc_id", "SELECT m AS root, doc_id"
    )
)
def union_find_components(spark, sf):
    """Documents of the same text are one entity; the alias closure of pairs with the first copy."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.xxhash64("text").alias("a"), F.md5("text").alias("b"))
    first = docs.groupBy("a", "b").agg(F.min("doc_id").alias("u"), F.count("*").alias("n")).where("n > 1")
    pairs = docs.join(first, ["a", "b"]).where("doc_id <> u").select("u", F.col("doc_id").alias("v"))
    roots = resolve.canonical_ids(pairs)
    return docs.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))


@query(
    """WITH c AS (SELECT c_custkey AS record_id, c_nationkey AS scope, string_split(lower(trim(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS t FROM customer),
    p AS (SELECT s_suppkey AS person_id, s_nationkey AS scope, string_split(lower(trim(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS p FROM supplier),
    j AS (SELECT record_id, person_id, p, t = p AS exact, len(p) >= len(t) AND p[len(p) - len(t) + 1:] = t AS suffix FROM c JOIN p ON c.scope = p.scope AND t[-1] = p[-1]),
    g AS (SELECT record_id, list_sort(list(DISTINCT person_id) FILTER (WHERE exact)) AS exact, list_sort(list(DISTINCT person_id) FILTER (WHERE suffix)) AS suffix,
      count(DISTINCT p) FILTER (WHERE suffix) AS n FROM j GROUP BY 1)
    SELECT c.record_id, CASE WHEN len(exact) > 0 THEN exact WHEN n = 1 THEN suffix ELSE CAST([] AS BIGINT[]) END AS person_ids,
      CASE WHEN len(exact) > 0 THEN 'exact_name_same_scope' WHEN n = 1 THEN 'unique_surname_same_scope' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS method
    FROM c LEFT JOIN g ON g.record_id = c.record_id"""
)
def cascade_match_unique(spark, sf):
    records = table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("scope"))
    roster = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("scope"))
    return resolve.match_names(records, roster)


@query(
    """WITH m AS (SELECT c_nationkey, regexp_extract(c_name, '([0-9])$', 1) AS digit, count(*) AS customers, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY 1, 2)
    SELECT c_nationkey, digit, customers, CASE WHEN segments = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM m"""
)
def ambiguous_unmatched(spark, sf):
    """A block names an entity only if all its records agree."""
    rows = table(spark, sf, "customer").groupBy("c_nationkey", F.regexp_extract("c_name", "([0-9])$", 1).alias("digit"))
    out = rows.agg(F.count("*").alias("customers"), F.count_distinct("c_mktsegment").alias("segments"))
    return out.select("c_nationkey", "digit", "customers", F.when(F.col("segments") == 1, "matched").otherwise("ambiguous").alias("status"))


@query(
    """WITH a AS (SELECT o_orderkey AS alias, min(o_orderkey) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS canonical FROM orders)
    SELECT canonical AS l_orderkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN a ON l_orderkey = alias GROUP BY 1"""
)
def alias_fk_remap(spark, sf):
    """Orders of one customer on one day are one entity; line items count for its least key."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    first = orders.groupBy("o_custkey", "day").agg(F.min("o_orderkey").alias("root"))
    names = orders.join(first, ["o_custkey", "day"]).select(F.col("o_orderkey").alias("node"), "root")
    lines = table(spark, sf, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    moved = resolve.remap(lines.select("l_orderkey", "l_quantity"), "l_orderkey", names)
    return moved.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    """SELECT a.c_custkey AS left_key, b.c_custkey AS right_key FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment
    AND floor(a.c_acctbal / 10) = floor(b.c_acctbal / 10) AND a.c_custkey < b.c_custkey"""
)
def blocked_identity_join(spark, sf):
    """Pairs for review: records of one block whose identifying values agree."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 10).alias("band"))
    left = rows.withColumnRenamed("c_custkey", "left_key")
    return left.join(rows.withColumnRenamed("c_custkey", "right_key"), ["c_nationkey", "c_mktsegment", "band"]).where("left_key < right_key").select("left_key", "right_key")


@query(
    """WITH c AS (SELECT c_custkey AS record_id, c_nationkey AS scope, list_distinct(string_split(lower(trim(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')) AS t,
      string_split(lower(trim(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')[-1] AS last FROM customer),
    s AS (SELECT s_suppkey AS person_id, s_nationkey AS scope, list_distinct(string_split(lower(trim(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')) AS t,
      string_split(lower(trim(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')[-1] AS last FROM supplier),
    j AS (SELECT record_id, person_id, round(least(1.0, len(list_intersect(c.t, s.t)) / greatest(len(c.t), len(s.t)) + CASE WHEN c.last = s.last THEN 0.2 ELSE 0 END + CASE WHEN c.scope = s.scope THEN 0.2 ELSE 0 END), 6) AS score
      FROM c, s) SELECT * FROM j WHERE score >= 0.55"""
)
def author_match_score(spark, sf):
    records = table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("scope"))
    roster = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("scope"))
    return resolve.author_matches(records, roster)


@query(
    """SELECT 'both' AS side, c_nationkey AS nation FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'customers only', c_nationkey FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'suppliers only', s_nationkey FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)"""
)
def set_operations(spark, sf):
    left = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    right = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    parts = {"both": left.intersect(right), "customers only": left.subtract(right), "suppliers only": right.subtract(left)}
    named = [df.select(F.lit(k).alias("side"), "nation") for k, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(
    """WITH o AS (SELECT c_nationkey AS key, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1), w AS (SELECT s_nationkey AS key, count(*) AS n FROM supplier GROUP BY 1)
    SELECT coalesce(o.key, w.key) AS key, o.n AS before, w.n AS after, CASE WHEN o.n IS NULL THEN 'added' WHEN w.n IS NULL THEN 'removed' WHEN o.n = w.n THEN 'same' ELSE 'changed' END AS change
    FROM o FULL JOIN w ON o.key = w.key"""
)
def plan_history_full_outer(spark, sf):
    """Two versions of a plan side by side: nothing of either is lost."""
    old = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("before"))
    new = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return old.join(new, "key", "full").withColumn("change", change)


# --- validation


@query("SELECT o_custkey, count(*) AS facts FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0) GROUP BY 1")
def fk_integrity_anti(spark, sf):
    return quality.missing_references(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer").where("c_acctbal >= 0"), "c_custkey")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS key, rule FROM orders, (VALUES ('price_positive'), ('status_known'), ('priority_known')) r(rule)
    WHERE NOT coalesce(CASE rule WHEN 'price_positive' THEN o_totalprice > 1000 WHEN 'status_known' THEN o_orderstatus IN ('F', 'O') ELSE o_orderpriority LIKE '_-%' END, FALSE)"""
)
def rule_violations_report(spark, sf):
    rules = {"price_positive": F.col("o_totalprice") > 1000, "status_known": F.col("o_orderstatus").isin("F", "O"), "priority_known": F.col("o_orderpriority").like("_-%")}
    return quality.violations(table(spark, sf, "orders"), "o_orderkey", rules)


@query(
    """SELECT s_suppkey AS key, '' AS field, 'removed' AS change FROM supplier WHERE s_acctbal < 0
    UNION ALL SELECT s_suppkey, 's_name', 'lost' FROM supplier WHERE s_acctbal >= 0 AND s_nationkey < 5 AND s_name IS NOT NULL
    UNION ALL SELECT s_suppkey, 's_acctbal', 'changed' FROM supplier WHERE s_acctbal > 5000"""
)
def preservation_audit(spark, sf):
    """A rebuilt copy of all suppliers that lost the indebted, some names and some balances, against the whole baseline."""
    base = table(spark, sf, "supplier")
    name = F.when(F.col("s_nationkey") >= 5, F.col("s_name"))
    balance = F.when(F.col("s_acctbal") > 5000, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal"))
    return quality.preservation(base, base.where("s_acctbal >= 0").withColumns({"s_name": name, "s_acctbal": balance}), "s_suppkey")


@query(
    """SELECT unnest(['rows', 'texts', 'distinct_texts', 'languages', 'long_texts']) AS metric,
      unnest([count(*), count(text), count(DISTINCT md5(text)), count(DISTINCT lang), count(*) FILTER (WHERE n_chars > 2000)]) AS value FROM documents"""
)
def dataset_profile_metrics(spark, sf):
    metrics = {
        "rows": F.count("*"), "texts": F.count("text"), "distinct_texts": F.count_distinct(F.md5("text")), "languages": F.count_distinct("lang"),
        "long_texts": F.count_if(F.col("n_chars") > 2000),
    }
    return quality.profile(table(spark, sf, "documents"), metrics)


@query("SELECT n_nationkey, n_name, count(s_suppkey) AS records FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def coverage_left_join_zero(spark, sf):
    suppliers = table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return quality.coverage(table(spark, sf, "nation"), suppliers, "n_nationkey").select("n_nationkey", "n_name", "records")


@query(
    """SELECT n_name, CASE WHEN buyers = 0 THEN 'none' WHEN buyers < customers THEN 'partial' ELSE 'complete' END AS status FROM (
    SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_custkey) AS buyers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"""
)
def coverage_status_case(spark, sf):
    buyers = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("buys", F.lit(1))
    counted = table(spark, sf, "customer").join(buyers, "c_custkey", "left").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.count("buys").alias("buyers"))
    rows = table(spark, sf, "nation").join(counted, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("customers", "buyers")])
    return rows.select("n_name", F.when(F.col("buyers") == 0, "none").when(F.col("buyers") < F.col("customers"), "partial").otherwise("complete").alias("status"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)")
def candidate_rejected_anti(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(returned, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query(
    """SELECT item_id AS quote_id, doc_id AS capture_id, 'ok' AS status FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')),
    trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) AND substr(b.text, 1, 1) <> ''"""
)
def quote_proof_check(spark, sf):
    """Which captured texts hold which quotes. Quotes with a whole word inside are blocked by their longest one, so that only texts with
    this word are compared; the others (of two words at most) are compared with every text."""
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("capture_id"), one(F.col("text")).alias("body"))
    quotes = table(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), one(F.col("text")).alias("quote")).where("quote <> ''")
    # the first and the last word of a quote may be parts of words of the text
    w = F.split("quote", " ")
    longest = F.array_max(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    keyed = quotes.withColumn("key", longest)
    # the blocks' keys are distinct words of texts; texts come to their few candidates, not along with their words
    words = docs.select("capture_id", F.explode(F.split("body", " ")).alias("key"))
    candidates = words.join(keyed.where("key is not null").select("key", "quote_id"), "key").select("capture_id", "quote_id").distinct()
    found = candidates.join(quotes, "quote_id").join(docs, "capture_id").where(F.contains("body", F.col("quote")))
    short = docs.join(keyed.where("key is null"), F.contains("body", F.col("quote")))
    return found.select("quote_id", "capture_id").unionByName(short.select("quote_id", "capture_id")).select("quote_id", "capture_id", F.lit("ok").alias("status"))


# --- pages

_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)"
_KEY = f"lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN length({_QUERY}) > 1 THEN {_QUERY} ELSE '' END"
_COMPARE = f"""regexp_replace({_HOST}, '^www\\.', '') || regexp_replace(rtrim({_PATH}, '/'), '/index\\.(?:html?|php)$', '') ||
  CASE WHEN len(list_filter(string_split(substr({_QUERY}, 2), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|gclid|fbclid)(=|$)'))) > 0
  THEN '?' || array_to_string(list_filter(string_split(substr({_QUERY}, 2), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|gclid|fbclid)(=|$)')), '&') ELSE '' END"""


@query(f"SELECT page_id, {_KEY} AS url_key, {_COMPARE} AS comparison_key, TRUE AS valid FROM pages")
def url_keys(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.url_key(url).alias("url_key"), urls.comparison_key(url).alias("comparison_key"), urls.valid_url(url).alias("valid"))


@query(f"SELECT {_COMPARE} AS group_key, count(*) AS members, min(page_id) AS first_member FROM pages GROUP BY 1 HAVING count(*) > 1")
def duplicate_url_groups(spark, sf):
    return quality.duplicate_groups(table(spark, sf, "pages"), urls.comparison_key(F.col("url")), "page_id")


@query(f"SELECT {_HOST} AS host, count(*) AS pages, sum(strlen(html)) AS bytes, count(*) FILTER (WHERE {_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org') AS within FROM pages GROUP BY 1")
def host_rollup(spark, sf):
    rows = table(spark, sf, "pages")
    within = F.count_if(urls.host_within(F.col("url"), "example.org")).alias("within")
    return rows.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.octet_length("html")).alias("bytes"), within)


@query("SELECT page_id, sha256(html) AS sha256, strlen(html) AS bytes FROM pages")
def body_hash_check(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"))


_PLAIN = "trim(regexp_replace(" + "replace(" * len(html.REFERENCES) + "regexp_replace({0}, '<[^>]*>', ' ', 'g')" + "".join(f", '&{k};', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in html.REFERENCES.items()) + ", '\\s+', ' ', 'g'))"
_LINKS = rf"""l AS (SELECT page_id, url, regexp_extract_all(coalesce(html, ''), '(?is)<a\s(?:[^>]*?\s)?href="[^"]*"[^>]*>.*?</a>') AS tags FROM pages), t AS (SELECT page_id, url, CAST(unnest(range(len(tags))) AS BIGINT) AS position, unnest(tags) AS tag FROM l),
h AS (SELECT *, replace(regexp_replace(regexp_extract(tag, '(?is)href="([^"]*)"', 1), '#.*$', ''), '&amp;', '&') AS href, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') AS root FROM t),
k AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '/%' THEN root || href WHEN href = '' THEN regexp_replace(url, '#.*$', '') ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END AS target FROM h)"""


@query(f"SELECT page_id, nullif({_PLAIN.format("regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title FROM pages")
def page_title_regex(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(f"WITH {_LINKS} SELECT page_id, position, target, {_PLAIN.format('tag')} AS label FROM k")
def page_links(spark, sf):
    return html.links(table(spark, sf, "pages"), "page_id", "url", "html")


@query(
    """WITH RECURSIVE e AS (SELECT l_orderkey AS u, l_partkey AS v FROM lineitem UNION SELECT l_partkey + 1000000, l_orderkey FROM lineitem WHERE l_quantity > 48),
    r(node, depth) AS (SELECT DISTINCT l_orderkey, 0 FROM lineitem WHERE l_orderkey < 5 UNION SELECT v, depth + 1 FROM r JOIN e ON e.u = r.node WHERE depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node"""
)
def link_bfs(spark, sf):
    """Least distances from five orders, three steps far, over orders and parts whose numbers are one space."""
    lines = table(spark, sf, "lineitem")
    edges = lines.select(F.col("l_orderkey").alias("u"), F.col("l_partkey").alias("v")).unionByName(lines.where("l_quantity > 48").select((F.col("l_partkey") + 1_000_000).alias("u"), F.col("l_orderkey").alias("v")))
    return graph.reach(edges, lines.where("l_orderkey < 5").select(F.col("l_orderkey").alias("node")), 3)


@query(
    f"""WITH {_LINKS}, f AS (SELECT DISTINCT target FROM k WHERE regexp_matches(target, '^https?://[^/?#]+') AND NOT regexp_matches(target, '\\s')), p AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url FROM pages)
    SELECT lower(regexp_extract(target, '://([^/:?#]*)', 1)) AS host, count(*) AS links, count(p.url) AS captured FROM f LEFT JOIN p ON p.url = target GROUP BY 1"""
)
def link_targets_captured(spark, sf):
    """Hosts' distinct links found, and how many of them are pages that were captured."""
    pages = table(spark, sf, "pages")
    found = html.links(pages, "page_id", "url", "html").select(urls.url_key(F.col("target")).alias("key")).where("key <> ''").distinct()
    known = pages.select(urls.url_key(F.col("url")).alias("key")).distinct().withColumn("captured", F.lit(1))
    return found.join(known, "key", "left").groupBy(urls.host(F.col("key")).alias("host")).agg(F.count("*").alias("links"), F.count("captured").alias("captured"))


# --- nested rows, dates, the queue, windows


@query(
    """SELECT l_orderkey, l_linenumber, measure, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
    UNPIVOT (value FOR measure IN (l_quantity, l_discount, l_tax))"""
)
def wide_to_long_terms(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "value").where("value is not null")


@query(
    """SELECT conv_id, turn, role, last_value(CASE WHEN role = 'system' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS header FROM conversations"""
)
def forward_fill_header(spark, sf):
    over = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.last(F.when(F.col("role") == "system", F.md5("text")), ignorenulls=True).over(over)
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", header.alias("header"))


@query("SELECT conv_id, list(role ORDER BY turn, role) AS roles, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY 1")
def nested_group_conversation(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"])
    return rows.agg(turns.alias("roles"), F.count("*").alias("turns"), F.sum(F.char_length("text")).alias("chars"))


_TERM = "CASE WHEN month(o_orderdate) <= 3 THEN 'Winter' WHEN month(o_orderdate) <= 6 THEN 'Spring' WHEN month(o_orderdate) <= 8 THEN 'Summer 1' ELSE 'Fall' END || ' ' || year(o_orderdate)"


@query(
    f"""SELECT term, CAST(right(term, 4) AS INT) * 10 + CASE split_part(term, ' ', 1) WHEN 'Winter' THEN 1 WHEN 'Spring' THEN 2 WHEN 'Summer' THEN 3 ELSE 4 END AS term_order,
    CASE WHEN make_date(CAST(right(term, 4) AS INT), CASE WHEN term LIKE 'Winter%' THEN 3 WHEN term LIKE 'Spring%' THEN 6 WHEN term LIKE 'Summer%' THEN 8 ELSE 12 END, 28) < DATE '2023-06-30'
    THEN 'historical' ELSE 'scheduled' END AS term_status, count(*) AS orders FROM (SELECT {_TERM} AS term FROM orders) GROUP BY 1"""
)
def term_order_status(spark, sf):
    rows = table(spark, sf, "orders").select(F.expr(_TERM).alias("term")).groupBy("term").agg(F.count("*").alias("orders"))
    return rows.select("term", dates.term_order(F.col("term")).alias("term_order"), dates.term_status(F.col("term"), F.lit("2023-06-30").cast("date")).alias("term_status"), "orders")


@query("SELECT strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d') AS local_day, count(*) AS n FROM events GROUP BY 1")
def local_calendar_date(spark, sf):
    """The events' month has one offset in this zone."""
    return table(spark, sf, "events").groupBy(F.date_format(dates.local_date(F.col("ts")), "yyyy-MM-dd").alias("local_day")).agg(F.count("*").alias("n"))


@query("SELECT user_id, min(event_id % 5) AS depth, list_sort(list(DISTINCT event_type)) AS contexts, count(*) AS requests FROM events GROUP BY 1")
def queue_upsert_min_depth(spark, sf):
    return queue.upsert(table(spark, sf, "events").withColumn("depth", F.col("event_id") % 5), "user_id", "depth", "event_type")


_TRIES = """t AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, max(ts) FILTER (WHERE event_type = 'error') AS last_failure,
  count(*) FILTER (WHERE event_type = 'purchase') AS successes FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1),
  s AS (SELECT *, CASE WHEN successes > 0 THEN 'done' WHEN failures >= 3 THEN 'unresolved' ELSE 'pending' END AS state FROM t)"""


def _attempts(spark, sf):
    rows = table(spark, sf, "events").where(F.col("event_type").isin("error", "purchase"))
    return queue.schedule(rows, "user_id", "ts", F.col("event_type") == "error")


@query(f"WITH {_TRIES} SELECT user_id, failures, successes, state, CASE WHEN state = 'pending' THEN last_failure + to_seconds(CAST(30 * pow(2, failures) AS INT)) END AS retry_at FROM s")
def queue_backoff_schedule(spark, sf):
    return _attempts(spark, sf).select("user_id", "failures", "successes", "state", "retry_at")


@query(f"WITH {_TRIES} SELECT state, count(*) AS items FROM s GROUP BY 1")
def queue_state_histogram(spark, sf):
    return _attempts(spark, sf).groupBy("state").agg(F.count("*").alias("items"))


@query(
    """SELECT event_id, user_id, waited_us FROM (SELECT event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS waited_us FROM events) WHERE waited_us < 600000000"""
)
def host_min_interval(spark, sf):
    return queue.too_soon(table(spark, sf, "events"), "user_id", "ts", 600, "event_id").select("event_id", "user_id", "waited_us")


@query("SELECT user_id, event_type, ts, arg_min(event_id, (event_id)) AS event_id FROM events e WHERE (ts, event_id) IN (SELECT (min(ts), arg_min(event_id, (ts, event_id))) FROM events GROUP BY user_id) GROUP BY ALL")
def queue_next_per_host(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return queue.next_per_host(rows, "user_id", ["ts", "event_id"])


@query(
    """SELECT state, count(*) AS users FROM (SELECT user_id, CASE WHEN epoch(TIMESTAMP '2024-02-05 00:00:00') - floor(epoch(max(ts))) BETWEEN 0 AND 7 * 86400 THEN 'retained_prior_evidence' ELSE 'pending' END AS state
    FROM events WHERE event_type = 'signup' GROUP BY 1) GROUP BY 1"""
)
def ttl_retain_recent(spark, sf):
    seen = table(spark, sf, "events").where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("checked_at"))
    return queue.retained(seen, "checked_at", F.to_timestamp(F.lit("2024-02-05 00:00:00")), 7).groupBy("state").agg(F.count("*").alias("users"))


@query(
    """SELECT c_custkey, seen_at FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS seen_at FROM orders GROUP BY 1) ON o_custkey = c_custkey
    ORDER BY seen_at IS NOT NULL, seen_at, c_custkey LIMIT 50"""
)
def budget_topk_never_seen_first(spark, sf):
    seen = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("seen_at"))
    return queue.budgeted(table(spark, sf, "customer").select("c_custkey").join(seen, "c_custkey", "left"), "seen_at", "c_custkey", 50)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def tumbling_window_events(spark, sf):
    return windows.windowed(table(spark, sf, "events"), "ts", "event_type", "value", "1 day")


@query(
    """SELECT w AS window_start, w + INTERVAL 2 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM (SELECT *, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY 1, 2, 3"""
)
def sliding_window_events(spark, sf):
    return windows.windowed(table(spark, sf, "events"), "ts", "event_type", "value", "2 days", "1 day")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_window_events(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "ts", "user_id", "6 hours")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def streamed_window_events(spark, sf):
    """The same windows by Structured Streaming, over all events that are there."""
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]")
    return windows.drained(windows.windowed(stream, "ts", "event_type", "value", "1 day"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_pointer_props(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@query(
    """WITH v AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT p.event_id, p.user_id, v.event_id AS right_event_id FROM events p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts WHERE p.event_type = 'purchase'"""
)
def asof_last_view(spark, sf):
    """Each purchase with the user's last view before it."""
    e = table(spark, sf, "events")
    return temporal.asof(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", "ts", ["event_id"]).select("event_id", "user_id", "right_event_id")


@query(
    """SELECT p_partkey, c_nationkey AS nation, count(*) AS n FROM part JOIN customer ON p_retailprice BETWEEN c_acctbal AND c_acctbal + 10 * (c_custkey % 5) WHERE p_partkey % 7 = 0 GROUP BY 1, 2"""
)
def prices_in_ranges(spark, sf):
    """Parts whose price lies in a customer's range, by nation."""
    c = table(spark, sf, "customer")
    met = temporal.in_ranges(table(spark, sf, "part").where("p_partkey % 7 = 0"), F.col("p_retailprice"), c, F.col("c_acctbal"), F.col("c_acctbal") + 10 * (F.col("c_custkey") % 5), 25.0)
    return met.groupBy("p_partkey", F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))


@query(
    """SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"""
)
def cube_flags(spark, sf):
    rows = table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return rows.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "quantity")


@query(
    """SELECT coalesce(r_name, '*') AS region, coalesce(n_name, '*') AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"""
)
def rollup_regions(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("customers")).select(F.coalesce("r_name", F.lit("*")).alias("region"), F.coalesce("n_name", F.lit("*")).alias("nation"), "customers")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 80")
def third_page(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(80).limit(40)


for _own in (text_queries, record_queries, page_queries):
    QUERIES |= _own.QUERIES
    SQL |= _own.SQL

"""Registered queries of the text, name, label, URL, date and request functions, each beside its SQL.

The functions meet strings made of the tables' columns by expressions that Spark and the SQL share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import dates, labels, names, requests, urls
from quarry.functions.text import fold_text, to_ascii
from quarry.plans.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Strings that both engines make alike: two words of a part's name, small and capitalised.
WORDS = [
    "split_part(p_name, ' ', 1) AS w1", "split_part(p_name, ' ', 2) AS w2", "upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS c1",
    "upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS c2",
]
NAME = """CASE p_partkey % 12
  WHEN 0 THEN 'Dr. ' || c1 || ' ' || c2 WHEN 1 THEN c2 || ', ' || c1 || ' A.' WHEN 2 THEN upper(w1) || ' ' || upper(w2) WHEN 3 THEN c1 || ' B. ' || c2 || ', Ph.D.'
  WHEN 4 THEN c1 || ' (Mimi) ' || c2 WHEN 5 THEN c1 || ' O''' || c2 WHEN 6 THEN w1 || ' ' || w2 WHEN 7 THEN 'Professor ' || c1 || ' Q ' || c2 WHEN 8 THEN c1
  WHEN 9 THEN c1 || ' ' || c2 || ' 3' WHEN 10 THEN 'Faculty ' || c2 ELSE c1 || '  J.  ' || c2 || ' MD' END"""


def _parts(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    words = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "p_brand", "p_type", "p_size", *WORDS)
    return words.selectExpr("p_partkey", "p_size", "w1", "w2", "c1", "c2", "p_brand", "p_type", *[f"{e} as {n}" for n, e in columns.items()])


def _with(**columns: str) -> str:
    return f"WITH w AS (SELECT *, {", ".join(WORDS)} FROM part), t AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM w)"


# In the SQL: pieces that several queries use.
def _sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _norm(x: str) -> str:
    return _sq(f"regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]+', '', 'g')), '[^a-z0-9 ]', ' ', 'g')")


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _parts(spark, sf_dir, name=NAME)
    n = F.col("name")
    return t.select(
        "p_partkey", "name", names.name_key(n).alias("name_key"), names.normalized(n).alias("normalized"), names.published_name(n).alias("published"),
        names.without_middle_initials(n).alias("ends_key"), names.given_name_first(n).alias("flipped"), names.without_degree(n).alias("no_degree"), names.identity_name(n).alias("identity"),
        names.slug(n).alias("slug"), names.plain_name(n).alias("plain"), names.smart_case(n).alias("smart"), names.last_name(n).alias("last_name"),
        F.array_join(names.roster_tokens(n), "|").alias("roster"), names.valid_person_name(n).alias("valid"),
    )


_NOPAREN = "regexp_replace(name, '\\([^)]*\\)', '', 'g')"
SQL["name_keys"] = _with(name=NAME) + f""", a AS (
  SELECT p_partkey, name, regexp_replace(name, '''', '', 'g') AS na,
    trim(regexp_replace(regexp_replace(name, ',?\\s*(?:Ph\\.?D\\.?|M\\.?D\\.?)\\s*$', ''), '\\s+', ' ', 'g')) AS nd FROM t
), b AS (
  SELECT *, trim(regexp_replace(lower(na), '[^a-z0-9]+', ' ', 'g')) AS published,
    CASE WHEN contains(name, ',') THEN {_sq("substr(name, strpos(name, ',') + 1) || ' ' || split_part(name, ',', 1)")} ELSE name END AS flipped,
    CASE WHEN contains(nd, ',') THEN {_sq("substr(nd, strpos(nd, ',') + 1) || ' ' || split_part(nd, ',', 1)")} ELSE nd END AS no_degree,
    CASE WHEN contains({_NOPAREN}, ',') THEN {_sq("substr(" + _NOPAREN + ", strpos(" + _NOPAREN + ", ',') + 1) || ' ' || split_part(" + _NOPAREN + ", ',', 1)")} ELSE {_NOPAREN} END AS rf,
    list_filter(string_split(published, ' '), lambda x: x <> '') AS pl, list_filter(string_split({_norm(_NOPAREN)}, ' '), lambda x: x <> '') AS vt,
    list_filter(list_transform(string_split({_sq("name")}, ' '), lambda x: regexp_replace(x, '^[.,()]+|[.,()]+$', '', 'g')), lambda x: x <> '') AS lt
  FROM a
)
SELECT p_partkey, name, trim(regexp_replace(lower(regexp_replace(name, '\\([^)]*\\)', ' ', 'g')), '[^a-z]+', ' ', 'g')) AS name_key, {_norm("name")} AS normalized, published,
  array_to_string(list_filter(pl, lambda x, i: i = 1 OR i = len(pl) OR length(x) > 1), ' ') AS ends_key, flipped, no_degree,
  {_norm("regexp_replace(regexp_replace(regexp_replace(no_degree, '(?i)^(?:(?:adjunct|distinguished|emeritus|assistant|associate|professor|dr)\\.?\\s+)+', ''), '\\([^)]*\\)', '', 'g'), '''', '', 'g')")} AS identity,
  regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  {_sq("regexp_replace(regexp_replace(regexp_replace(name, '\\([^)]*\\)', ' ', 'g'), '\\b(?:PhD|MD|M\\.D\\.|Dr\\.|Professor|Prof\\.)\\b', ' ', 'gi'), '[^A-Za-z .''-]+', ' ', 'g')")} AS plain,
  array_to_string(list_transform(string_split({_sq("name")}, ' '), lambda x: CASE WHEN contains(x, '.') THEN x WHEN upper(x) = x OR lower(x) = x THEN upper(substr(x, 1, 1)) || lower(substr(x, 2)) ELSE x END), ' ') AS smart,
  CASE WHEN length(lt[-1]) = 1 AND len(lt) > 1 THEN lt[-2] ELSE lt[-1] END AS last_name,
  array_to_string(regexp_extract_all(lower(rf), '[a-z]+'), '|') AS roster,
  len(vt) BETWEEN 2 AND 8 AND len(list_filter(vt[1:len(vt) - 1], lambda x: length(x) > 1)) > 0
    AND NOT regexp_matches(name, '(?i)\\d|\\b(?:faculty|directory|research|staff|student|emeritus|professor|contact|website|chair|lecturer|profile)\\b') AS valid
FROM b"""


def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASCII and folded forms of whole texts in four languages, by digest."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(to_ascii(F.col("text")).cast("binary")).alias("ascii_md5"), F.length(fold_text(F.col("text"))).alias("folded_chars"), F.md5(F.lower(fold_text(F.col("text"))).cast("binary")).alias("folded_md5"))


SQL["folded_texts"] = r"""
SELECT doc_id, md5(regexp_replace(strip_accents(text), '[^\x00-\x7F]+', '', 'g')) AS ascii_md5, CAST(length(strip_accents(text)) AS INTEGER) AS folded_chars, md5(lower(strip_accents(text))) AS folded_md5
FROM documents WHERE text IS NOT NULL"""


OTHER = "CASE p_partkey % 5 WHEN 0 THEN c1 || ' ' || c2 WHEN 1 THEN c1 || ' A. ' || c2 WHEN 2 THEN c2 || ' ' || c1 WHEN 3 THEN c1 || ' Z ' || c2 ELSE substr(c1, 1, 1) || '. ' || c2 END"
FULL = "CASE p_partkey % 3 WHEN 0 THEN c1 || ' Anne ' || c2 WHEN 1 THEN c1 || ' ' || c2 ELSE c1 || ' Z. ' || c2 END"


def name_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _parts(spark, sf_dir, a=FULL, b=OTHER)
    a, b = F.col("a"), F.col("b")
    return t.select(
        "p_partkey", "a", "b", names.same_person(a, b).alias("same_person"), names.names_match(a, b).alias("names_match"), names.legacy_initials_compatible(a, b).alias("initials"),
        names.possible_initial_alias(a, b).alias("lead"), names.person_in_text(b, F.concat(F.lit("By "), a, F.lit(", at home."))).alias("in_text"),
        F.array_join(names.profile_slugs(a), "|").alias("slugs"), names.merge_key(b).alias("merge_key"),
    )


SQL["name_comparisons"] = _with(a=FULL, b=OTHER) + """, x AS (
  SELECT p_partkey, a, b, regexp_extract_all(lower(a), '[a-z]+') AS s, regexp_extract_all(lower(b), '[a-z]+') AS o FROM t
), y AS (
  SELECT *, len(s) AS n, len(o) AS m, s[1] = o[1] AND s[-1] = o[-1] AS ends, CASE WHEN s[-1] = o[-1] THEN CASE WHEN least(n, m) > 2 AND s[-2] = o[-2] THEN 2 ELSE 1 END ELSE 0 END AS k FROM x
)
SELECT p_partkey, a, b, list_sort(list_distinct(s)) = list_sort(list_distinct(o)) OR (n >= 2 AND m >= 2 AND ends AND (n = 2 OR m = 2 OR substr(s[2], 1, 1) = substr(o[2], 1, 1))) AS same_person,
  s = o OR ends OR (s[1] = o[1] AND len(list_intersect(s[2:], o[2:])) > 0) OR array_to_string(s, '') = array_to_string(o, '') AS names_match,
  n >= 2 AND m >= 2 AND length(s[1]) >= 2 AND ((length(o[1]) = 1 AND o[2:] = s) OR (k > 0 AND len(list_filter(o[1:m - k], lambda t: length(t) > 1)) = 0
    AND (m - k < 1 OR n - k < 1 OR o[1] = substr(s[1], 1, 1)) AND (m - k < 2 OR n - k < 2 OR o[2] = substr(s[2], 1, 1)))) AS initials,
  length(o[1]) = 1 AND o[1] = substr(s[1], 1, 1) AND o[-1] = s[-1] AS lead, list_contains(s || ['by', 'at', 'home'], o[1]) AND list_contains(s || ['by', 'at', 'home'], o[-1]) AS in_text,
  CASE WHEN n = 2 THEN s[1] || '.' || s[2] WHEN length(s[2]) = 1 THEN s[1] || '.' || s[3] || '|' || s[1] || '.' || s[2] || '.' || s[3]
    ELSE s[1] || '.' || s[3] || '|' || s[1] || '.' || s[2] || '.' || s[3] || '|' || s[1] || '.' || substr(s[2], 1, 1) || '.' || s[3] END AS slugs,
  CASE WHEN m = 3 THEN o[1] || '-' || o[3] ELSE array_to_string(o, '-') END AS merge_key
FROM y"""


LABEL = """CASE p_partkey % 10 WHEN 0 THEN 'The ' || c1 || ' ' || c2 || ' Laboratory' WHEN 1 THEN c1 || ' Lab - ' || w2 || ' methods | site' WHEN 2 THEN 'Department of ' || c1 || ' & ' || c2 || ' (DC)'
  WHEN 3 THEN upper(w1) || ' ' || upper(w2) WHEN 4 THEN 'research group' WHEN 5 THEN c1 || '_' || w2 || '-group.html' WHEN 6 THEN 'Center for ' || c1 || ' ' || c2 WHEN 7 THEN 'Lab website'
  WHEN 8 THEN c2 || ' Core Facility' ELSE 'Visit the ' || c1 || ' lab homepage' END"""
LEADER = "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Not found' WHEN 2 THEN 'Ann ' || c2 ELSE 'Bo ' || c1 || ' J.' END"


def lab_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _parts(spark, sf_dir, label=LABEL, leader=LEADER)
    v, p = F.col("label"), F.col("leader")
    parts = labels.lab_label(v)
    return t.select(
        "p_partkey", "label", "leader", labels.title_words(v).alias("title_words"), labels.department_key(v).alias("department_key"), labels.label_key(v).alias("label_key"), labels.lab_key(v).alias("lab_key"),
        labels.lab_identity(v).alias("lab_identity"), labels.base_lab_name(v).alias("base_name"), labels.shown_lab_name(v, F.when(p != "Not found", p)).alias("shown"), parts["name"].alias("lab"),
        parts["descriptor"].alias("descriptor"), labels.direction_phrase(v).alias("direction"), labels.entity_type(v, F.lit("http://x.org"), F.col("w2")).alias("entity"),
        labels.confidence(p, F.array_repeat(F.lit("u"), F.col("p_size") % 3), F.lit("faculty_lab_link")).alias("confidence"), labels.valid_lab_label(v).alias("valid"),
        labels.specific_lab_name(v).alias("specific"), labels.same_lab(v, p, F.concat(F.lit("the "), v), F.lit("Ann Bolt")).alias("same"), labels.likely_direction(v).alias("likely"),
    )


_LK = "trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g'))"
SQL["lab_labels"] = _with(label=LABEL, leader=LEADER) + f""", a AS (
  SELECT p_partkey, p_size, label, leader, w2, {_LK} AS lk, {_sq("regexp_replace(regexp_replace(" + _LK + ", '\\blaborator(?:y|ies)\\b', 'lab', 'g'), '\\bthe\\b', '', 'g')")} AS k0,
    regexp_replace(regexp_replace({_sq("label")}, '^[ \\-*|]+|[ \\-*|]+$', '', 'g'), '\\s+\\|\\s+.*$', '') AS lb,
    trim(regexp_replace(trim(label), '\\.html?$', '', 'i')) AS s0, CASE WHEN leader IN ('', 'Not found') THEN '' ELSE leader END AS led,
    {_sq("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _sq("label") + ", '\\([^)]{1,12}\\)', '', 'g'), '(?i)\\b(?:lab|labs|laboratory|laboratories|research group|group)\\b', ' ', 'g'), '(?i)^center for\\s+', ''), '(?i)\\s+center$', ''), '(?i)^(?:for|of|the)\\s+', '')")} AS d0
  FROM t
), b AS (
  SELECT *, CASE WHEN k0 IN ('', 'lab', 'lab website', 'research group', 'website') THEN '' ELSE k0 END AS kk,
    CASE WHEN upper(s0) = s0 AND len(string_split(s0, ' ')) <= 3 THEN array_to_string(list_transform(string_split(s0, ' '), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' ') ELSE s0 END AS s1,
    regexp_extract(led, '([A-Za-z]{{2,}})[ .J]*$', 1) AS person, {_sq("regexp_replace(d0, '^[ \\-*|]+|[ \\-*|]+$', '', 'g')")} AS dir, lower(label || ' http://x.org ' || w2) AS hay
  FROM a
)
SELECT p_partkey, label, leader,
  array_to_string(list_transform(list_filter(regexp_split_to_array(label, '[\\s_-]+'), lambda x: x <> ''), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') AS title_words,
  regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(label), '\\([^)]*\\)', ' ', 'g'), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')), '^(the )?department of ', ''), ' department$', '') AS department_key,
  lk AS label_key, kk AS lab_key, trim(regexp_replace(regexp_replace({_norm("label")}, '\\blaborator(?:y|ies)\\b', 'lab', 'g'), '\\b(?:the|website|web|site|homepage|home|welcome|to|visit|at)\\b', '', 'g')) AS lab_identity,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(label), '\\.html?$', ''), '\\b(lab|laboratory|research group|group|center|centers and labs|affiliates)\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS base_name,
  CASE WHEN led <> '' AND lower(s1) IN ('lab / research', 'lab site', 'research', 'website', 'source') THEN person || ' Lab'
    WHEN led <> '' AND NOT (contains(lower(s1), 'lab') OR contains(lower(s1), 'research group') OR contains(lower(s1), 'center')) THEN s1 || ' Lab' ELSE s1 END AS shown,
  {_sq("regexp_extract(lb, '^(.*?)(?:\\s+-\\s+.*)?$', 1)")} AS lab, {_sq("regexp_extract(lb, '^.*?\\s+-\\s+(.*)$', 1)")} AS descriptor, dir AS direction,
  CASE WHEN contains(hay, 'research group') THEN 'research_group' WHEN contains(hay, 'core') THEN 'core' WHEN contains(hay, 'clinic') THEN 'clinic' WHEN contains(hay, 'facility') THEN 'facility' WHEN contains(hay, 'center') THEN 'center' ELSE 'lab' END AS entity,
  CASE WHEN led <> '' THEN 'high' WHEN p_size % 3 > 1 THEN 'medium' ELSE 'low' END AS confidence,
  regexp_matches(label, '(?i)\\b(?:lab(?:orator(?:y|ies))?|(?:research )?group)\\b') AND NOT regexp_matches(label, '(?i)^(?:(?:research|faculty|all|our|department) )?(?:labs|laboratories|research groups)(?: directory| websites?)?$') AS valid,
  trim(regexp_replace(lk, '\\b(?:the|lab|laboratory|laboratories|group|research|website|web|site|home|homepage|at|of|university|visit)\\b', '', 'g')) <> '' AND regexp_matches(lk, '\\blab\\b|laborator|\\bgroup\\b') AS specific,
  kk <> '' AND NOT (led <> '' AND trim(regexp_replace(lower(leader), '[^a-z0-9]+', ' ', 'g')) <> 'ann bolt') AS same,
  length(dir) BETWEEN 4 AND 80 AND lower(dir) NOT IN ('home', 'homepage', 'website', 'research', 'project', 'program', 'study')
    AND (regexp_matches(lower(dir), 'aging|autism|behavior|biology|brain|cancer|cell|clinical|cognition|disease|genetic|health|imaging|immune|language|learning|memory|neural|neuro|policy|repair|science|systems')
      OR NOT (len(string_split(dir, ' ')) = 1 OR (len(string_split(dir, ' ')) <= 3 AND len(list_filter(string_split(dir, ' '), lambda x: NOT regexp_matches(x, '^[A-Z]'))) = 0))) AS likely
FROM b"""


ROLE = "CASE p_partkey % 8 WHEN 0 THEN 'Professor Emeritus' WHEN 1 THEN 'Adjunct Professor' WHEN 2 THEN 'Lecturer' WHEN 3 THEN 'Assistant Professor, Department of ' || c1 WHEN 4 THEN 'Affiliated Faculty' WHEN 5 THEN 'Former Professor' WHEN 6 THEN 'Teaching Professor' ELSE 'Postdoc' END"
CONTACT = "CASE p_partkey % 6 WHEN 0 THEN 'mailto:' || c1 || '@X.edu?subject=a' WHEN 1 THEN 'Mail ' || w1 || '.' || w2 || '@x.edu or info@x.edu, call (858) 555-0' || lpad(CAST(p_partkey % 1000 AS VARCHAR(9)), 3, '0') WHEN 2 THEN 'info@x.edu' WHEN 3 THEN w1 || '@a.org ' || w2 || '@b.org' WHEN 4 THEN 'none' ELSE '//' || w2 || '@mail.x.edu#top' END"
COURSE = "CASE p_partkey % 5 WHEN 0 THEN 'CSE 0' || CAST(p_size AS VARCHAR(9)) || 'a. ' || w1 WHEN 1 THEN 'math-' || CAST(p_size AS VARCHAR(9)) WHEN 2 THEN 'FA2' || CAST(p_size % 10 AS VARCHAR(9)) WHEN 3 THEN '12 ' || w1 ELSE 'WI' || CAST(10 + p_size AS VARCHAR(9)) END"


def titles_and_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _parts(spark, sf_dir, role=ROLE, contact=CONTACT, course=COURSE)
    r, c = F.col("role"), F.col("contact")
    return t.select(
        "p_partkey", labels.appointment_status(r, F.col("w1")).alias("appointment"), labels.title_score(r).alias("title_score"), labels.academic_clause(r).alias("academic"), labels.unit_of_title(r).alias("unit"),
        labels.public_email(c).alias("public_email"), labels.clean_email(c).alias("clean_email"), labels.first_phone(c).alias("phone"), labels.email_allowed(labels.clean_email(c)).alias("allowed"),
        F.array_join(labels.page_emails(c, F.array(c)), "|").alias("emails"), labels.generic_email(labels.clean_email(c), F.col("p_size") % 6).alias("generic"), labels.course_code(F.col("course")).alias("course"),
        labels.term_label(F.col("course")).alias("term"), F.array_join(names.instructors(F.concat(F.col("c1"), F.lit(" (001); Staff & Dr. "), F.col("c2"), F.lit("\nTBA"))), "|").alias("instructors"),
        F.array_join(labels.department_interests(F.concat(F.lit("Bio"), F.col("w1")), F.lit("School of Data")), "|").alias("interests"), labels.stripped(F.concat(F.lit("<b>"), F.col("w1"), F.lit("&nbsp;</b> "), F.col("w2"))).alias("stripped"),
        F.array_join(labels.resource_areas(F.col("c1"), F.lit("Research and intern work"), F.when(F.col("p_size") % 2 == 0, "Co-curricular")), "|").alias("areas"),
        labels.low_information(F.concat(F.col("p_brand"), F.repeat(F.lit(" x"), (F.col("p_size") * 2).cast("int")))).alias("low_information"), labels.eligible_directory(F.concat(F.col("c1"), F.lit(" labs")), F.col("w2")).alias("directory"),
        labels.highlighted(F.col("role"), ["prof", "of"]).alias("marked"),
    )


SQL["titles_and_contacts"] = _with(role=ROLE, contact=CONTACT, course=COURSE) + r""", a AS (
  SELECT *, lower(regexp_extract(regexp_replace(regexp_replace(contact, '[mM]ailto:', '', 'g'), '\?.*$', ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}')) AS ce,
    regexp_replace(trim(regexp_replace(regexp_replace(trim(contact), '(?i)^mailto:', ''), '[?#].*$', '')), '^//', '') AS pe,
    lower(role) AS lr, regexp_extract(course, '(?i)^([A-Z]{2,5})[ -]*(\d+[A-Z]*)(?:\b|[ .:])', 2) AS num FROM t
)
SELECT p_partkey, CASE WHEN lr LIKE '%former%' THEN 'former' WHEN lr LIKE '%emerit%' THEN 'emeritus' WHEN lr LIKE '%adjunct%' THEN 'adjunct' WHEN lr LIKE '%affiliat%' THEN 'affiliate' WHEN lr LIKE '%lecturer%' THEN 'lecturer' ELSE 'listed_faculty' END AS appointment,
  CAST(CASE lr WHEN 'teaching professor' THEN 7 WHEN 'lecturer' THEN 2 ELSE CASE WHEN lr LIKE '%professor%' THEN 5 ELSE 2 END END AS INTEGER) AS title_score,
  regexp_matches(role, '(?i)\b(?:professor|lecturer|faculty|scientist|instructor)\b') AS academic, CASE WHEN p_partkey % 8 = 3 THEN c1 ELSE '' END AS unit,
  CASE WHEN regexp_full_match(pe, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN pe ELSE '' END AS public_email, ce AS clean_email,
  regexp_extract(contact, '(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}') AS phone, ce <> '' AND split_part(ce, '@', 1) NOT IN ('communication', 'feedback', 'info', 'support', 'webmaster') AS allowed,
  array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(contact, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}'), lambda x: lower(x)) || [ce]),
    lambda x: x <> '' AND split_part(x, '@', 1) NOT IN ('communication', 'feedback', 'info', 'support', 'webmaster'))), '|') AS emails,
  p_size % 6 > 3 OR regexp_matches(split_part(ce, '@', 1), 'admin|contact|info|media|support|web|webmaster|dept|faculty|grad') AS generic,
  CASE WHEN num <> '' THEN upper(regexp_extract(course, '^([A-Za-z]{2,5})', 1)) || ' ' || CASE WHEN regexp_matches(num, '^0+\d') THEN regexp_replace(upper(num), '^0+', '') ELSE upper(num) END END AS course,
  CASE substr(course, 1, 2) WHEN 'FA' THEN 'Fall' WHEN 'WI' THEN 'Winter' WHEN 'SP' THEN 'Spring' END || ' 20' || substr(course, 3) AS term, c1 || CASE WHEN c1 <> c2 THEN '|' || c2 ELSE '' END AS instructors,
  array_to_string(list_sort(list_distinct(['Bio' || w1, 'Biology', 'Biomedical science', 'Computer science', 'Data science'])), '|') AS interests, w1 || ' ' || w2 AS stripped,
  'Experiential learning|Research|Internship' || CASE WHEN p_size % 2 = 0 THEN '|Co-curricular' ELSE '' END AS areas, length(p_brand) + 4 * p_size < 90 AS low_information, TRUE AS directory,
  regexp_replace(role, '(?i)(prof|\bof)', '<mark>\1</mark>', 'g') AS marked
FROM a"""


URL = """CASE p_partkey % 14
  WHEN 0 THEN 'HTTPS://WWW.X.Edu/' || w1 || '/index.html?utm_source=a&b=2#top' WHEN 1 THEN 'http://lab.x.edu/home/' WHEN 2 THEN 'https://doi.org/10.1/' || w1 WHEN 3 THEN 'ftp://x.edu/a'
  WHEN 4 THEN 'https://x.edu/people/' || w1 || '-' || w2 WHEN 5 THEN 'https://x.edu/news/' || w1 WHEN 6 THEN 'https://10.0.0.1/a' WHEN 7 THEN 'https://x.edu:8080/a b' WHEN 8 THEN 'https://scholar.google.com/citations?user=' || w1 || '&hl=en'
  WHEN 9 THEN 'https://urldefense.com/v3/__https:/x.edu/' || w1 || '__;!!' WHEN 10 THEN 'https://x.edu//a//' || w2 || '/' WHEN 11 THEN 'https://x.edu/sso/login?next=1' WHEN 12 THEN 'https://x.edu/profile?id=' || CAST(p_partkey AS VARCHAR(19)) ELSE 'https://x.edu/files/' || w1 || '.pdf' END"""


def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _parts(spark, sf_dir, url=URL)
    u = F.col("url")
    return t.select(
        "p_partkey", "url", urls.canonical_url(u).alias("canonical"), urls.loose_key(u).alias("loose"), urls.page_key(u).alias("page_key"), urls.unwrapped(u).alias("unwrapped"), urls.site_key(u).alias("site_key"),
        urls.candidate_url(u).alias("candidate"), urls.homepage_key(u).alias("homepage"), urls.bare_host(u).alias("host"), urls.safe_url(u).alias("safe"), urls.encode_url(u).alias("encoded"),
        urls.content_key(u)["path"].alias("content_path"), urls.request_key(u)["port"].alias("request_port"), urls.destination_reason(u).alias("reason"), urls.is_lab_destination(u).alias("lab_destination"),
        urls.nonlab_reason(F.col("w1"), u).alias("nonlab"), urls.authentication_target(u).alias("login"), urls.scholar_profile(u).alias("scholar"), urls.individual_profile(u, "x.edu").alias("individual"),
        urls.profile_identity(u, "x.edu", ("x.edu",)).alias("identity"), urls.lab_link_allowed(u, F.lit(False)).alias("allowed"), urls.title_of(u).alias("title"), urls.query_value(u, "user").alias("user"),
        urls.looks_like_profile(u, F.concat(F.col("c1"), F.lit(" "), F.col("c2"))).alias("profile_like"), urls.inside(F.lit("https://x.edu/people"), u).alias("inside"), urls.host_name(u).alias("wire_host"),
    )


_P = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?', {})"
SQL["url_forms"] = _with(url=URL) + f""", p AS (
  SELECT p_partkey, url, w1, w2, lower({_P.format(1)}) AS sch, {_P.format(2)} AS auth, {_P.format(3)} AS path, {_P.format(4)} AS q, NOT contains(url, ' ') AND lower({_P.format(1)}) IN ('http', 'https') AS ok FROM t
), a AS (
  SELECT *, lower(split_part(auth, ':', 1)) AS h, regexp_replace(path, '/+$', '') AS bare, CASE WHEN path = '' THEN '/' ELSE path END AS full_path,
    CASE WHEN contains(url, 'urldefense.com') THEN regexp_replace(regexp_extract(url, '__([^_]+)__', 1), '^([^:]*):/', '\\1://') ELSE url END AS un FROM p
), b AS (
  SELECT *, replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', ''), '^https?://', ''), '^www\\.', ''), '/index.html', ''), '/index.htm', ''), '/index.php', '') AS loose,
    replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(un), '[?#].*$', ''), '/+$', ''), '^https?://', ''), '^www\\.', ''), '/index.html', '') AS sk,
    CASE WHEN sch IN ('http', 'https') THEN sch || '://' || lower(auth) || full_path || q ELSE '' END AS canonical,
    CASE WHEN NOT ok THEN 'malformed' WHEN contains(lower(path), '://') THEN 'embedded_scheme' WHEN regexp_matches(path, '/news/') THEN 'news' ELSE '' END AS reason,
    regexp_matches(bare, '/(?:people/)?profiles?/[^/]+$|/profile$') AS prof FROM a
), c AS (
  SELECT *, h LIKE '%x.edu' AND CASE WHEN prof THEN NOT regexp_matches(bare, '/profile$') OR length(q) > 1 ELSE contains(bare, '/people/') END AS individual FROM b
)
SELECT p_partkey, url, canonical, loose, lower(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', ''), '(?i)/index\\.html?$', '')) AS page_key, un AS unwrapped,
  CASE WHEN regexp_matches(split_part(sk, '/', 1), '(^|[^a-z])lab([^a-z]|$)') THEN split_part(sk, '/', 1) ELSE sk END AS site_key,
  sch || '://' || auth || CASE WHEN path IN ('', '/') THEN path ELSE regexp_replace(regexp_replace(path, '/{{2,}}', '/', 'g'), '/+$', '') END AS candidate,
  CASE WHEN ok THEN sch || '://' || lower(auth) || CASE WHEN regexp_replace(bare, '/home$', '') = '' THEN '/' ELSE regexp_replace(bare, '/home$', '') END || q ELSE '' END AS homepage, h AS host,
  CASE WHEN ok AND NOT regexp_matches(h, '^[\\d.]+$') AND NOT contains(auth, ':') THEN canonical ELSE '' END AS safe, replace(url, ' ', '%20') AS encoded,
  CASE WHEN sch IN ('http', 'https') THEN CASE WHEN bare = '' THEN '/' ELSE bare END END AS content_path, CASE WHEN ok THEN regexp_extract(auth, ':(\\d+)$', 1) END AS request_port, reason,
  reason = '' AND NOT (h IN ('doi.org', 'scholar.google.com') OR contains(h, 'urldefense') OR regexp_matches(lower(path), '\\.(?:pdf|docx?|pptx?|bib)(?:$|/)|/(?:doi|articles?|publications?|papers?|pubs|books?|catalog|search)(?:/|\\.|$)')) AS lab_destination,
  CASE WHEN regexp_matches(url, '(?i)doi\\.org/|\\.pdf(?:$|[?#])') THEN 'publication' WHEN p_partkey % 14 = 7 THEN '' ELSE reason END AS nonlab,
  regexp_matches(path, '(?i)/(?:login|signin|sso)(?:[/.?]|$)') AS login, h = 'scholar.google.com' AS scholar, individual,
  CASE WHEN p_partkey % 14 = 12 THEN 'record:' || CAST(p_partkey AS VARCHAR) WHEN individual THEN canonical ELSE '' END AS identity,
  sch IN ('http', 'https') AND h <> 'scholar.google.com' AND NOT regexp_matches(path, '(?i)/news(?:/|$)') AS allowed,
  array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_extract(bare, '([^/]*)$', 1), '[-_]+'), lambda x: x <> ''), lambda x: CASE WHEN lower(x) = x AND upper(x) <> x THEN upper(substr(x, 1, 1)) || substr(x, 2) ELSE x END), ' ') AS title,
  CASE WHEN h = 'scholar.google.com' THEN w1 END AS "user", p_partkey % 14 = 4 AS profile_like, p_partkey % 14 = 4 AS inside, nullif(h, '') AS wire_host
FROM c"""


EVENT = "'2024-01-' || lpad(CAST(event_id % 31 + 1 AS VARCHAR(9)), 2, '0')"
STAMP = f"CASE event_id % 6 WHEN 0 THEN {EVENT} WHEN 1 THEN {EVENT} || 'T03:00:00Z' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'soon' WHEN 4 THEN CAST(event_id % 400 AS VARCHAR(19)) ELSE 'Mon, 01 Jan 2024 00:00:' || lpad(CAST(event_id % 60 AS VARCHAR(9)), 2, '0') || ' GMT' END"


def dates_and_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "value", f"{STAMP} as stamp")
    s, now = F.col("stamp"), F.lit(1704067210.0)
    return t.select(
        "event_id", dates.date_label(s).alias("label"), dates.valid_date(s, F.lit("2024-01-15").cast("date")).alias("valid_date"), dates.valid_time(s).alias("valid_time"), dates.retry_after(s, now).alias("retry_after"),
        dates.robots_retry_at(F.col("user_id"), F.col("event_id"), F.col("user_id") % 4).cast("long").alias("robots_at"), dates.host_wait(F.col("value"), F.col("user_id") % 5, F.lit(100.0), F.lit(90.0)).alias("wait"),
        dates.numeric(s).alias("number"), dates.doi(F.when(F.col("user_id") % 2 == 0, "10.1/x"), F.concat(F.lit("https://doi.org/"), s)).alias("doi"),
    )


SQL["dates_and_waits"] = f"""
WITH t AS (SELECT event_id, user_id, value, {STAMP} AS stamp FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN stamp WHEN 1 THEN strftime(CAST(substr(stamp, 1, 10) AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d') WHEN 2 THEN 'Not checked' ELSE 'Date unavailable' END AS label,
  event_id % 6 <= 1 AND substr(stamp, 1, 10) <= '2024-01-15' AS valid_date, event_id % 6 = 1 AS valid_time,
  CASE event_id % 6 WHEN 4 THEN CAST(event_id % 400 AS DOUBLE) WHEN 5 THEN greatest(0.0, CAST(event_id % 60 AS DOUBLE) - 10) END AS retry_after,
  CAST(greatest(user_id, event_id + 60 * pow(2, greatest(0, user_id % 4 - 1))) AS BIGINT) AS robots_at, greatest(0.0, value + greatest(1.0, CAST(user_id % 5 AS DOUBLE)) - 90, 10.0) AS wait,
  coalesce(TRY_CAST(CASE WHEN event_id % 6 = 4 THEN stamp END AS DOUBLE), 0.0) AS number, CASE WHEN user_id % 2 = 0 THEN '10.1/x' ELSE 'https://doi.org/' || stamp END AS doi
FROM t"""


META = {
    "status": "CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'fetch_error' WHEN 2 THEN 'robots_unavailable' WHEN 3 THEN 'unavailable' ELSE 'robots_denied' END",
    "http_status": "CAST(CASE user_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 503 WHEN 2 THEN 0 WHEN 3 THEN 301 WHEN 4 THEN 429 ELSE NULL END AS INT)",
    "error": "CASE event_id % 7 WHEN 0 THEN 'curl: (28) timed out' WHEN 1 THEN 'curl: (60) certificate' WHEN 2 THEN 'access_challenge' ELSE '' END",
    "url": "'https://x.edu/' || CAST(user_id % 3 AS VARCHAR(9))", "listed": "'https://x.edu/' || CAST(event_id % 3 AS VARCHAR(9))",
}


def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", *[f"{e} as {n}" for n, e in META.items()])
    c = F.col
    meta = F.struct(
        c("event_id").alias("retrieved"), c("http_status"), F.when(c("user_id") % 2 == 0, F.array(F.lit(1))).alias("redirects"), (c("user_id") % 4).alias("attempts"), c("status"), c("error"),
        F.lit(0).alias("retry_after_at"),
    )
    robots = F.struct(F.lit("unavailable").alias("status"), c("http_status"), c("error"), (c("user_id") % 4).alias("attempts"))
    redirects = F.when(c("user_id") % 7 == 0, F.array(F.struct(c("listed").alias("from"), c("url").alias("to"), F.lit(302).alias("http_status"))))
    proven = requests.request_proven(c("url"), c("http_status"), redirects, c("event_id") % 11 == 0)
    return t.select(
        "event_id", requests.transient(c("status"), c("http_status"), c("error")).alias("transient"), requests.retryable(c("status"), c("http_status"), c("error"), robots).alias("retryable"),
        requests.reusable_robots(meta, F.lit(86_500)).alias("reusable"), proven.alias("proven"), requests.request_scope(c("url"), c("listed"), proven).alias("scope"),
    )


SQL["request_outcomes"] = "WITH t AS (SELECT event_id, user_id, " + ", ".join(f"{e} AS {n}" for n, e in META.items()) + r""" FROM events), a AS (
  SELECT *, CASE WHEN error = 'access_challenge' THEN FALSE WHEN coalesce(http_status IN (429, 503), FALSE) THEN TRUE WHEN error LIKE '%(60)%' THEN FALSE
    ELSE coalesce(http_status = 0, FALSE) OR status = 'fetch_error' OR error LIKE 'curl:%' END AS tr,
    CASE WHEN error = 'access_challenge' THEN FALSE WHEN coalesce(http_status IN (429, 503), FALSE) THEN TRUE WHEN error LIKE '%(60)%' THEN FALSE ELSE coalesce(http_status = 0, FALSE) OR error LIKE 'curl:%' END AS tr_robots,
    event_id % 11 = 0 OR http_status IS NOT NULL OR (user_id % 7 = 0 AND url = listed) AS proven FROM t
)
SELECT event_id, tr AS "transient", CASE status WHEN 'robots_unavailable' THEN user_id % 4 < 3 AND tr_robots WHEN 'robots_denied' THEN FALSE ELSE tr END AS retryable,
  86500 - event_id <= 86400 AND NOT coalesce(http_status = 301 AND user_id % 2 = 1, FALSE) AND NOT (status = 'unavailable' AND user_id % 4 < 3 AND tr AND 86500 >= event_id + 60 * pow(2, greatest(0, user_id % 4 - 1))) AS reusable,
  proven, CASE WHEN proven AND url = listed THEN 'listed_url_direct_request' WHEN proven THEN 'related_url_request_only' WHEN url = listed THEN 'listed_url_access_precheck_only' ELSE 'related_url_access_precheck_only' END AS scope
FROM a"""

QUERIES |= {f.__name__: f for f in (name_keys, folded_texts, name_comparisons, lab_labels, titles_and_contacts, url_forms, dates_and_waits, request_outcomes)}

"""Evidence, reviews, feeds, pages and queues on small tables."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import labels, markup, names, text, urls
from quarry.operators import evidence, lookup, records, reviews, search, state
from quarry.sources import captures, feeds

PROOF = "array<struct<source:string,observed_at:string,method:string,evidence:string>>"


def _table(spark, rows):
    return spark.createDataFrame(rows, f"entity string, field string, value string, proofs {PROOF}")


def _proof(day, method="directory", said="x"):
    return [("http://x.org", f"2024-01-{day:02}", method, said)]


def test_merge_keeps_what_the_invariants_ask(spark):
    old = _table(spark, [("a", "name", "Old", _proof(5)), ("a", "mail", "m@x", _proof(9)), ("a", "bio", "long", _proof(1, "personal_site")), ("a", "lab", "Sea Lab", _proof(1)), ("b", "name", "B", _proof(1))])
    new = _table(spark, [("a", "name", "New", _proof(6)), ("a", "mail", "older@x", _proof(8)), ("a", "bio", "short", _proof(9)), ("a", "lab", "lab", _proof(9, "x_generic_lab_link")), ("a", "phone", "Unknown", _proof(9)), ("c", "name", "C", _proof(2)), ("b", "name", None, _proof(3))])
    merged = evidence.merge_observed(old, new, F.col("field") == "lab", ("bio",))
    got = {(r["entity"], r["field"]): (r["value"], r["action"], len(r["proofs"] or [])) for r in merged.collect()}
    assert got == {
        ("a", "name"): ("New", "replaced", 1), ("a", "mail"): ("m@x", "outdated", 1), ("a", "bio"): ("long", "additional", 1), ("a", "lab"): ("Sea Lab", "additional", 1), ("a", "phone"): (None, "kept", 0),
        ("b", "name"): ("B", "proved", 2), ("c", "name"): ("C", "set", 1),
    }
    assert {(r["field"], r["kind"], r["value"]) for r in evidence.set_aside(merged).collect()} == {("name", "replaced", "Old"), ("bio", "additional", "short"), ("lab", "additional", "lab")}
    owners = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "identity string, entity string")
    assert evidence.proofs_lost(old, evidence.state_of(merged), owners).count() == 2  # the replaced name's proof, and b's that a does not have


def test_a_failed_check_keeps_all_fields(spark):
    old, new = _table(spark, [("a", "name", "Old", _proof(1)), ("b", "name", "Old", _proof(1))]), _table(spark, [("a", "name", "New", _proof(6)), ("b", "name", "New", _proof(6))])
    checks = spark.createDataFrame([("a", "verified", "2024-01-06"), ("b", "fetch_failed", "2024-01-06")], "entity string, status string, observed_at string")
    before = spark.createDataFrame([("a", "verified", "2024-01-01"), ("b", "verified", "2024-01-01")], "entity string, status string, observed_at string")
    assert {r["entity"]: r["value"] for r in evidence.merge_verified(old, new, checks, before).collect()} == {"a": "New", "b": "Old"}
    assert {r["entity"]: (r["status"], r["history"]["status"]) for r in evidence.latest_checks(checks, before).collect()} == {"a": ("verified", "verified"), "b": ("fetch_failed", "verified")}


def test_fields_of_verified_decisions(spark):
    body = "<title>Sea Lab</title><body><h1>Sea Lab</h1><p>Led by Ann Bo.</p></body>"
    sha = hashlib.sha256(body.encode()).hexdigest()
    caps = spark.createDataFrame([("c1", "ok", body, sha, "2024-02-01", "http://l.org", [])], "capture string, status string, body string, sha256 string, observed_at string, final_url string, redirects array<string>")
    proof = lambda kind, said: [("c1", sha, "2024-02-01", "http://l.org", kind, said, None, None)]
    rows = [("d1", "set", "l1", None, "own page", "h", "principalInvestigator", "Ann Bo", proof("main_text_quote", "Led by Ann Bo.")), ("d2", "set", "l2", None, "own page", "other", "colour", "blue", proof("document_title", "Sea"))]
    kind = "decision string, action string, subject string, target string, reason string, sha256 string, field string, value string, proofs array<struct<capture:string,sha256:string,observed_at:string,final_url:string,kind:string,evidence:string,label:string,target:string>>"
    decisions = spark.createDataFrame(rows, kind)
    known = spark.createDataFrame([("l1", [], "h"), ("l2", [], "h")], "id string, alias_ids array<string>, sha256 string")
    out = reviews.verify(decisions, known, caps, reviews.SCHEMAS["lab_fields"])
    assert {r["decision"]: r["failures"] for r in out.collect()} == {"d1": [], "d2": ["evidence_not_found", "field", "record_changed"]}
    assert not reviews.batch_valid(out)
    old = _table(spark, [("l1", "principalInvestigator", "Unknown", [])])
    after = reviews.apply_fields(old, decisions.where("decision = 'd1'")).collect()
    assert [(r["value"], r["action"], r["proofs"][0]["evidence"]) for r in after] == [("Ann Bo", "set", "Led by Ann Bo.")]
    assert len(reviews.SCHEMAS) >= 20
    same = spark.range(1).select(reviews.record_sha256(F.struct(F.lit(1).alias("b"), F.lit("x").alias("a"))).alias("x"), reviews.record_sha256(F.struct(F.lit("x").alias("a"), F.lit(1).alias("b"))).alias("y")).first()
    assert same["x"] == same["y"]


def test_robots_and_pinned_files(spark, tmp_path):
    body = "User-agent: bot\nDisallow: /private\nAllow: /private/open$\n\nUser-agent: *\nDisallow: /\n"
    rules = feeds.robots_for(spark.createDataFrame([("h", body), ("g", "User-agent: *\nDisallow: /*.pdf")], "host string, body string"), "host", "body", "bot")
    asked = spark.createDataFrame([(1, "h", "/private/x"), (2, "h", "/private/open"), (3, "h", "/a"), (4, "g", "/x.pdf"), (5, "g", "/y"), (6, "none", "/")], "id int, host string, path string")
    assert {r["id"]: r["allowed"] for r in feeds.robots_allow(rules, asked, "host", "path", "id").collect()} == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True}
    (tmp_path / "f.json").write_text("{}")
    assert feeds.pinned(spark, str(tmp_path / "f.json"), hashlib.sha256(b"{}").hexdigest()).first()["body"] == "{}"
    with pytest.raises(Exception, match="audited"):
        feeds.pinned(spark, str(tmp_path / "f.json"), "0").collect()
    captures.write_markdown(spark.createDataFrame([("a|b", 1)], "name string, n int"), str(tmp_path / "report"))
    assert "\n".join(sorted(p.read_text() for p in (tmp_path / "report").glob("part*"))).split("\n")[:3] == ["| name | n |", "|---|---|", "| a\\|b | 1 |"]


def test_nested_feeds_and_pages_read_one_by_one(spark):
    nested = spark.sql("select 1 as k, array(named_struct('topic', 't', 'people', array(named_struct('name', 'a'), named_struct('name', 'b'))), named_struct('topic', 'u', 'people', array())) as topics")
    assert [(r["group"]["topic"], r["item"] and r["item"]["name"]) for r in feeds.flattened(nested, "k", "topics", "people").collect()] == [("t", "a"), ("t", "b"), ("u", None)]
    pages, rows = spark.createDataFrame([(1, 5, 2), (2, 6, 0)], "page int, total int, rows int"), spark.createDataFrame([(1,), (1,)], "id int")
    assert {r["fault"]: r["n"] for r in lookup.page_faults(pages, "page", "total", rows, "id").collect()} == {"total_changed": 1, "repeated_ids": 1, "empty_pages": 1, "missing_rows": 5}
    listed = spark.createDataFrame([("m", ["auto", "x"]), ("n", ["auto"])], "id string, sources array<string>")
    assert [r["id"] for r in feeds.not_discovered(listed, "sources", ["auto"]).collect()] == ["m"] and feeds.of_source(listed, "sources", "auto").count() == 2


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://x.org/", ""), (3, "http://x.org/a/b", "<div>" * 4000 + "deep <a href='c'>link</a>" + "</div>" * 4000), (4, None, "plain & text"), (5, "http://x.org/", "<table><tr><td rowspan=x colspan=2>a<td>b<tr><td>c</table><a href=''>none</a>")]
    read = markup.pages(spark.createDataFrame(rows, "id int, url string, html string"))
    got = {r["id"]: r["page"] for r in read.collect()}
    assert got[1]["main"] == "" and got[2]["links"] == [] and got[4]["main"] == "plain & text"
    assert got[3]["main"] == "deep link" and got[3]["links"][0]["target"] == "http://x.org/a/c"
    assert got[5]["tables"] == [[["a", "a", "b"], ["c"]]]
    data = spark.createDataFrame([("é".encode(),), (b'<meta charset="cp1252">\x80',), (b"\xe9",), (None,)], "body binary")
    assert [r[0] for r in data.select(markup.decoded_body(F.col("body"))).collect()] == ["é", '<meta charset="cp1252">€', "é", None]


def test_one_fold_for_index_and_query(spark):
    """Korean, kana, full-width and ligature terms are found however they are written."""
    texts = ["한국 연구", "ガラス", "ＦＵＬＬ width", "eﬃcient", "Ångström", "Straße"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string").withColumn("haystack", text.padded(F.col("t")))
    for k, query in enumerate(["한국", "ガラス", "full", "efficient", "angstrom", "straße"]):
        term = search.compile_query(query).terms[0]
        assert [r["id"] for r in rows.where(search.term_matches(term)).collect()] == [k], query
    folded = [r[0] for r in rows.select(text.fold_text(F.col("t"))).collect()]
    assert folded == [text.folded(t) for t in texts]


def test_corrections_of_transpositions(spark):
    vocab = spark.createDataFrame([("neuroscience", 9), ("neurosciences", 2), ("science", 30), ("nuisance", 4)], "token string, df long")
    assert [(r["text"], r["df"]) for r in search.corrections(vocab, "nueroscence").collect()] == [("neuroscience", 9)]  # a transposition and a letter
    assert search.corrections(vocab, "scien").count() == 0  # stands inside a token
    assert search._osa(__import__("pandas").Series(["abc", "ba", "", None]), "ca").tolist()[:3] == [3, 1, 2]


def test_urls_of_all_kinds(spark):
    cases = {"https://EXAMPLE.org": "https://example.org/", "ftp://x": "", None: None}
    for url, want in cases.items():
        assert spark.range(1).select(F.coalesce(urls.canonical_url(F.lit(url)), F.lit(None))).first()[0] == (want if url else "")
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(urls.encode_url(F.lit(" http://x.org/a b&amp;c=é "))) == "http://x.org/a%20b&c=%C3%A9"
    assert one(urls.comparison_key(F.lit("http://www.x.org/index.php?b=a%20b&utm_source=q"))) == one(urls.comparison_key(F.lit("https://x.org/?b=a+b")))
    assert one(urls.host_name(F.lit("https://Bücher.example/x"))) == "xn--bcher-kva.example" and one(urls.host_name(F.lit("X.org."))) == "x.org"
    assert one(names.canonical_name(F.lit("BO, ANN, Ph.D."))) == "Ann Bo" and one(names.looks_like_person_name(F.lit("Ann Bo"), ["Home"], ["calendar"])) is True
    assert one(labels.labels_of(F.lit("deep learning of cancer"), {"AI": ["learning"], "Cancer": ["cancer"]})) == ["AI", "Cancer"]


def test_reader_steps(spark):
    rows = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "id int, name string")
    step = lambda at, by: [r["id"] for r in records.step_in(rows, [F.col("name")], "id", F.col("id") == at, by).collect()]
    assert step(2, 1) == [3] and step(4, 1) == [4] and step(0, -1) == [0]
    assert len(state.ORDERS) == 7 and all(state.order_by(o) for o in state.ORDERS)
    assert dt.date(2024, 1, 1).isoformat() == "2024-01-01"

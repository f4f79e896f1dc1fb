import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarry.operators import merge, quality, resolve, search
from quarry.plans.components import connected_components
from quarry.plans.shared import drop_shared, shared_table
from quarry.sources import captures
from quarry.streaming import queue, windows


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 6), (3, 1), (10, 1)] + [(20, k) for k in range(21, 60)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 10: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 20: 20, **{k: 20 for k in range(21, 60)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["root"] for r in connected_components(edges).collect()} == {0}


def test_shared_tables_come_back(spark):
    df = shared_table(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"))
    assert sorted(df.collect()) == [(1, None), (2, "x")]
    drop_shared(df)


def index(spark, rows):
    df = spark.createDataFrame(rows, "id int, name string, area string, text string")
    return search.build_index(df, F.col("name"), F.col("area"), F.lit(""), F.lit(""), F.col("text"))


ROWS = [(1, "Ada Cancer", "bio", "cancer cells"), (2, "Bo Li", "ai", "html and ai"), (3, "Cy Wu", "math", "would be"), (4, "Di Émile", "bio", "immune cancer")]


def test_search_places_and_short_terms(spark):
    idx = index(spark, ROWS)
    found = search.search(idx, search.compile_query("cancer"), F.lit(0)).select("id", "score").collect()
    assert {r["id"]: r["score"] for r in found} == {1: 20 + 14, 4: 20 + 2}
    ids = lambda q, **k: {r["id"] for r in search.search(index(spark, [(i, n, a, f"{n} {t}") for i, n, a, t in ROWS]), search.compile_query(q, **k), F.lit(0), ["ai"]).collect()}
    assert ids("wu") == {3} and ids("ai", synonyms={"ai": ["machine"]}) == {2} and ids("emile") == {4}


def test_relaxation(spark):
    idx = index(spark, ROWS)
    q = search.compile_query("cancer immune zebra")
    assert {r["id"] for r in search.search_relaxed(idx, q, F.lit(0)).collect()} == {4}
    both = search.compile_query("cancer immune")
    assert {r["id"] for r in search.search_relaxed(idx, both, F.lit(0)).collect()} == {4}


def test_corrections(spark):
    vocab = spark.createDataFrame([("cancer", 5), ("cancel", 2), ("dancer", 9), ("neuroscience", 3)], "token string, df long")
    assert [r["text"] for r in search.corrections(vocab, "cancr").collect()] == ["cancer"]
    assert [r["text"] for r in search.corrections(vocab, "nuerosci").collect()] == ["neurosci"]
    assert search.corrections(vocab, "abc").count() == 0


def test_segments_hide_shorter_ones():
    q = search.compile_query("機器學習", segments={"機器": ["machine"], "機器學習": ["machine learning"]})
    assert [t.alternatives for t in q.terms] == [["機器學習", "machine learning"]]


def test_merge_keeps_history_and_newest(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = spark.createDataFrame([("a", t(1), 1, "x"), ("a", t(3), 2, "y"), ("a", t(2), 3, "x"), ("b", None, 4, "z")], "k string, at timestamp, seq int, v string")
    assert {(r["k"], r["v"]) for r in merge.latest(rows, ["k"], "at", ["seq"]).collect()} == {("a", "y"), ("b", "z")}
    old = merge.history(rows, ["k"], "v", "at", ["seq"]).collect()
    assert [(r["v"], r["next_value"], r["replaced_at"]) for r in old] == [("x", "y", t(3))]


def test_patches_apply_once(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, v string").withColumn("fingerprint", merge.fingerprint(F.col("v")))
    assert sorted((r["id"], r["times"]) for r in merge.apply_once(rows, "id").collect()) == [(1, 2), (3, 1)]


ROSTER = [(1, "Ann B Smith", "x"), (2, "Bob Smith", "x"), (3, "Cy Lee", "x"), (4, "Cy Lee", "y"), (5, "Ann C Smith", "x"), (6, "Dé Jong", "x")]
NAMES = [(1, "Cy Lee", "x"), (2, "Lee", "x"), (3, "Smith", "x"), (4, "B Smith", "x"), (5, "Ann B. Smith", "x"), (6, "Nobody", "x"), (7, "De Jong", "x"), (8, None, "x"), (9, "A B Smith", "x")]


def test_name_cascade_never_guesses(spark):
    out = resolve.match_names(spark.createDataFrame(NAMES, "record_id long, name string, scope string"), spark.createDataFrame(ROSTER, "person_id long, name string, scope string"))
    found = {r["record_id"]: (r["person_ids"], r["method"]) for r in out.collect()}
    assert found[1] == ([3], "exact_name_same_scope") and found[2] == ([3], "unique_surname_same_scope")
    assert found[3] == ([], "ambiguous") and found[5] == ([1], "exact_name_same_scope") and found[6] == ([], "unresolved")
    assert found[7] == ([6], "exact_name_same_scope") and found[8] == ([], "unresolved")
    assert found[4] == ([1], "unique_surname_same_scope") and found[9] == ([1], "unique_first_last_same_scope")


def test_preservation(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "k int, x string, y int")
    new = spark.createDataFrame([(1, None, 1), (2, "b", 5), (4, "d", 4)], "k int, x string, y int")
    assert sorted(map(tuple, quality.preservation(old, new, "k").collect())) == [(1, "x", "lost"), (3, "", "removed")]


def test_quotes(spark):
    body = "One  two\nthree"
    import hashlib

    pages = spark.createDataFrame([(1, body, hashlib.sha256(body.encode()).hexdigest()), (2, body, "0")], "capture_id int, body string, sha256 string")
    quotes = spark.createDataFrame([(1, 1, "two three"), (2, 1, "four"), (3, 2, "One"), (4, 9, "x")], "quote_id int, capture_id int, quote string")
    assert {r["quote_id"]: r["status"] for r in quality.quotes_found(quotes, pages).collect()} == {1: "ok", 2: "quote_not_found", 3: "hash_mismatch", 4: "no_capture"}


def test_queue_states(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([("a", t(1), True), ("a", t(2), True), ("b", t(1), True), ("b", t(2), False), ("c", t(1), True), ("c", t(2), True), ("c", t(3), True)], "k string, at timestamp, bad boolean")
    out = {r["k"]: (r["state"], r["retry_at"]) for r in queue.schedule(rows, "k", "at", F.col("bad")).collect()}
    assert out == {"a": ("pending", t(4)), "b": ("done", None), "c": ("unresolved", None)}


def test_host_gate_stream(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([("a", t(0)), ("a", t(1)), ("a", t(30)), ("b", t(0))], "host string, at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = windows.drained(queue.host_gate(stream, 10.0), "append").collect()
    assert {(r["host"], r["at"], r["slot"]) for r in got} == {("a", t(0), t(0)), ("a", t(1), t(10)), ("a", t(30), t(30)), ("b", t(0), t(0))}


def test_sources_keep_what_does_not_parse(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": "1", "b": "Unknown"}\n{"a": \n')
    schema = StructType([StructField("a", StringType()), StructField("b", StringType())])
    rows = captures.read_json(spark, str(tmp_path / "x.jsonl"), schema, lines=True).collect()
    assert sum(r["_corrupt"] is not None for r in rows) == 1
    clean = captures.sentinels_to_null(spark.createDataFrame([("1", "Unknown"), ("", "x")], schema))
    assert sorted(clean.collect(), key=str) == [("1", None), (None, "x")]
    captures.write_lines(clean.where("a is not null"), str(tmp_path / "out"))
    assert [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()] == [{"a": "1"}]


def test_robots(spark):
    body = "User-agent: x\nDisallow: /x\n\nUser-agent: *\nUser-agent: y\nDisallow: /p # c\nAllow: /p/q\n"
    rows = captures.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"), "host", "body").collect()
    assert [(r["rule"], r["path"]) for r in sorted(rows, key=lambda r: r["n"])] == [("disallow", "/p"), ("allow", "/p/q")]


def test_vcards(spark):
    body = "BEGIN:VCARD\r\nVERSION:3.0\r\nFN:Ann Lee\r\nEMAIL;TYPE=work:A@B.edu\r\nTITLE:Long\r\n er\r\nEND:VCARD\r\n"
    rows = captures.vcards(spark.createDataFrame([(1, body), (2, None)], "k int, body string"), "k", "body").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "Ann Lee", "a@b.edu", None, "Longer")]

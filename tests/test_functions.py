import datetime as dt
import unicodedata
import urllib.parse

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import dates, html, text, urls


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_fold_and_normalize(spark):
    given_ = ["Éa  Zürich", "Ärger--x", None, "  ", "a@b.c + d", "ñandú!"]
    assert column(spark, given_, text.normalize) == ["ea zurich", "arger--x", "", "", "a@b.c + d", "nandu"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs", "Cc"])), min_size=1, max_size=20))
def test_fold_is_decomposition_without_marks(spark, values):
    def plain(v):
        keep = []
        for c in v:
            d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M"))
            keep.append(d if len(d) == 1 and ord(c) >= 0xC0 else c)
        return "".join(keep).lower()

    assert column(spark, values, text.fold_text) == [plain(v) for v in values]


def test_url_keys(spark):
    given_ = ["HTTP://Www.A.org", "https://a.org/x/index.html?utm_source=q&b=1&fbclid=2#f", "ftp://a.org/", "http://u:p@a.org/", "http://a b.org", None, "https://a.org/x/"]
    assert column(spark, given_, urls.url_key) == ["http://www.a.org/", "https://a.org/x/index.html?utm_source=q&b=1&fbclid=2", "", "", "", "", "https://a.org/x/"]
    assert column(spark, given_, urls.comparison_key) == ["a.org", "a.org/x?b=1", "", "", "", "", "a.org/x"]
    assert column(spark, given_, urls.valid_url) == [True, True, False, False, False, False, True]


def test_resolve_follows_the_library(spark):
    base = "https://a.org/x/y.html?q=1#z"
    hrefs = ["b.html", "/c", "//d.org/e", "https://f.org/g", "?s"[:0] or "h/i"]
    rows = spark.createDataFrame([(h,) for h in hrefs], "h string").select(html.resolve(F.lit(base), F.col("h")).alias("r"))
    assert [r["r"] for r in rows.collect()] == [urllib.parse.urljoin(base, h) for h in hrefs]


def test_terms(spark):
    terms = ["Fall 2023", "Summer 1 2024", "winter 2020", "Autumn", None, "Spring 2024"]
    assert column(spark, terms, dates.term_order) == [20234, 20243, 20201, 4, 0, 20242]
    status = column(spark, terms, lambda c: dates.term_status(c, F.lit("2024-06-28").cast("date")))
    assert status == ["historical", "scheduled", "undated", "undated", "undated", "scheduled"]


def test_local_date(spark):
    at = [dt.datetime(2024, 7, 1, 6, 59), dt.datetime(2024, 1, 1, 7, 59), dt.datetime(2024, 1, 1, 8, 0)]
    assert column(spark, at, dates.local_date, "timestamp") == [dt.date(2024, 6, 30), dt.date(2023, 12, 31), dt.date(2024, 1, 1)]


def test_backoff(spark):
    assert column(spark, [0, 1, 3], dates.queue_backoff, "int") == [30, 60, 240]
    assert column(spark, [1, 2, 7, 50], dates.host_backoff, "int") == [60, 120, 3600, 3600]


def test_tables_and_titles(spark):
    page = "<title>A &amp; B</title><table><tr><th>x</th><th>y</th></tr><tr><td> 1\n2 </td><td><b>3</b></td></tr></table>"
    assert column(spark, [page, None], html.title) == ["A & B", None]
    assert column(spark, [page], html.table_rows) == [[["x", "y"], ["1 2", "3"]]]


def test_sentences_and_mail(spark):
    t = "Short. " + "This long sentence tells what the group studies and why it does. " + "End."
    assert column(spark, [t, None], lambda c: text.first_sentence(c, ["studies"])) == ["This long sentence tells what the group studies and why it does.", None]
    assert column(spark, ["write to A.b@C.edu or x@y.org", "none", None], text.first_email) == ["a.b@c.edu", None, None]


def test_spans_of_any_number_of_rows():
    from quarry.functions import markup

    table = lambda rows: markup.table_cells(next(markup.tree(f"<table>{rows}</table>").all()))
    body = "".join(f"<tr><td>{i}</tr>" for i in range(2500))
    assert table(f"<tr><td rowspan=2501>N</td><td>x</tr>{body}<tr><td>last</tr>") == [["N", "x"], *[["N", str(i)] for i in range(2500)], ["last"]]
    assert [len(r) for r in table("<tr><td colspan='²'>a</td><td colspan=1000>b</td><td rowspan=0>c</td><td colspan='2 '>d</tr>")] == [1 + 1000 + 1 + 2]

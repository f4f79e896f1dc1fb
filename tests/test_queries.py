import duckdb
import pytest

from quarry.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_a_schema(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns
    df.collect()


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def on_pages(spark, tmp_path, rows, name):
    """Rows of a query and of its SQL over pages of (page_id, url, html)."""
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    mine = QUERIES[name](spark, str(tmp_path))
    rel = con.execute(f"select {', '.join(mine.columns)} from ({SQL[name]})")
    return sorted(map(tuple, mine.collect())), sorted(rel.fetchall())


def test_references_without_a_semicolon_stay(spark, tmp_path):
    texts = ["a &amp; b", "a &amp", "&ampb &copy c", "&notit; &amp;amp &eacute; &#39;", "x & y &&lt;"]
    rows = [(i, "http://a.org/", f"<h1>t</h1><a href='/b'>b</a><article><p>{t}</p></article>") for i, t in enumerate(texts)]
    mine, sql = on_pages(spark, tmp_path, rows, "page_main_text")
    assert mine == sql


def test_no_row_for_routes_that_there_are_none_of(spark, tmp_path):
    mine, sql = on_pages(spark, tmp_path, [(i, "http://a.org/", "") for i in range(1500)], "url_lookups")
    assert mine == sql
    assert [r[1] for r in mine if r[0] == "route"] == ["held"]

"""The parse of pages: once a page, in pieces that stay in order."""

from tessera.operators import extract
from tessera.plans import catalog


def test_pages_are_parsed_once(spark, tmp_path):
    spark.createDataFrame([(1, "https://a.in/", '<a href="/x">x</a><a href="https://b.in">b</a>')], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = catalog.page_link_counts(spark, str(tmp_path))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in rows.collect()] == [(1, 2, 1)]


def test_pieces_of_a_batch_stay_in_order(spark):
    big = "<p>" + "x" * (extract.PIECE_CHARS // 3)
    rows = [(i, f"https://a.in/{i}", None if i % 7 == 3 else f"<title>{i}</title>{big if i % 2 else ''}") for i in range(40)]
    got = extract.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).select("page_id", "page.title").collect()
    assert [(r.page_id, r.title) for r in got] == [(i, None if h is None else str(i)) for i, _, h in rows]

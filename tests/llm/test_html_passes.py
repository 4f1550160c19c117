"""op4 parses a page twice: once for all counts of its host, once for its text."""

from siftmill.llm import html_extract, shared


def test_pages_are_parsed_twice(spark, monkeypatch):
    read = []
    real = shared.in_arrow
    monkeypatch.setattr(shared, "in_arrow", lambda df, run, schema: read.append("html" in df.columns) or real(df, run, schema))
    rows = [(k, f"http://h{k % 2}.example/{k}", f"<html><head><title>{k}</title></head><body><p>Same on all pages.</p><div>Page {k} has {k * k} things.</div></body></html>") for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(spark, pages).collect()}
    assert got == {k: f"Page {k} has {k * k} things." for k in range(8)}
    assert sum(read) == 2

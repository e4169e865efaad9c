"""Layout of tables, visibility apart from display, and pages as a table with odd rows."""

from loomspark.llm import html_text

r = html_text.render


def test_visibility():
    assert r('<div style="visibility:hidden">no<span style="visibility:visible">yes</span></div>') == "yes"
    assert r("<style>.v{visibility:collapse}.w{visibility:visible}</style><p class=v>no <b>no <i class=w>a</i></b><img alt=no></p>b") == "a\n\nb"
    assert r('<div style="display:none">no<span style="visibility:visible;display:block">no</span></div>x') == "x"
    assert r('<ol><li>a<li style="visibility:hidden">no<li>c</ol>') == "1. a\n3. c"
    assert r('<table style="visibility:hidden"><tr><td>no<td style="visibility:visible">b<tr><td>no</table>') == " | b"
    assert r('<p style="visibility:hidden">no<textarea>no</textarea><p>a') == "a"


def test_spans():
    assert r("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e</table>") == "a | b | c\n  | d | e"
    assert r("<table><tr><td colspan=2>both<td>z<tr><td>a<td>b<td>c</table>") == "both  | z\na | b | c"
    assert r("<table><tr><td>a<td>b<td>c<tr><td colspan=2>over both of them<td>z</table>") == "a | b             | c\nover both of them | z"
    assert r("<table><tr><td rowspan=0>q<td>w<tr><td>u<tr><td>v</table>") == "q | w\n  | u\n  | v"
    assert r("<table><tr><td>a<td rowspan=2>b<tr><td colspan=9>c</table>") == "a | b\nc |"


def test_wide_cells():
    x = "x" * 200
    assert r(f"<table><tr><td>{x}<td>y<tr><td>a<td>b</table>") == f"{x} | y\n{'a'.ljust(200)} | b"
    one = "<table><tr><td>" + "x" * 50_000 + "<td>y" + "<tr><td>a<td>b" * 5000 + "</table>"
    assert len(r(one)) < 5 * len(one) and r(one).endswith("a | b")  # one long cell doesn't pad thousands of rows
    assert len(r("<table><tr>" + "<td rowspan=65534 colspan=1000>a" * 300 + "<tr><td>b" * 3000 + "</table>")) < 1_000_000


def test_rows(spark):
    rows = [(1, "u", "<p>a", "t", 1), (1, "u", "<p>a", "t", 1), (None, None, "<p>b", "t", 1), (2, "u", None, None, None), (3, "u", "", "t", 1), (4, "u", "<td>" * 3 + "plain", "t", 1), (5, "u", "long " * 200_000, "t", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, span int").repartition(3)
    got = sorted((str(x["page_id"]), str(x["url"]), x["text"]) for x in html_text.extract(df).collect())
    assert got == sorted((str(p), str(u), html_text.render(h)) for p, u, h, *_ in rows)
    assert html_text.extract(df.limit(0)).count() == 0 and html_text.extract(df).columns == ["page_id", "url", "text"]

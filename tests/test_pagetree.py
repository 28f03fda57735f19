"""Page trees on planted nesting, sloppy markup and odd pages."""

from pyspark.sql import functions as F

from marketlens.operators import pagetree as P


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string").repartition(2)


def test_elements_of_sloppy_markup(spark):
    html = "<ul><li>a<ul><li>b</li><li>c</ul><li>d</ul><A HREF=/x?a=1&amp;b=2 title='q\"r'>go <b>on</b></A><a href=\"y\">open<script>var t='<a href=z>';</script><!-- <a href=c> -->"
    found = P.elements(pages(spark, html, None, "", "plain < text & more"), ("li", "a")).collect()
    assert [(r.tag, r.text) for r in sorted(found, key=lambda r: r.at)] == [("li", "abc"), ("li", "b"), ("li", "c"), ("li", "d"), ("a", "go on"), ("a", "open")]
    assert [r.attrs["href"] for r in sorted(found, key=lambda r: r.at) if r.tag == "a"] == ["/x?a=1&b=2", "y"]
    assert {r.page_id for r in found} == {0}
    inner = next(r for r in found if r.text == "b")
    assert [(a.at, a.tag) for a in inner.around] == [(0, "li")]


def test_rows_and_cells_belong_to_the_nearest_table(spark):
    html = "<table><tr><td>a<td>b <table><tr><th>c</th><td>d</table><tr><td>e</tbody></table><td>stray</td>"
    rows = P.table_rows(P.elements(pages(spark, html))).collect()
    assert sorted([c.text for c in r.cells] for r in rows) == [["a", "b cd"], ["c", "d"], ["e"]]


def test_ends_do_not_reach_out_of_a_cell(spark):
    html = "<div class=box><table><tr><td>a</div></li><td>b</table><p>in</div><p>out"
    found = {(r.tag, r.text) for r in P.elements(pages(spark, html), ("td", "div"), ()).collect()}
    assert found == {("td", "a"), ("td", "b"), ("div", "abin")}


def test_table_specs_keep_their_limits(spark):
    long = "<table>" + "".join(f"<tr><td>k{i}<td>v{i}" for i in range(101)) + "</table>"
    html = "<table><tr><td>Display<tr><td>Size<td>6<td>x<tr><td>same<td>same<tr><td>" + "k" * 80 + "<td>v<tr><td>k<td>" + "v" * 300 + "<tr><th>Body<tr><td>Size<td>7</table><table><tr><td>one<td>row</table><table><tr><td>W<td>1<tr><td>W<td>2</table>"
    out = P.last_said(P.table_specs(P.elements(pages(spark, html, long))))
    assert {(r.page_id, r.k, r.v) for r in out.collect()} == {(0, "Display: Size", "6"), (0, "Body: Size", "7"), (0, "Body: W", "2")}


def test_cards(spark):
    html = "<a href='/outer'><div class='product-info'><h3>Thing 5</h3><span class='price-unit-price'>65.800 L</span></div></a><div class=product-box><a href=/in>Linked <i>name</i></a></div><div class=product-box><h2>none</h2></div>"
    rows = sorted((r.name, r.url, r.price) for r in P.cards(pages(spark, html)).collect())
    assert rows == [("Linked name", "/in", None), ("Thing 5", "/outer", 65800.0)]


def test_many_pages_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(P, "BATCH", 3)
    df = spark.range(200).select(F.struct("id", F.lit("s").alias("s")).alias("page_id"), F.concat(F.lit("<p><a href=/"), "id", F.lit(">x</a><a>y</a>")).alias("html"))
    rows = P.elements(df, ("a",)).collect()
    assert len(rows) == 400 and {(r.page_id.id, r.attrs.get("href")) for r in rows} == {(i, h) for i in range(200) for h in (f"/{i}", None)}

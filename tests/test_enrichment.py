"""Enrichment rules that the driver's tables do not reach."""

from pyspark.sql import functions as F

from marketlens.operators import enrichment as E


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_specs_from_name(spark):
    specs = lambda n: one(spark, E.specs_from_name(F.col("n"), (("black", "black|zi"), ("white", "white|bardhe"), ("blue", "blue"))), n=n)
    assert specs('Laptop 15.6" IPS 16GB RAM 512GB black') == {"Storage": "512GB", "RAM": "16GB", "Screen": "15.6", "Panel": "IPS", "Colour": "black"}
    assert specs("Frigorifer 300 L 90 W") == {"Volume": "300", "Power": "90"}
    assert specs("") == {} and specs(None) == {}


def test_page_details(spark):
    html = """<title>A &amp; B</title><meta name="description" content="text"><meta property="og:image" content="http://x/1.png">
    <img src="http://x/1.png"><img src='https://x/2.png'><table><tr><th>Size</th><td><b>6.1</b> in</td></tr><tr><td>one</td></tr></table><dl><dt>Weight</dt> <dd>1kg</dd></dl>"""
    rows = {r.page_id: r for r in E.page_details(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()}
    r = rows[1]
    assert (r.title, r.description, r.images) == ("A & B", "text", ["http://x/1.png", "https://x/2.png"])
    assert [(p.k, p.v) for p in r.pairs] == [("Size", "6.1 in"), ("Weight", "1kg")]
    assert (rows[2].title, rows[2].description, rows[2].images, rows[2].pairs) == (None, None, [], [])


def test_regions(spark):
    told = lambda models, brand: tuple(one(spark, E.region(F.col("m"), F.col("b")), m=models, b=brand))
    assert told(["SM-S921B"], "Samsung") == ("EU", "confirmed") and told(["SM-S921U1"], None) == ("US", "confirmed")
    assert told(["SM-S921U", "SM-S921B"], "Samsung") == ("EU", "likely") and told(["X"], "Samsung") == ("Unknown", "unclear")
    assert told(["A3090"], "Apple") == ("EU", "likely") and told([], "Apple") == ("Unknown", "unclear") and told(["Z"], "Nokia") == ("Global", "unclear")
    pick = lambda models, brand: one(spark, E.regional_model(F.col("m"), F.col("b")), m=models, b=brand)
    assert (pick(["SM-1U", "SM-1B"], "Samsung"), pick(["A1", "A2"], "Apple"), pick([], "Apple")) == ("SM-1B", "A1", "")


def test_first_source(spark):
    rows = [(1, 0, "maker", {}, []), (1, 1, "device", {"a": "b"}, []), (1, 2, "store", {"c": "d"}, ["i"]), (2, 0, "maker", None, None)]
    found = spark.createDataFrame(rows, "product_id long, priority int, source string, specs map<string,string>, images array<string>")
    assert [(r.product_id, r.source) for r in E.first_source(found).collect()] == [(1, "device")]


def test_small_rules(spark):
    assert one(spark, E.is_light(F.col("h")), h="#ffffff") is True and one(spark, E.is_light(F.col("h")), h="#102030") is False
    assert [one(spark, E.history_days(F.col("d")), d=d) for d in ("365", "7", "60", "x", None, "0")] == [90, 30, 60, 90, 90, 90]
    threshold = lambda p, e, t: one(spark, E.alert_threshold(F.col("p"), F.col("e"), F.col("t")), p=p, e=e, t=t)
    assert threshold("p", "a@b.c", "12.9") == 12 and threshold("", "a@b.c", "5") is None and threshold("p", "a b@c.d", "5") is None and threshold("p", "a@b.c", None) is None
    assert one(spark, E.duration(F.col("s").cast("int")), s="0") == "acum"


def test_spec_preview(spark):
    rows = [(1, f"s{i}", i, [(j, f"k{j}", "v") for j in range(5)]) for i in range(4)]
    sections = spark.createDataFrame(rows, "id long, section string, first int, items array<struct<pos:int,k:string,v:string>>")
    preview = E.spec_preview(sections).first().preview
    assert [p.section for p in preview] == ["s0", "s1", "s2"] and all(len(p["items"]) == 3 for p in preview)

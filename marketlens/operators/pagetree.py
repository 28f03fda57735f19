"""Pages as rows of elements, and what tables, lists and cards in them say.

``elements`` reads each page once with a stack of open tags, so nesting, unclosed
tags, quotes of any kind and entities are as in the page. A page becomes a row
for each element of interest with its place, its text and the elements of
interest around it. All rules work on these rows, by grouping and windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.functions.rows import once

TAGS = ("table", "tr", "td", "th", "dl", "dt", "dd", "ul", "ol", "li", "a", "img", "meta", "title", "h1", "h2", "h3")
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that a tag closes where they are still open, up to the list or table around it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",), "option": ("option",)}
AROUND = frozenset(("table", "ul", "ol", "dl", "select"))
#: Parts of a table, whose ends close the cells in them.
STRUCTURE = frozenset(("table", "thead", "tbody", "tfoot", "tr", "td", "th"))
#: Rows of elements in one batch at most.
BATCH = 4_096

_AROUND_TYPE = "array<struct<at:int,tag:string,class:string>>"


class _Reader(HTMLParser):
    """Collects (at, tag, attributes, text, around) of the wanted elements of one page, in order of their ends."""

    def __init__(self, tags: frozenset, classes: frozenset):
        super().__init__(convert_charrefs=True)
        self.tags, self.classes = tags, classes
        self.open: list[tuple] = []  # tag, at or None, attributes, first piece of text, wanted elements around
        self.around: list[dict] = []
        self.pieces: list[str] = []
        self.found: list[tuple] = []
        self.n = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines are not counted: nothing asks where a tag stands in the text

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES:
            still = None
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in AROUND:
                    break
                if self.open[i][0] in CLOSES[tag]:
                    still = i
            if still is not None:
                self._close(still)
        given = {k: v or "" for k, v in reversed(attrs)}  # the first of equal names counts
        wanted = tag in self.tags or not self.classes.isdisjoint(given.get("class", "").split())
        at = None
        if wanted:
            at, self.n = self.n, self.n + 1
        self.open.append((tag, at, given, len(self.pieces), list(self.around) if wanted else None))
        if wanted:
            self.around.append({"at": at, "tag": tag, "class": given.get("class", "")})
        if tag in VOID:
            self._close(len(self.open) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            here = self.open[i][0]
            if here == tag:
                return self._close(i)
            if here == "table" or (here in ("td", "th") and tag not in STRUCTURE):
                return  # the end of something around this table or cell

    def handle_data(self, data: str) -> None:
        if not self.open or self.open[-1][0] not in ("script", "style"):
            self.pieces.append(data)

    def _close(self, upto: int) -> None:
        while len(self.open) > upto:
            tag, at, given, first, around = self.open.pop()
            if at is not None:
                self.around.pop()
                self.found.append((at, tag, given, "".join(self.pieces[first:]), around))

    def read(self, html: str) -> list[tuple]:
        self.feed(html)
        self.close()
        self._close(0)
        return sorted(self.found, key=lambda e: e[0])


def elements(pages: DataFrame, tags: tuple[str, ...] = TAGS, classes: tuple[str, ...] = ()) -> DataFrame:
    """page_id, at (place in the page), tag, attrs, text and around (outermost first) of the elements with these tags or classes.

    Text is that of the whole element, scripts and styles aside, entities
    decoded. Null and empty pages have no elements; page_id may be anything.
    """
    kinds, named = frozenset(tags), frozenset(classes)
    key = pages.schema["page_id"].dataType
    around = pa.list_(pa.struct([("at", pa.int32()), ("tag", pa.string()), ("class", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, html in enumerate(batch.column("html").to_pylist()):
                rows += [(i, *e) for e in _Reader(kinds, named).read(html or "")]
                if len(rows) >= BATCH or i + 1 == len(batch):
                    at, *rest = zip(*rows, strict=True) if rows else ((),) * 6
                    types = (pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), around)
                    columns = [pa.array([list(a.items()) for a in x] if t == types[2] else x, t) for x, t in zip(rest, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(at, pa.int64())), *columns], names=["page_id", "at", "tag", "attrs", "text", "around"])
                    rows = []

    return pages.select("page_id", "html").mapInArrow(read, f"page_id {key.simpleString()}, at int, tag string, attrs map<string,string>, text string, around {_AROUND_TYPE}")


def by_page(found: DataFrame) -> DataFrame:
    """Elements dealt out by page, for several rules on one frame: all of them read the one shuffle, so no page is parsed again for each.

    The columns go through a generator of one row, which neither filters nor the
    choice of columns pass, so what lies below is the same for every rule.
    """
    columns = [c for c in found.columns if c != "page_id"]
    return found.repartition("page_id").select("page_id", F.stack(F.lit(1), *columns).alias(*columns))


def has_class(classes: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(classes, F.lit("")), r"\s+"), name)


def _said(text: Column) -> Column:
    return T.squeeze(text)


def table_rows(found: DataFrame) -> DataFrame:
    """page_id, table, row (places) and cells (at, tag, class, text) of every row. A cell belongs to the nearest row around it, a row to the nearest table; the text of a cell holds that of tables in it."""
    cells = found.filter(F.col("tag").isin("td", "th")).select("page_id", F.struct("at", "tag", F.col("attrs")["class"].alias("class"), _said(F.col("text")).alias("text")).alias("cell"), "around")
    nearest = lambda tag: F.try_element_at(F.filter("around", lambda a: a["tag"] == tag)["at"], F.lit(-1))
    own = cells.select("page_id", "cell", nearest("table").alias("table"), nearest("tr").alias("row")).filter("row > table")
    return own.groupBy("page_id", "table", "row").agg(F.array_sort(F.collect_list("cell")).alias("cells"))


def _pairs(page_id, source: int, at, k, v) -> list[Column]:
    return [page_id, F.struct(F.lit(source).alias("source"), *at).alias("place"), k.alias("k"), v.alias("v")]


def table_specs(found: DataFrame, least_rows: int = 2, most_rows: int = 100, default: str = "Tjera") -> DataFrame:
    """page_id, place, k, v of the tables with so many rows. A row of one short cell heads a section, which holds until the next, also over tables."""
    rows = table_rows(found)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("page_id", "table"))).filter(F.col("n").between(least_rows, most_rows))
    first = F.get("cells", F.lit(0))["text"]
    heads = F.when((F.size("cells") == 1) & F.length(first).between(1, 59), first)
    so_far = Window.partitionBy("page_id").orderBy("table", "row").rowsBetween(Window.unboundedPreceding, 0)  # one page
    rows = rows.withColumn("section", F.coalesce(F.last(heads, ignorenulls=True).over(so_far), F.lit(default))).filter(F.size("cells") >= 2)
    k, v = first, F.get("cells", F.lit(1))["text"]
    rows = rows.filter(F.length(k).between(1, 79) & F.length(v).between(1, 299) & (k != v))
    key = F.when(F.col("section") != default, F.concat("section", F.lit(": "), k)).otherwise(k)
    return rows.select(*_pairs(F.col("page_id"), 0, (F.col("table").alias("outer"), F.col("row").alias("inner")), key, v))


def definition_specs(found: DataFrame) -> DataFrame:
    """page_id, place, k, v of definition lists: the n-th term with the n-th definition."""
    rows = found.filter(F.col("tag").isin("dt", "dd")).select("page_id", "at", "tag", _said(F.col("text")).alias("text"), F.explode(F.filter("around", lambda a: a["tag"] == "dl")["at"]).alias("list"))
    side = lambda tag: F.array_sort(F.collect_list(F.when(F.col("tag") == tag, F.struct("at", "text"))))
    lists = rows.groupBy("page_id", "list").agg(side("dt").alias("terms"), side("dd").alias("said"))
    n = F.least(F.size("terms"), F.size("said"))
    both = lists.select("page_id", "list", F.posexplode(F.arrays_zip(F.slice(F.col("terms.text"), 1, n).alias("k"), F.slice(F.col("said.text"), 1, n).alias("v"))).alias("n", "p"))
    both = both.filter(F.length("p.k").between(1, 79) & F.length("p.v").between(1, 299))
    return both.select(*_pairs(F.col("page_id"), 1, (F.col("list").alias("outer"), F.col("n").alias("inner")), F.col("p.k"), F.col("p.v")))


def attribute_specs(found: DataFrame, rules: tuple[tuple[str, str, tuple[str, ...], tuple[str, ...]], ...]) -> DataFrame:
    """page_id, place, k, v of attribute lists.

    rules: (class of the list, tag or .class of an item, tags or .classes of its
    label, of its value). Texts of several labels of an item are joined.
    """
    fits = lambda what, tag, classes: has_class(classes, what[1:]) if what.startswith(".") else tag == what
    out = None
    for n, (holder, item, labels, values) in enumerate(rules):
        def any_of(what):
            hit = F.lit(False)
            for w in what:
                hit = hit | fits(w, F.col("tag"), F.col("attrs")["class"])
            return hit

        inside = F.filter("around", lambda a: has_class(a["class"], holder))["at"]
        items = F.filter("around", lambda a: fits(item, a["tag"], a["class"]) & (a["at"] > F.try_element_at(inside, F.lit(1))))["at"]
        rows = found.select("page_id", "at", "text", F.when(any_of(labels), "k").when(any_of(values), "v").alias("side"), F.explode(items).alias("item")).filter("side is not null")
        text = lambda s: _said(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("at", "text")))), lambda x: x["text"]), ""))
        both = rows.groupBy("page_id", "item").agg(text("k").alias("k"), text("v").alias("v")).filter(F.length("k").between(1, 79) & F.length("v").between(1, 299))
        both = both.select(*_pairs(F.col("page_id"), 2 + n, (F.col("item").alias("outer"), F.lit(0).alias("inner")), F.col("k"), F.col("v")))
        out = both if out is None else out.unionByName(both)
    return out


def last_said(pairs: DataFrame) -> DataFrame:
    """page_id, k, v: of equal keys of a page the value that stands last, tables before lists before attributes."""
    return pairs.groupBy("page_id", "k").agg(F.max_by("v", "place").alias("v"))


def images(found: DataFrame, most: int = 8) -> DataFrame:
    """page_id and images: the shared image, then those whose address tells that they show the product, so many at most, without repeats."""
    src = F.coalesce(F.nullif(F.col("attrs")["src"], F.lit("")), F.col("attrs")["data-src"])
    shared = (F.col("tag") == "meta") & (F.col("attrs")["property"] == "og:image")
    url = F.when(shared, F.col("attrs")["content"]).when(F.col("tag") == "img", src)
    shows = (url.contains("product") | url.contains("media")) & ~url.contains("logo") & ~url.contains("icon")
    rows = found.select("page_id", "at", url.alias("url"), F.when(shared, 0).otherwise(1).alias("later"), (shared | shows).alias("fine")).filter("fine and url like 'http%'")
    rows = rows.groupBy("page_id", "url").agg(F.min(F.col("later").cast("long") * 2**40 + F.col("at")).alias("place"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("place"))).filter(F.col("n") <= most)
    return rows.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "url"))), lambda x: x["url"]).alias("images"))


def cards(pages: DataFrame, holders: tuple[str, ...] = ("product-box", "product-info", "product-name"), names: tuple[str, ...] = ("product-name", "name"), prices: tuple[str, ...] = ("price-unit-price",)) -> DataFrame:
    """page_id, at, name, url, image, price of the product cards of search pages, a row for each element with one of the holders' classes.

    The name is the first name or heading in the card, else the text of its first
    link; a card without a link in or around it is left out. Digits alone make a
    price, dots stand between thousands.
    """
    found = by_page(elements(pages, ("a", "img", "h2", "h3"), (*holders, *names, *prices))).filter("page_id is not null")  # by every rule, or their shuffles would differ
    of = lambda column, classes: F.exists(F.split(F.coalesce(column, F.lit("")), r"\s+"), lambda c: c.isin(*classes))
    boxes = found.filter(of(F.col("attrs")["class"], holders)).select("page_id", F.col("at").alias("box"), F.try_element_at(F.filter("around", lambda a: a["tag"] == "a")["at"], F.lit(-1)).alias("outer"))
    held = F.filter("around", lambda a: of(a["class"], holders))["at"]
    inner = found.select("page_id", "at", "tag", "attrs", _said(F.col("text")).alias("text"), F.explode(held).alias("box"))
    own = F.col("attrs")["class"]
    inner = once(  # each told once for an element, not for every column that asks
        inner, is_name=of(own, names) | F.col("tag").isin("h2", "h3"), is_link=(F.col("tag") == "a") & F.col("attrs")["href"].contains("/"), is_image=F.col("tag") == "img",
        is_price=of(own, prices), href=F.col("attrs")["href"], src=F.coalesce(F.nullif(F.col("attrs")["src"], F.lit("")), F.col("attrs")["data-src"]),
    ).drop("attrs").filter("is_name or is_link or is_image or is_price")
    first = lambda value, when: F.min_by(F.when(F.col(when), F.col(value)), F.when(F.col(when), F.col("at")))
    told = inner.groupBy("page_id", "box").agg(
        first("text", "is_name").alias("named"), first("text", "is_link").alias("linked"), first("href", "is_link").alias("href"), first("src", "is_image").alias("image"), first("text", "is_price").alias("priced"),
    )
    links = found.filter("tag = 'a'").select("page_id", F.col("at").alias("outer"), F.col("attrs")["href"].alias("outer_href"))
    rows = boxes.join(told, ["page_id", "box"], "left").join(links, ["page_id", "outer"], "left")
    name = F.coalesce(F.nullif("named", F.lit("")), F.nullif("linked", F.lit("")))
    digits = F.nullif(F.regexp_replace("priced", "[^0-9]", ""), F.lit("")).cast("double")
    rows = rows.select("page_id", F.col("box").alias("at"), name.alias("name"), F.coalesce("href", "outer_href").alias("url"), "image", digits.alias("price"))
    return rows.filter("name is not null and url is not null")


def device_specs(pages: DataFrame, title: str = "specs-phone-name-title", label: str = "ttl", info: str = "nfo") -> DataFrame:
    """page_id, name, section, k, v of device pages that have a name: rows with a label and an information cell; a heading holds until the next one."""
    found = by_page(elements(pages, ("table", "tr", "td", "th"), (title,)))
    names = found.filter(has_class(F.col("attrs")["class"], title)).groupBy("page_id").agg(F.min_by(_said(F.col("text")), "at").alias("name")).filter("name <> ''")
    rows = table_rows(found)
    text = lambda keep: _said(F.array_join(F.transform(F.filter("cells", keep), lambda c: c["text"]), ""))
    rows = rows.select("page_id", "row", text(lambda c: c["tag"] == "th").alias("h"), text(lambda c: has_class(c["class"], label)).alias("k"), text(lambda c: has_class(c["class"], info)).alias("v"))
    so_far = Window.partitionBy("page_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)  # one page
    rows = rows.withColumn("section", F.coalesce(F.last(F.nullif("h", F.lit("")), ignorenulls=True).over(so_far), F.lit(""))).filter("k <> '' and v <> ''")
    return names.join(rows, "page_id").groupBy("page_id", "name", "section", "k").agg(F.max_by("v", "row").alias("v"))

"""Facts out of saved HTML: detail pages, search results, financial pages, map feeds.

A page is scanned once, in order, by a small tag reader in Arrow batches; it gives one row for each element that is
asked for. Everything after that is columns and aggregates by page, which Spark combines before the shuffle, as the
elements of a page come out of one task. Null pages have no elements; broken markup is read as far as it goes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from leadloom.functions import numbers
from leadloom.functions.contact import is_directory_host, vat_codes
from leadloom.functions.text import filled, has
from leadloom.storage import materialize

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose start closes an open element of the listed names, unless one of the fences is met first.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "p": ({"p"}, {"div", "td", "li", "body"})}
#: Ancestors that are listed with an element: nearest first, at most so many.
_UP = 24
ELEMENT = "place int, tag string, classes array<string>, attrs map<string,string>, text string, parent int, nth int, up array<struct<place:int,tag:string,classes:array<string>,parent:int,nth:int>>"
#: Characters of pages whose elements are sent together.
SENT = 1 << 22
#: JSON-LD pairs deeper than this are not looked at.
LD_DEPTH = 12


class _Scan(HTMLParser):
    """Collects the wanted elements of a page, with their text (scripts and styles left out of it) and place among siblings."""

    def __init__(self, wanted: frozenset[str], ancestors: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.ancestors = ancestors
        self.wanted, self.rows, self.texts = wanted, [], []
        self.open: list[list] = [[0, "", [], -1, 0, 0, None, 0]]  # place, tag, classes, parent, nth, children, row, start of text
        self.count = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        shut, fences = _CLOSES.get(tag, ((), ()))
        for node in reversed(self.open[1:]):
            if node[1] in fences:
                break
            if node[1] in shut:
                self._close(node)
                break
        self.count += 1
        above = self.open[-1]
        named = {k: v or "" for k, v in attrs}
        classes = named.get("class", "").split()
        node = [self.count, tag, classes, above[0], above[5], 0, None, len(self.texts)]
        above[5] += 1
        if tag in self.wanted or not self.wanted.isdisjoint("." + c for c in classes) or not self.wanted.isdisjoint(f"[{k}]" for k in named):
            up = [{"place": n[0], "tag": n[1], "classes": n[2], "parent": n[3], "nth": n[4]} for n in reversed(self.open[1:])][:_UP] if self.ancestors else []
            node[6] = {"place": self.count, "tag": tag, "classes": classes, "attrs": list(named.items()), "text": "", "parent": node[3], "nth": node[4], "up": up}
            self.rows.append(node[6])
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for node in reversed(self.open[1:]):
            if node[1] == tag:
                self._close(node)
                break

    def _close(self, node: list) -> None:
        while len(self.open) > 1:
            last = self.open.pop()
            if last[6] is not None and last[1] not in ("script", "style"):
                last[6]["text"] = "".join(self.texts[last[7]:]).strip()
            if last is node:
                return

    def handle_data(self, data: str) -> None:
        last = self.open[-1]
        if last[1] in ("script", "style"):
            if last[6] is not None:
                last[6]["text"] += data
        else:
            self.texts.append(data)

    def finish(self) -> list[dict]:
        self.close()
        if len(self.open) > 1:
            self._close(self.open[1])
        if "#text" in self.wanted:
            self.rows.append({"place": 0, "tag": "#text", "classes": [], "attrs": [], "text": "".join(self.texts).strip(), "parent": -1, "nth": 0, "up": []})
        return self.rows


def _pairs(value, depth: int = 0) -> Iterator[tuple[str, str]]:
    """(key in lower case, text) of all members with text, in the document's order."""
    if depth > LD_DEPTH:
        return
    for key, item in value.items() if isinstance(value, dict) else ((None, v) for v in value):
        if key is not None and isinstance(item, str):
            yield key.lower(), item
        if isinstance(item, (dict, list)):
            yield from _pairs(item, depth + 1)


def _scan(pages: DataFrame, schema: str, rows_of, id_col: str, html_col: str) -> DataFrame:
    target = pages.select(F.col(id_col).alias("page_id")).schema.simpleString()[7:-1].replace(":", " ", 1)
    full = f"{target}, {schema}"
    arrow = to_arrow_schema(pages.sparkSession.createDataFrame([], full).schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = html.as_py() or ""
                rows += [{"page_id": page_id, **r} for r in rows_of(text)]
                size += len(text)
                if len(rows) >= 4096 or size >= SENT:  # the elements of small pages are sent together
                    for at in range(0, len(rows), 4096):
                        yield pa.RecordBatch.from_pylist(rows[at : at + 4096], arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, full)


#: A script or style, or an ampersand that begins no character reference with its semicolon.
_BARE = re.compile(r"<(script|style)\b.*?</\1\s*>|&(?!(?:#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*);)", re.I | re.S)


def elements(pages: DataFrame, wanted: Iterable[str], id_col: str = "page_id", html_col: str = "html", closed: bool = False, up: bool = True) -> DataFrame:
    """(page_id, ELEMENT) of the elements with a wanted tag, class (.name) or attribute ([name]), in document order; #text is the whole text.

    Browsers also read references without a semicolon (&amp for &); with closed, these are left as they are written. Without up, ancestors are not listed.
    """
    names = frozenset(wanted)

    def rows_of(html: str) -> list[dict]:
        scan = _Scan(names, up)
        scan.feed(_BARE.sub(lambda m: m[0] if m[1] else "&amp;", html) if closed else html)
        return scan.finish()

    return _scan(pages, ELEMENT, rows_of, id_col, html_col)


def linked_data(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, place, key, value): members with text of a page's JSON-LD blocks, nested lists and graphs included; blocks that are no JSON are passed over."""
    wanted = frozenset(["script"])

    def rows_of(html: str) -> list[dict]:
        if "ld+json" not in html:
            return []
        scan, found = _Scan(wanted), []
        scan.feed(html)
        for block in scan.finish():
            if dict(block["attrs"]).get("type") == "application/ld+json":
                try:
                    value = json.loads(block["text"])
                except (ValueError, RecursionError):
                    continue
                if isinstance(value, (dict, list)):
                    found += _pairs(value)
        return [{"place": k, "key": key, "value": value} for k, (key, value) in enumerate(found)]

    return _scan(pages, "place int, key string, value string", rows_of, id_col, html_col)


def _first(value: Column, place: str, where: Column) -> Column:
    """The value of the first place where the condition holds."""
    return F.min_by(F.when(where, value), F.when(where, F.col(place)))


def _is(tag: str) -> Column:
    return F.col("tag") == tag


def _classed(*names: str) -> Column:
    return F.arrays_overlap("classes", F.array(*map(F.lit, names)))


#: Types of linked data that tell of a company.
COMPANY_TYPES = re.compile(r"organization|localbusiness|corporation|\bstore\b|realestateagent|professionalservice|\bngo\b|\bcompany\b", re.I)
_FACTS = ("sameAs", "legalName", "name", "email", "telephone", "vatID", "taxID", "founder", "foundingDate")


def _plain(value) -> str | None:
    """A text or number as trimmed text; of a list its first; null for the rest."""
    if isinstance(value, list):
        return _plain(value[0]) if value else None
    return (value.strip() or None) if isinstance(value, str) else str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _companies(value, depth: int = 0) -> Iterator[dict]:
    """Nodes that tell of a company, outer ones first."""
    if depth > 6 or not isinstance(value, (dict, list)):
        return
    if isinstance(value, dict):
        kind = value.get("@type")
        kind = " ".join(map(str, kind)) if isinstance(kind, list) else kind if isinstance(kind, str) else ""
        if COMPANY_TYPES.search(kind) or "sameAs" in value or "aggregateRating" in value:
            yield value
    for item in value.values() if isinstance(value, dict) else value:
        yield from _companies(item, depth + 1)


def company_facts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, node, place, key, value): what the company nodes of a page's JSON-LD say, in order; ratings as rating and reviews."""
    wanted = frozenset(["script"])

    def said(node: dict) -> Iterator[tuple[str, str | None]]:
        for key in _FACTS:
            many = node.get(key)
            if key == "sameAs":
                yield from ((key, v) for v in (many if isinstance(many, list) else [many]) if isinstance(v, str))
            elif key == "founder" and isinstance(many, dict):
                yield key, _plain(many.get("name"))
            else:
                yield key, _plain(many)
        rating = node.get("aggregateRating")
        if isinstance(rating, dict):
            yield "rating", _plain(rating.get("ratingValue"))
            yield "reviews", _plain(rating.get("reviewCount")) or _plain(rating.get("ratingCount"))

    def rows_of(html: str) -> list[dict]:
        if "ld+json" not in html:
            return []
        scan, out, n = _Scan(wanted), [], 0
        scan.feed(html)
        for block in scan.finish():
            if dict(block["attrs"]).get("type", "").lower() == "application/ld+json":
                try:
                    value = json.loads(block["text"])
                except (ValueError, RecursionError):
                    continue
                for node in _companies(value):
                    out += [{"node": n, "place": k, "key": key, "value": v} for k, (key, v) in enumerate(said(node)) if v]
                    n += 1
        return out

    return _scan(pages, "node int, place int, key string, value string", rows_of, id_col, html_col)


# --- detail pages -----------------------------------------------------------------------------------------------

#: The anchor that names a company's own site, and the classes of its address.
SITE_MARK = "scheda_azienda__cta_sitoweb"
ADDRESS_CLASSES = ["sede__indirizzo", "scheda-azienda__addr", "contact__address", "search-itm__adr"]


def detail_pages(pages: DataFrame, closed: bool = False) -> DataFrame:
    """(page_id, official_website, vat_code, phone, email, name, address) of company pages that give any of them.

    JSON-LD comes first, in its order; then a pattern over the page; then what is seen on it. Pages of fewer than
    200 characters give nothing. The site named is the marked anchor, then any that says so, never a directory's.
    closed is that of elements().
    """
    whole = pages.filter(F.length("html") >= 200)
    seen = elements(whole, ["a", "h1", *("." + c for c in ADDRESS_CLASSES)], closed=closed, up=False)
    href = F.trim(F.col("attrs")["href"])
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    mark = F.coalesce(F.col("attrs")["data-tr"], F.lit(""))
    said = (mark == SITE_MARK) | low(mark).contains("sitoweb") | low(F.col("attrs")["title"]).contains("sito web") | low(F.col("text")).contains("sito web")
    fit = _is("a") & said & href.rlike(r"^https?://[^/\s?#]") & ~is_directory_host(href)
    order = F.struct((mark != SITE_MARK).alias("other"), F.col("place").alias("place"))
    address = F.regexp_replace(F.col("text"), r"\s+", " ")
    shown = seen.groupBy("page_id").agg(
        F.min_by(F.when(fit, href), F.when(fit, order)).alias("site"),
        _first(F.col("text"), "place", _is("h1")).alias("h1"),
        _first(F.trim(address), "place", _classed(*ADDRESS_CLASSES)).alias("address"),
    )
    value = F.trim("value")
    code = F.regexp_extract(F.regexp_replace(F.regexp_replace("value", r"^(?i)IT", ""), r"\s+", ""), r"\b([0-9]{11})\b", 1)
    key = F.col("key")
    said_ = linked_data(whole).groupBy("page_id").agg(
        _first(code, "place", key.isin("vatid", "taxid") & (code != "")).alias("vat"),
        *[_first(v, "place", (key == k) & (value != "")).alias(n) for n, k, v in (("phone", "telephone", value), ("email", "email", F.lower(value)), ("name", "name", value))],
    )
    html = F.col("html")
    joined = whole.select(
        "page_id",
        filled(F.regexp_extract(html, r'(?i)"vatID"\s*:\s*"(?:IT)?([0-9]{11})"', 1)).alias("p_vat"),
        filled(F.regexp_extract(html, r'(?i)"email"\s*:\s*"([^"]+)"', 1)).alias("p_email"),
        filled(F.regexp_extract(html, r'(?i)"telephone"\s*:\s*"([^"]+)"', 1)).alias("p_phone"),
    ).join(shown, "page_id", "left").join(said_, "page_id", "left")
    out = joined.select(
        "page_id", F.col("site").alias("official_website"), F.coalesce("vat", "p_vat").alias("vat_code"), F.coalesce("phone", F.trim("p_phone")).alias("phone"),
        F.coalesce("email", F.lower(F.trim("p_email"))).alias("email"), F.coalesce("name", filled(F.col("h1"))).alias("name"), F.when(F.length("address") >= 8, F.col("address")).alias("address"),
    )
    return out.filter("coalesce(official_website, vat_code, phone, email, name, address) is not null")


# --- search results ---------------------------------------------------------------------------------------------

#: Signs of a page that was served instead of results, by layout.
BLOCKED = {
    "boxes": ["verify you are a human", "unusual traffic", "captcha-container", "please verify"],
    "rows": ["bots use duckduckgo too", "anomaly", "unusual traffic", "verify you are not a robot"],
}
_RESULT = ["page_id", "rank", "title", "url", "snippet"]


def is_blocked(html: Column, layout: str) -> Column:
    low = F.lower(F.coalesce(html, F.lit("")))
    return F.array_contains(F.transform(F.array(*map(F.lit, BLOCKED[layout])), lambda s: F.contains(low, s)), True)


def _query_value(url: Column, name: str) -> Column:
    return filled(F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*&)?{name}=([^&#]*)", 1))


def unwrap_boxes(href: Column) -> Column:
    """The target of a tracking link (path /ck/a, a1 and base64 in its parameter u), any other link as it is."""
    code = F.url_decode(_query_value(href, "u"))
    body = F.translate(F.substring(code, 3, 100_000), "-_\t\r\n", "+/")  # addresses lose tabs and line breaks
    padded = F.rpad(body, F.length(body) + F.pmod(-F.length(body), F.lit(4)), "=")
    target = F.call_function("try_to_binary", padded, F.lit("base64"))
    text = F.decode(target, "UTF-8")
    own = href.rlike(r"^(?i)(?:(?:https?:)?//(?:[^/?#@]*\.)?bing\.com)?/ck/a\?") & code.startswith("a1")
    return F.when(own & text.rlike("^(?i)https?://"), text).otherwise(href)


def unwrap_rows(href: Column) -> Column:
    """The target of a redirect (path /l/, parameter uddg), else the link with its scheme and host."""
    full = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(F.lit("https://duckduckgo.com"), href)).otherwise(href)
    target = F.try_url_decode(_query_value(full, "uddg"))
    path = F.regexp_extract(full, r"^(?i)https?://[^/?#]*([^?#]*)", 1)
    return F.when((path == "/l/") & target.isNotNull(), target).otherwise(full)


def results_in_boxes(pages: DataFrame, limit: int = 25, closed: bool = False) -> DataFrame:
    """(page_id, rank, title, url, snippet) of result boxes (li.b_algo); the rank counts boxes, also those without a title or link."""
    found = elements(pages.filter(~is_blocked(F.col("html"), "boxes")), ["a", "p", ".b_algo", ".b_snippet", ".b_lineclamp4"], closed=closed)
    box = F.filter("up", lambda u: (u["tag"] == "li") & F.array_contains(u["classes"], "b_algo"))
    inside = lambda test: F.exists("up", test)
    own = _is("li") & _classed("b_algo")
    placed = found.withColumn("box", F.when(own, F.col("place")).otherwise(F.get(box, F.lit(0))["place"])).filter("box is not null")
    link = _is("a") & inside(lambda u: u["tag"] == "h2")
    says = lambda where: filled(_first(F.col("text"), "place", where))
    boxes = placed.groupBy("page_id", "box").agg(
        _first(F.col("attrs")["href"], "place", link).alias("href"), says(link).alias("title"),
        F.coalesce(says(_is("p") & inside(lambda u: F.array_contains(u["classes"], "b_caption"))), says(_classed("b_snippet")), says(_classed("b_lineclamp4")), F.lit("")).alias("snippet"),
    )
    return _ranked(boxes, "box", has(F.col("href")) & F.col("title").isNotNull(), unwrap_boxes(F.col("href")), limit)


def results_in_rows(pages: DataFrame, limit: int = 25, closed: bool = False) -> DataFrame:
    """(page_id, rank, title, url, snippet) of result links (a.result-link) with the snippet of the next table row; pages without any give their plain links. The engine's own links are left out, after ranks are given."""
    found = elements(pages.filter(~is_blocked(F.col("html"), "rows")), ["a", ".result-snippet"], closed=closed)
    row = F.get(F.filter("up", lambda u: u["tag"] == "tr"), F.lit(0))
    found = found.withColumns({"table": row["parent"], "row": row["nth"]})
    href = F.col("attrs")["href"]
    links = found.filter(_is("a")).select("page_id", "place", _classed("result-link").alias("marked"), href.alias("href"), "text", "table", (F.col("row") + 1).alias("row"))
    snippets = found.filter(_classed("result-snippet")).groupBy("page_id", "table", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), "").alias("snippet"))
    both = links.join(snippets, ["page_id", "table", "row"], "left").withColumns({"title": filled(F.col("text")), "snippet": F.coalesce("snippet", F.lit("")), "url": unwrap_rows(F.col("href"))})
    organic = has(F.col("href")) & F.col("title").isNotNull() & ~F.coalesce(F.col("url").rlike(r"^(?i)https?://(?:[^/?#@]*\.)?duckduckgo\.com(?:[/?#:]|$)"), F.lit(False))
    marked = both.filter("marked")
    first = _ranked(marked, "place", organic, F.col("url"), limit)
    plain = both.withColumn("snippet", F.lit("")).join(first.select("page_id").distinct(), "page_id", "left_anti")
    web = F.col("href").rlike("^(?i)https?://") | F.col("href").startswith("//duckduckgo.com/l/")
    return first.unionByName(_ranked(plain, "place", organic & web & F.col("url").rlike("^(?i)https?://"), F.col("url"), limit))


def _ranked(rows: DataFrame, order: str, good: Column, url: Column, limit: int) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("page_id").orderBy(order)
    ranked = rows.withColumn("rank", F.row_number().over(by)).filter(good).withColumn("kept", F.row_number().over(by))
    return ranked.filter(F.col("kept") <= limit).withColumn("url", url).select(*_RESULT)


# --- financial pages --------------------------------------------------------------------------------------------

_ARRAY = r"var\s+{0}\s*=\s*\[([^\]]+)\]"


def financials(pages: DataFrame) -> DataFrame:
    """(page_id, company_name, vat_code, revenue_amount, revenue_year, profit, employees, years, confidence), one row a page.

    years are (year, revenue, profit) of the chart's arrays as published. The headline is the latest year with a
    positive revenue, whatever the order; else the latest labelled one; of labels without a year the last.
    Confidence: 0.9 for a chart, 0.75 for a label, 0.4 for a name or code only, 0 for nothing.
    """
    grid = elements(pages, ["th", "td", "h1", ".col-xs-5", ".col-sm-5", ".col-xs-7", ".col-sm-7", "body"], up=False).drop("up")
    grid = materialize(grid, "financial-elements")  # pages are scanned once
    label = (_is("th") & (F.col("attrs")["scope"] == "row")).alias("l")
    old = _classed("col-xs-5", "col-sm-5")
    key = F.lower(F.trim("text"))
    labels = grid.filter(label | old).select("page_id", "parent", (F.col("nth") + 1).alias("nth"), "place", key.alias("label"), _is("th").alias("head"))
    values = grid.filter(_is("td") | _classed("col-xs-7", "col-sm-7")).select("page_id", "parent", "nth", F.trim("text").alias("value"), _is("td").alias("cell"))
    met = labels.join(values, ["page_id", "parent", "nth"]).filter("label <> '' and value <> '' and head = cell")
    # A label's last value counts, that of a table before that of the grid; its place is its first.
    one = met.groupBy("page_id", "label").agg(F.max_by("value", F.struct("head", "place")).alias("value"), F.min(F.struct((~F.col("head")).cast("int").alias("t"), "place")).alias("place"))
    year = F.regexp_extract("label", r"\b(20[0-9]{2})\b", 1).try_cast("int")
    amount = numbers.parse_revenue(F.col("value"))
    first = F.col("place.place")
    best = F.struct(year.isNotNull().alias("dated"), F.coalesce(year, F.lit(0)).alias("y"), F.when(year.isNotNull(), -first).otherwise(first).alias("p"))
    pick = lambda what, word: F.max_by(F.when(F.col("label").contains(word) & amount.isNotNull(), what), F.when(F.col("label").contains(word) & amount.isNotNull(), best))
    at = lambda *names: F.coalesce(*[F.max(F.when(F.col("label") == n, F.col("value"))) for n in names])
    told = one.groupBy("page_id").agg(
        pick(amount, "fatturato").alias("g_revenue"), pick(year, "fatturato").alias("g_year"), pick(amount, "utile").alias("g_profit"),
        at("n. dipendenti", "dipendenti", "numero dipendenti").alias("staff"), at("ragione sociale").alias("legal"), at("partita iva", "p.iva").alias("code"),
    )
    heads = grid.groupBy("page_id").agg(_first(F.col("text"), "place", _is("h1")).alias("h1"), F.max(F.when(_is("body"), F.col("text"))).alias("body"))
    html = F.col("html")
    part = lambda name: F.split(filled(F.regexp_extract(html, _ARRAY.format(name), 1)), ",")
    number = lambda s: F.regexp_extract(s, r"^\s*(-?[0-9]+)", 1).try_cast("bigint")
    chart = pages.select(
        "page_id", F.regexp_extract_all(F.regexp_extract(html, _ARRAY.format("labelChart"), 1), F.lit("([0-9]{4})"), F.lit(1)).alias("l"), part("datiChartFatturato").alias("r"), part("datiChartUtile").alias("p")
    )
    years = F.transform("l", lambda y, k: F.struct(
        y.cast("int").alias("year"), F.when(number(F.get("r", k)) > 0, number(F.get("r", k))).alias("revenue"), F.when(number(F.get("p", k)) != 0, number(F.get("p", k))).alias("profit")
    ))
    full = chart.withColumn("years", F.when(F.col("r").isNotNull(), years).otherwise(F.array().cast("array<struct<year:int,revenue:bigint,profit:bigint>>"))).join(told, "page_id", "left").join(heads, "page_id", "left")
    latest = F.array_max(F.transform(F.filter("years", lambda y: y["revenue"].isNotNull()), lambda y: F.struct(y["year"], y["revenue"], y["profit"])))
    full = full.withColumn("top", latest).withColumn("vat", F.regexp_replace("code", "[^0-9]", ""))
    revenue = F.coalesce("top.revenue", "g_revenue")
    vat = F.when(F.length("vat") == 11, F.col("vat")).otherwise(F.get(vat_codes(F.coalesce("body", F.lit(""))), F.lit(0)))
    name = F.coalesce("legal", filled(F.trim("h1")))
    return full.select(
        "page_id", name.alias("company_name"), vat.alias("vat_code"), revenue.alias("revenue_amount"), F.when(F.col("top").isNotNull(), F.col("top.year")).otherwise(F.when(F.col("g_revenue").isNotNull(), F.col("g_year"))).alias("revenue_year"),
        F.coalesce("top.profit", "g_profit").alias("profit"), staff_band(F.col("staff")).alias("employees"), "years",
        F.when(F.col("top").isNotNull(), 0.9).when(revenue.isNotNull(), 0.75).when(vat.isNotNull() | name.isNotNull(), 0.4).otherwise(0.0).alias("confidence"),
    )


def staff_band(text: Column) -> Column:
    """'10-15', '1000+', '<5' or '8200' of a worded band; null for what is none."""
    low = F.lower(F.trim(text))
    both, over, below, one = r"(?:da\s+)?([0-9]+)\s*(?:\s+a\s+|[-–])\s*([0-9]+)", r"(?:oltre|più di|piu di|>)\s*([0-9]+)", r"(?:fino a|meno di|<)\s*([0-9]+)", F.regexp_replace(low, r"\.", "")
    return (
        F.when(low.rlike(r"da\s+[0-9]+\s+a\s+[0-9]+|[0-9]+\s*[-–]\s*[0-9]+"), F.concat(F.regexp_extract(low, both, 1), F.lit("-"), F.regexp_extract(low, both, 2)))
        .when(low.rlike(over), F.concat(F.regexp_extract(low, over, 1), F.lit("+")))
        .when(low.rlike(below), F.concat(F.lit("<"), F.regexp_extract(low, below, 1)))
        .when(one.rlike("^[0-9]+$"), one)
    )


# --- map feeds --------------------------------------------------------------------------------------------------

#: What tells the unlabelled lines of a card apart.
CLOSED = r"^(?i)(?:chiuso definitivamente|permanently closed)"
STREET = r"^(?i)(?:(?:via|viale|piazza|corso|largo|vicolo|strada(?:\s+provinciale|\s+statale)?|localit\u00e0|borgo|contrada|frazione|piazzale)\b|(?:v\.le|loc\.|c\.so|p\.za|pza)(?=\s|,|$))"
PHONE = r"^(?:\+39\s?)?(?:0[0-9]{1,4}|3[0-9]{2})[\s./-]?[0-9][0-9\s./-]{4,12}$"
STATUS = r"^(?i)(?:aperto|chiuso|chiude|apre)"
#: A feed of so many cards was probably cut by the map.
FEED_CAP = 110


def map_cards(pages: DataFrame) -> DataFrame:
    """(page_id, place, name, maps_url, website, category, address, zip, city, province, phone, closed, total, dropped, cap_likely).

    Cards are div.Nv2PK after the page's first element with role feed; pages of fewer than 100 characters or without a
    feed have none. Lines are the spans under .W4Efsd: a sign of closing, else the first street, else the first phone;
    of the rest the first of 4 to 60 characters without digits that is no opening hours is the category. Cards without
    a name are dropped and counted.
    """
    found = elements(pages.filter(F.length("html") >= 100), ["a", "span", "div", ".qBF1Pd"])
    role = F.col("attrs")["role"]
    feeds = found.filter(_is("div") & (role == "feed")).groupBy("page_id").agg(F.min("place").alias("feed"))
    own = _is("div") & _classed("Nv2PK")
    card = F.when(own, F.col("place")).otherwise(F.get(F.filter("up", lambda u: F.array_contains(u["classes"], "Nv2PK")), F.lit(0))["place"])
    inner = found.withColumn("card", card).filter("card is not null").join(feeds, "page_id").filter("card > feed")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    line = F.trim(F.regexp_replace(text, r"^[\s·⋅•]+", ""))
    href, said = F.col("attrs")["href"], F.lower(F.coalesce(F.col("attrs")["aria-label"], F.lit("")))
    web = _is("a") & href.startswith("http")
    lines = F.transform(F.sort_array(F.collect_list(F.when(_is("span") & F.exists("up", lambda u: F.array_contains(u["classes"], "W4Efsd")) & (line != ""), F.struct("place", line.alias("line"))))), lambda x: x["line"])
    cards = inner.groupBy("page_id", "card").agg(
        F.coalesce(filled(_first(text, "place", _classed("qBF1Pd") | (_is("div") & _classed("fontHeadlineSmall")))), filled(_first(F.trim(F.col("attrs")["aria-label"]), "place", _is("a") & F.col("attrs")["aria-label"].isNotNull()))).alias("name"),
        _first(href, "place", _is("a") & href.contains("/maps/place/")).alias("link"),
        F.coalesce(_first(href, "place", web & (F.col("attrs")["data-value"] == "Sito web")), _first(href, "place", web & said.contains("sito web")), _first(href, "place", web & said.contains("website"))).alias("website"),
        lines.alias("lines"),
    )
    open_ = F.filter("lines", lambda x: ~x.rlike(CLOSED))
    one = lambda test: F.get(F.filter("open", test), F.lit(0))
    told = cards.withColumns({"closed": F.exists("lines", lambda x: x.rlike(CLOSED)), "open": open_})
    told = told.withColumn("address", one(lambda x: x.rlike(STREET)))
    told = told.withColumn("phone", one(lambda x: x.rlike(PHONE) & ~F.coalesce(x == F.col("address"), F.lit(False))))
    told = told.withColumn("category", one(lambda x: F.length(x).between(4, 60) & ~x.rlike("[0-9]") & ~x.rlike(STATUS) & ~F.coalesce(x == F.col("address"), F.lit(False))))
    # A street's number may have five digits too: the code is the last such number before a town and its province.
    code = F.coalesce(filled(F.regexp_extract("address", r"^.*\b([0-9]{5})\s+[^()]+?(?:\s+[A-Z]{2}\b|\s*\([A-Z]{2}\))", 1)), filled(F.regexp_extract("address", r"\b([0-9]{5})\b", 1)))
    town = lambda g: filled(F.coalesce(filled(F.regexp_extract("address", r"[0-9]{5}\s+([^()]+?)\s+([A-Z]{2})\b", g)), F.regexp_extract("address", r"[0-9]{5}\s+([^()]+?)\s*\(([A-Z]{2})\)", g)))
    totals = told.groupBy("page_id").agg(F.count("*").alias("total"), F.count_if(F.col("name").isNull()).alias("dropped"))
    from pyspark.sql import Window

    return told.filter("name is not null").join(totals, "page_id").select(
        "page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("card")).alias("place"), "name",
        F.when(F.col("link").startswith("http"), F.col("link")).otherwise(F.concat(F.lit("https://www.google.com"), "link")).alias("maps_url"),
        "website", "category", "address", code.alias("zip"), town(1).alias("city"), town(2).alias("province"), "phone", "closed", "total", "dropped", (F.col("total") >= FEED_CAP).alias("cap_likely"),
    )

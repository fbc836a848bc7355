"""Saved web pages: links, titles, visible text, contact facts, listing cards."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.contact import canonical_url, emails, host, is_directory_host, is_pec, social_network, vat_codes
from leadloom.functions.text import plain_email_signs

TINY = 800
PARKED = ["domain for sale", "dominio in vendita", "parked", "under construction", "sito in costruzione"]


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, place, href) of every link."""
    return pages.select("page_id", F.posexplode(hrefs(F.col("html"))).alias("place", "href"))


def page_flags(pages: DataFrame) -> DataFrame:
    """(page_id, host, key, tiny, parked, directory): what a page is fit for."""
    text = visible_text(F.col("html"))
    low = F.lower(F.concat_ws(" ", title(F.col("html")), text))
    return pages.select(
        "page_id",
        host(F.col("url")).alias("host"),
        canonical_url(F.col("url")).alias("key"),
        (F.length(text) < TINY).alias("tiny"),
        low.rlike("|".join(PARKED)).alias("parked"),
        is_directory_host(F.col("url")).alias("directory"),
    )


def contacts(pages: DataFrame) -> DataFrame:
    """(page_id, emails, pec, vat_codes, socials): contact facts of a page's text and links."""
    text = plain_email_signs(visible_text(F.col("html")))
    mails = F.array_distinct(F.concat(F.transform(F.filter(hrefs(F.col("html")), lambda h: F.lower(h).startswith("mailto:")), lambda h: F.lower(F.regexp_replace(F.substring(h, F.lit(8), F.length(h)), r"\?.*$", ""))), emails(text)))
    out = pages.select("page_id", mails.alias("emails"), vat_codes(text).alias("vat_codes"), F.filter(hrefs(F.col("html")), lambda h: social_network(h).isNotNull()).alias("socials"))
    return out.withColumn("pec", F.filter("emails", is_pec))


def deduplicate_results(results: DataFrame, top: int = 20) -> DataFrame:
    """(query, host, url, score, place): search results by host; the shortest address stands for its host."""
    h = host(F.col("url"))
    by_host = results.withColumn("host", h).filter("host is not null").groupBy("query", "host").agg(
        F.min_by("url", F.struct(F.length("url"), "url")).alias("url"), F.count_distinct("provider").alias("providers"), F.min("batch").alias("batch"), F.min("rank").alias("rank")
    )
    flag = lambda c, w: F.when(c, w).otherwise(0.0)
    apex = F.size(F.split("host", r"\.")) == 2
    score = 0.4 + flag(F.col("host").endswith(".it"), 0.15) + flag(apex, 0.1) + flag(F.col("url").rlike("contatt|contact"), 0.05) + flag(F.col("providers") >= 2, 0.15) + flag(F.col("providers") >= 3, 0.05) + flag(F.col("batch") == 0, 0.05)
    registry = is_directory_host(F.col("url"))
    rows = by_host.withColumn("score", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score - flag(registry, 0.2))) * 1000 + 0.5) / 1000).withColumn("registry", registry)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query").orderBy("registry", F.desc("score"), "rank", "host"))
    return rows.withColumn("place", place).filter(F.col("place") <= top).select("query", "host", "url", "score", "place")


class _Cards(HTMLParser):
    """Elements marked data-card; inside them, text of elements marked data-field."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict[str, str]] = []
        self.field: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        if "data-card" in named:
            self.rows.append({"url": ""})
        elif self.rows and "data-field" in named:
            self.field = named["data-field"]
        if self.rows and tag == "a" and named.get("href") and not self.rows[-1]["url"]:
            self.rows[-1]["url"] = named["href"] or ""

    def handle_data(self, data: str) -> None:
        if self.field and self.rows:
            self.rows[-1][self.field] = (self.rows[-1].get(self.field, "") + data).strip()

    def handle_endtag(self, tag: str) -> None:
        self.field = None


def cards(pages: DataFrame) -> DataFrame:
    """(page_id, place, name, address, phone, url) of listing cards; address parts are taken apart with native expressions."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                parser = _Cards()
                parser.feed(html or "")
                rows += [(page_id, k, r.get("name"), r.get("address"), r.get("phone"), r["url"]) for k, r in enumerate(parser.rows) if r.get("name")]
            yield pd.DataFrame(rows, columns=["page_id", "place", "name", "address", "phone", "url"])

    found = pages.select("page_id", "html").mapInPandas(parse, "page_id bigint, place bigint, name string, address string, phone string, url string")
    return found.withColumn("zip", F.regexp_extract("address", r"\b([0-9]{5})\b", 1)).withColumn("province", F.regexp_extract("address", r"\(([A-Z]{2})\)", 1))

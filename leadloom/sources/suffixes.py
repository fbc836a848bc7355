"""Registrable domains by the public suffix list, with its wildcards, exceptions and private section.

The list is a parameter (the text format of publicsuffix.org); without one, the copy is read that comes with Spark's
own libraries. Domains are found for distinct hosts: a host is exploded into its endings, the endings meet the rules
(about ten thousand rows, which Spark broadcasts by their size), and the longest rule wins by an aggregate.
"""

from __future__ import annotations

import functools
import os
import zipfile
from pathlib import Path

import pandas as pd
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.text import filled

#: Name of the list inside Spark's HTTP client library.
_MEMBER = "mozilla/public-suffix-list.txt"


def _ascii(host: str) -> str:
    return ".".join(p if p.isascii() else p.encode("idna").decode() for p in host.split("."))


def parse_rules(text: str) -> list[tuple[str, str, int, bool]]:
    """(ending, kind, labels of the suffix, private) of each rule of a list."""
    out, private = [], False
    for line in text.splitlines():
        if "===BEGIN PRIVATE DOMAINS===" in line:
            private = True
        rule = line.split()[0].lower() if line.strip() and not line.startswith("//") else ""
        if rule:
            kind = "exception" if rule[0] == "!" else "wildcard" if rule.startswith("*.") else "plain"
            ending = _ascii(rule.removeprefix("!").removeprefix("*."))
            out.append((ending, kind, ending.count(".") + {"exception": 0, "plain": 1, "wildcard": 2}[kind], private))
    return out


@functools.cache
def bundled_list() -> str:
    for home in (os.environ.get("SPARK_HOME"), str(Path(pyspark.__file__).parent)):
        for jar in sorted(Path(home, "jars").glob("httpclient-*.jar")) if home else []:
            with zipfile.ZipFile(jar) as z:
                if _MEMBER in z.namelist():
                    return z.read(_MEMBER).decode()
    raise FileNotFoundError("no public suffix list among Spark's libraries; pass the path of one")


def suffix_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(ending, kind, size, private) of the list at a path that Spark reads, or of the bundled one."""
    text = spark.read.text(path, wholetext=True).first()[0] if path else bundled_list()
    return spark.createDataFrame(pd.DataFrame(parse_rules(text), columns=["ending", "kind", "size", "private"]), "ending string, kind string, size int, private boolean")


def _to_ascii(host: Column) -> Column:
    def convert(hosts: pd.Series) -> pd.Series:
        def one(name: str | None) -> str | None:
            try:
                return _ascii(name) if name else None
            except UnicodeError:
                return None

        return hosts.map(one)

    return F.pandas_udf(convert, "string")(host)


def url_host(url: Column) -> Column:
    """Lower-case host of an address or bare host, without user, port and closing dot; null where there is none."""
    cut = F.trim(url)
    rest = F.when(cut.rlike(r"^(?i)[a-z][a-z0-9+.-]*://"), F.regexp_replace(cut, r"^(?i)[a-z][a-z0-9+.-]*://", "")).otherwise(F.regexp_replace(cut, "^/+", ""))
    name = F.lower(F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(?:[/?#]|$)", 1))
    return filled(F.regexp_replace(F.when(~name.rlike(r"[\s\[\]<>^|%\\]"), name), r"\.$", ""))


def host_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts (host, distinct) with registrable, subdomain and registry.

    registrable is the label under the longest suffix, private suffixes included; null for addresses in numbers, single
    labels and bare suffixes. registry is the same, but null under a private suffix, whose record is the platform's.
    subdomain is what stands in front, without a leading www; empty where there is nothing.
    """
    named = hosts.withColumn("name", F.when(F.col("host").rlike("[^\\x00-\\x7F]"), _to_ascii(F.col("host"))).otherwise(F.col("host")))
    named = named.withColumn("labels", F.split("name", r"\."))
    endings = F.transform("labels", lambda _, k: F.array_join(F.slice("labels", k + 1, F.size("labels")), "."))
    usable = ~F.col("name").rlike(r"^[0-9.]+$") & ~F.col("name").rlike(r"^\.|\.\.|\.$")
    met = named.filter(usable).select("host", F.size("labels").alias("n"), F.explode(endings).alias("ending")).join(rules, "ending").filter(F.col("size") <= F.col("n"))
    best = met.groupBy("host").agg(F.max(F.struct((F.col("kind") == "exception").alias("exception"), "size", "private")).alias("best"))
    size, labels = F.coalesce("best.size", F.lit(1)), F.col("labels")
    joined = named.join(best, "host", "left")
    found = F.when(usable & (F.size(labels) > size), F.array_join(F.slice(labels, F.size(labels) - size, size + 1), "."))
    front = F.when(usable & (F.size(labels) > size + 1), F.array_join(F.slice(labels, F.lit(1), F.size(labels) - size - 1), "."))
    out = joined.select("host", found.alias("registrable"), F.regexp_replace(F.coalesce(front, F.lit("")), r"^www(\.|$)", "").alias("subdomain"), F.coalesce("best.private", F.lit(False)).alias("private"))
    return out.select("host", "registrable", "subdomain", F.when(~F.col("private"), F.col("registrable")).alias("registry"))


def with_domains(df: DataFrame, url_col: str, rules: DataFrame, prefix: str = "") -> DataFrame:
    """df and host, registrable, subdomain and registry of an address column, each name after the prefix; rows stay one for one."""
    named = df.withColumn("_host", url_host(F.col(f"`{url_col}`")))
    known = host_domains(named.select(F.col("_host").alias("host")).filter("host is not null").distinct(), rules)
    known = known.select(F.col("host").alias("_host"), *[F.col(c).alias(f"{prefix}{c}") for c in ("registrable", "subdomain", "registry")])
    return named.join(known, "_host", "left").withColumn(f"{prefix}host", F.col("_host")).na.fill("", [f"{prefix}subdomain"]).drop("_host")

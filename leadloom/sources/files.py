"""CSV and JSON-lines files of leads: tolerant readers, fixed-order writers, an output check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StructType

from leadloom.functions.text import has, has_mojibake

#: Accepted header names of each lead field.
ALIASES = {
    "company_name": ["company_name", "name", "ragione_sociale"], "category": ["category", "categoria"], "city": ["city", "comune"], "province": ["province", "provincia", "prov"],
    "region": ["region", "regione"], "address": ["address", "indirizzo"], "phone": ["phone", "telefono"], "email": ["email", "mail"], "website": ["website", "sito", "url"],
    "vat_code": ["vat_code", "piva", "partita_iva"], "source": ["source"], "source_url": ["source_url"],
}
RAW_COLUMNS = list(ALIASES)


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Leads of CSV files by header; aliases become fields, other columns stay in extra, rows without a name are kept with an error."""
    raw = spark.read.csv(path, header=True, multiLine=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, escape='"')
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    own = {c.lower(): c for c in raw.columns}
    used: set[str] = set()
    fields = []
    for field, names in ALIASES.items():
        here = [own[n] for n in names if n in own]
        used.update(here)
        fields.append(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in here], F.lit(None).cast("string")).alias(field))
    rest = [c for c in raw.columns if c not in used]
    extra = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*[F.col(f"`{c}`") for c in rest])) if rest else F.expr("cast(map() as map<string,string>)")
    out = raw.select(*fields, extra.alias("extra"), F.col("_metadata.file_path").alias("origin"))
    return out.withColumn("ingest_error", F.when(~has(F.col("company_name")), "missing company_name"))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    """Objects of JSON lines; malformed lines are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_leads(spark: SparkSession, csv: list[str], jsonl: list[str], schema: str) -> DataFrame:
    """The union of both kinds of files, missing columns as null."""
    parts = ([read_csv(spark, csv)] if csv else []) + ([read_jsonl(spark, jsonl, schema)] if jsonl else [])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order as CSV text: missing ones empty, lists joined by |, objects as JSON, booleans as true or false."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def text(name: str):
        if name not in kinds:
            return F.lit(None).cast("string").alias(name)
        kind = kinds[name]
        if isinstance(kind, ArrayType) and not isinstance(kind.elementType, (StructType, ArrayType, MapType)):
            return F.array_join(name, "+" if name == "sources" else "|").alias(name)
        if isinstance(kind, (ArrayType, StructType, MapType)):
            return F.to_json(name).alias(name)
        return (F.when(F.col(name), "true").otherwise("false") if isinstance(kind, BooleanType) else F.col(name).cast("string")).alias(name)

    return df.select(*map(text, columns))


def write_leads(df: DataFrame, folder: str, columns: list[str]) -> None:
    """The same rows as CSV (fixed columns) and as JSON lines (all fields)."""
    flat(df, columns).write.mode("overwrite").csv(f"{folder}/csv", header=True, escape='"')
    df.write.mode("overwrite").json(f"{folder}/jsonl", ignoreNullFields=True)


def check_output(rows: DataFrame) -> DataFrame:
    """(rule, n): how many rows break each rule of a finished output."""
    rules = {
        "missing_name": ~has(F.col("company_name")),
        "mojibake": has_mojibake(F.col("company_name")),
        "bad_website": has(F.col("website")) & ~F.coalesce(F.col("website").rlike(r"^https?://[^\s/]+\.[^\s]+$"), F.lit(False)),
        "unknown_source": ~F.coalesce(F.col("source").isin("directory", "maps", "file"), F.lit(False)),
    }
    one = rows.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("x")).select("x.*")

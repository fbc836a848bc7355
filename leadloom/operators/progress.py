"""Keyed progress logs: what is done, what is left, resuming without losing rows, and the manifest of a run.

A log holds entries (key, kind, status, parsed, empty_verified, attempts, reason, ts); the latest of a key counts. Work
is done only where its outcome is proved: it gave rows, or its emptiness was verified.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import filled

#: Classes of failures by what their reason says, the first that fits.
ERRORS = [
    ("network_exhausted", r"net::err_|err_network|err_name_not_resolved|err_connection|err_timed_out|err_internet_disconnected|timeout.*exceeded|navigation timeout|econnreset|etimedout|eai_again|socket hang up"),
    ("consent_wall", r"consent|cookie"),
    ("blocked_or_captcha", r"captcha|unusual traffic|access denied|forbidden|blocked|cloudflare"),
    ("maps_no_feed", r"no_feed|no result feed"),
    ("selector_drift", r"selector|markup|matched 0 elements|unverified_empty|dropped_all_cards|feed_missing_after_scroll"),
    ("checkpoint_integrity", r"checkpoint|missingpriorjsonl|prior jsonl|navigation_in_progress"),
]
_KEY = r"^(pg|maps):([^:]+):([^:]+)(?::p([1-9][0-9]*))?$"


class MissingPriorRows(RuntimeError):
    """Work is marked done, but the rows it gave are gone."""


class IncompleteManifest(RuntimeError):
    """A run has entries that no manifest can stand for."""


def error_class(reason: Column) -> Column:
    low = F.lower(F.coalesce(reason, F.lit("")))
    out = F.lit("unknown")
    for name, words in reversed(ERRORS):
        out = F.when(low.rlike(words), name).otherwise(out)
    return out


def key_parts(key: Column) -> tuple[Column, Column, Column, Column]:
    """Provider, category, location and page of a key; all null for text that is no key. %25 and %3A stand for % and a colon."""
    part = lambda k: F.when(key.rlike(_KEY), filled(F.regexp_extract(key, _KEY, k)))
    plain = lambda c: F.replace(F.regexp_replace(F.replace(c, F.lit("%25"), F.lit("\u0001")), "(?i)%3A", ":"), F.lit("\u0001"), F.lit("%"))
    return part(1), plain(part(2)), plain(part(3)), part(4).cast("int")


def verified(status: Column, parsed: Column, empty_verified: Column) -> Column:
    """Whether an entry proves its outcome."""
    return F.coalesce((status == "done") & (F.coalesce(empty_verified, F.lit(False)) | (F.coalesce(parsed, F.lit(0)) > 0)), F.lit(False))


def latest(log: DataFrame, *by: str) -> DataFrame:
    """The last entry of each key (within by), by time and, at the same time, by all its columns."""
    keys = [*by, "key"]
    return log.groupBy(*keys).agg(F.max(F.struct("ts", *[c for c in log.columns if c not in (*keys, "ts")])).alias("e")).select(*keys, "e.*")


def query_states(log: DataFrame, *by: str) -> DataFrame:
    """(by, key, provider, category, location, page, status, attempts, error_class, reason) of each query of a log.

    status is success, empty_verified or failed; what is pending, skipped or done without proof has failed. Successful
    preflight probes are left out; a key that can't be read has no provider.
    """
    last = latest(log, *by).filter(~F.coalesce((F.col("kind") == "preflight") & (F.col("status") == "done"), F.lit(False)))
    open_ = F.col("status").isin("pending", "skipped")
    proof = verified(F.col("status"), F.col("parsed"), F.col("empty_verified"))
    bare = (F.col("status") == "done") & ~proof
    failed = (F.col("status") == "failed") | open_ | bare
    reason = F.when(open_, F.coalesce("reason", F.concat(F.lit("checkpoint_"), "status", F.lit("_without_terminal_result")))).when(bare, F.coalesce("reason", F.lit("unverified_empty_result"))).otherwise(F.col("reason"))
    provider, category, location, page = key_parts(F.col("key"))
    out = last.select(*by, "key", provider.alias("provider"), category.alias("category"), location.alias("location"), page.alias("page"), failed.alias("failed"), open_.alias("open"), "empty_verified", "attempts", reason.alias("reason"))
    return out.select(
        *by, "key", "provider", "category", "location", "page", F.when(F.col("failed"), "failed").when(F.col("empty_verified"), "empty_verified").otherwise("success").alias("status"),
        F.coalesce("attempts", F.when(F.col("open"), 0).otherwise(1)).cast("bigint").alias("attempts"), F.when(F.col("failed"), error_class(F.col("reason"))).alias("error_class"), "reason",
    )


def manifests(log: DataFrame, run: str = "run_id", interrupted: Column | None = None) -> DataFrame:
    """(run, status, queries, failed, empty_verified, error_classes, incident_id, unreadable): one row a run.

    A run is complete if no query failed and it wasn't interrupted; a run of no queries is partial. incident_id is the digest
    of the failed keys with their classes, in order of the keys. Counts are aggregates; only the failures of one run,
    as short texts, meet in a row.
    """
    states = query_states(log, run)
    bad = F.col("status") == "failed"
    named = F.sort_array(F.collect_list(F.when(bad, F.concat_ws(":", "key", "error_class"))))
    out = states.groupBy(run).agg(
        F.count("*").alias("queries"), F.count_if(bad).alias("failed"), F.count_if(F.col("status") == "empty_verified").alias("empty_verified"), F.count_if(F.col("provider").isNull()).alias("unreadable"),
        F.array_join(F.sort_array(F.collect_set("error_class")), ",").alias("error_classes"), F.array_join(named, "|").alias("failures"),
    )
    every = log.select(run).distinct().join(out, run, "left").na.fill(0, ["queries", "failed", "empty_verified", "unreadable"])
    stopped = F.coalesce(interrupted, F.lit(False)) if interrupted is not None else F.lit(False)
    complete = (F.col("failed") == 0) & (F.col("queries") > 0) & ~stopped
    return every.select(
        run, F.when(complete, "complete").otherwise("partial").alias("status"), "queries", "failed", "empty_verified", "unreadable", F.coalesce("error_classes", F.lit("")).alias("error_classes"),
        F.when((F.col("failed") > 0) & ~stopped, F.substring(F.sha2("failures", 256), 1, 24)).alias("incident_id"),
    )


def check_manifest(manifest: DataFrame) -> None:
    """Raises for keys that can't be read, as no manifest may leave a query out."""
    broken = manifest.filter("unreadable > 0").limit(1).collect()
    if broken:
        raise IncompleteManifest(f"run {broken[0][0]!r} has {broken[0]['unreadable']} keys that can't be read")


def done_keys(log: DataFrame) -> DataFrame:
    """(key, parsed) of work whose outcome is proved."""
    return latest(log).filter(verified(F.col("status"), F.col("parsed"), F.col("empty_verified"))).select("key", F.coalesce("parsed", F.lit(0)).alias("parsed"))


def remaining(work: DataFrame, log: DataFrame) -> DataFrame:
    """Work (key, ...) that isn't done yet."""
    return work.join(done_keys(log).select("key"), "key", "left_anti")


def check_prior(log: DataFrame, prior: DataFrame) -> None:
    """Raises where keys are done with rows, but the prior rows hold none of theirs."""
    gone = done_keys(log).filter("parsed > 0").join(prior.select("key").distinct(), "key", "left_anti")
    n = gone.count()
    if n:
        raise MissingPriorRows(f"{n} keys are marked done, but their rows are missing; start afresh or accept the loss")


def resume(work: DataFrame, log: DataFrame, prior: DataFrame, process: Callable[[DataFrame], DataFrame], allow_missing: bool = False) -> DataFrame:
    """The rows of the done work as they are in prior, and process() of the rest; rows carry their key.

    Prior rows of work that isn't done are dropped, as it runs again and gives them anew.
    """
    if not allow_missing:
        check_prior(log, prior)
    kept = prior.join(done_keys(log).select("key"), "key", "left_semi")
    return kept.unionByName(process(remaining(work, log)).select(*kept.columns))

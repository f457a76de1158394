"""Indexing policy as joins and one CASE per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import policy as P
from pagelens.functions import urls as U
from pagelens.functions.text import strip
from pagelens.model import Library, Policy
from pagelens.operators.spread import broadcast_if_small


def load_policy(texts: DataFrame, text: str = "text") -> DataFrame:
    """Domain rules from settings text, one per line; blank lines dropped."""
    line = F.explode(F.split(text, "\n")).alias("line")
    domain = F.lower(strip(F.col("line"))).alias("domain")
    return texts.select(line).select(domain).filter("domain <> ''").distinct()


def match_domains(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """Hosts that equal a listed domain or lie below one.

    Each distinct host is looked up under all of its suffixes, so this is an equi-join.
    """
    rules = domains.select(F.lower(strip(F.col("domain"))).alias("domain")).filter("domain <> ''")
    names = hosts.select("host").distinct().select(
        "host", F.explode(U.host_suffixes(F.col("host"))).alias("domain")
    )
    return names.join(broadcast_if_small(rules), "domain", "left_semi").select("host").distinct()


def _listed(df: DataFrame, domains: DataFrame | None, name: str) -> DataFrame:
    if domains is None:
        return df.withColumn(name, F.lit(False))
    hit = match_domains(df, domains).withColumn(name, F.lit(True))
    return df.join(hit, "host", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def registry_skip(url: Column) -> Column:
    """Sites and paths that are never indexed."""
    listed = F.arrays_overlap(
        U.host_suffixes(U.hostname(url)), F.array(*[F.lit(d) for d in P.SKIP_DOMAINS])
    )
    return U.is_web(url) & (listed | P.skip_path(U.path_and_query(url)))


def _host_rules(pages: DataFrame, policy: Policy) -> DataFrame:
    df = pages.withColumn("host", U.hostname(F.col("url")))
    df = _listed(df, policy.blocklist, "_blocked")
    return _listed(df, policy.allowlist if policy.allowlist_only else None, "_allowed")


def _incognito(df: DataFrame) -> Column:
    has = "incognito" in df.columns
    return F.coalesce(F.col("incognito"), F.lit(False)) if has else F.lit(False)


def policy_reason(pages: DataFrame, policy: Policy, bypass_pause: bool = False) -> DataFrame:
    """Adds ``reason``: why a page must not be indexed, null when it may be."""
    url = F.col("url")
    ruled = _host_rules(pages, policy)
    reason = (
        F.when(F.lit(policy.paused and not bypass_pause), "paused")
        .when(_incognito(pages), "incognito")
        .when(~U.is_url(url), "bad_url")
        .when(registry_skip(url), "always_skip_registry")
        .when(F.lit(policy.allowlist_only) & ~F.col("_allowed"), "allowlist")
        .when(F.col("_blocked"), "blocklist")
        .when(P.sensitive(F.col("host"), U.path(url)), "sensitive_heuristic")
    )
    return ruled.withColumn("reason", reason).drop("_blocked", "_allowed", "host")


def url_status(pages: DataFrame, library: Library, policy: Policy) -> DataFrame:
    """Adds ``status`` for display: the first rule that applies, or whether the page is saved."""
    url = F.col("url")
    saved = library.documents.select("url", "last_visited_at").filter("last_visited_at is not null")
    ruled = _host_rules(pages, policy).join(saved, "url", "left")
    status = (
        F.when(F.lit(policy.paused), "paused")
        .when(_incognito(pages), "incognito")
        .when(~U.is_url(url), "bad_url")
        .when(~U.scheme(url).isin("http", "https"), "not_web")
        .when(registry_skip(url), "skipped")
        .when(F.lit(policy.allowlist_only) & ~F.col("_allowed"), "not_allowed")
        .when(F.col("_blocked"), "blocked")
        .when(P.sensitive(F.col("host"), U.path(url)), "sensitive")
        .when(F.col("last_visited_at").isNotNull(), "indexed")
        .otherwise("not_saved")
    )
    return ruled.withColumn("status", status).drop("_blocked", "_allowed", "host")


def redaction_audit(df: DataFrame, types: str = "pii_types") -> DataFrame:
    """Texts per kind of redacted string.

    An outer explode: for a plain one Catalyst adds a filter that would look for the kinds twice.
    """
    kinds = df.select(F.explode_outer(types).alias("kind")).filter("kind is not null")
    return kinds.groupBy("kind").agg(F.count("*").alias("texts"))

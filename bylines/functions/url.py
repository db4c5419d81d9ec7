"""URL expressions: canonical form, registrable domain, publisher identity, band and family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bylines.functions.text import first_that, let
from bylines.schemas import AGGREGATORS, FAMILIES, LEGACY, PLATFORMS, REDIRECT_KEYS, REDIRECTORS, SUFFIXES, TRACKING

_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query."""
    return F.regexp_extract(url, _PARTS, i)


def host(url: Column) -> Column:
    """Lower-case host without user, default port and www."""
    name = F.regexp_replace(F.lower(part(url, 2)), "^.*@", "")
    return F.regexp_replace(F.regexp_replace(name, ":(80|443)?$", ""), r"^www\.", "")


def _decoded(v: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.regexp_replace(v, "%(?![0-9A-Fa-f]{2})", "%25")), v)


def unwrapped(url: Column) -> Column:
    """The target that a known redirector carries in its query, else the URL."""
    keys = "|".join(REDIRECT_KEYS)
    target = _decoded(F.regexp_extract(part(url, 4), rf"(?i)(?:^|&)(?:{keys})=(http[^&]*)", 1))
    return F.when(host(url).isin(REDIRECTORS) & (target != ""), target).otherwise(url)


def without_amp(url: Column) -> Column:
    scheme = F.when(part(url, 1) == "", F.lit("https")).otherwise(part(url, 1))
    path = part(url, 3)
    viewer = F.regexp_extract(path, r"(?i)^/amp/(?:s/)?(.+)$", 1)
    cached = F.regexp_extract(path, r"^/[cv]/(?:s/)?(.+)$", 1)
    bare = F.regexp_replace(path, r"(?i)/amp(\.html)?/?$", "")
    query = F.when(part(url, 4) != "", F.concat(F.lit("?"), part(url, 4))).otherwise("")
    return (
        F.when((host(url) == "google.com") & (viewer != ""), F.concat(scheme, F.lit("://"), viewer))
        .when(F.lower(part(url, 2)).endswith("cdn.ampproject.org") & (cached != ""), F.concat(scheme, F.lit("://"), cached))
        .when(bare != path, F.concat(scheme, F.lit("://"), part(url, 2), bare, query))
        .otherwise(url)
    )


def _normal(u: Column) -> Column:
    pairs = F.filter(F.split(part(u, 4), "&"), lambda p: p != "")
    keyed = F.transform(pairs, lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("k"), F.substring_index(p, "=", 1).alias("raw"), F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("").alias("v")))
    kept = F.array_sort(F.filter(keyed, lambda s: ~s["k"].isin(TRACKING) & ~s["k"].startswith("utm_")))
    code = lambda c: F.url_encode(_decoded(c))
    query = F.array_join(F.transform(kept, lambda s: F.concat(code(s["raw"]), F.lit("="), code(s["v"]))), "&")
    scheme = F.when(part(u, 1) == "", F.lit("https")).otherwise(F.lower(part(u, 1)))
    return F.concat(scheme, F.lit("://"), host(u), F.regexp_replace(part(u, 3), "/+$", ""), let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def canonical_url(url: Column) -> Column:
    """A stable key: redirectors unwrapped, AMP and tracking stripped, host lowered, parameters sorted; "" for blank."""
    blank = F.trim(F.coalesce(url, F.lit(""))) == ""
    found = let(let(F.trim(F.coalesce(url, F.lit(""))), unwrapped), lambda u: let(without_amp(u), _normal))
    return F.when(blank, F.lit("")).otherwise(found)


def grouping_url(canonical: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(canonical), F.lit("")), F.nullif(canonical_url(url), F.lit("")), url)


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host, three under a known two-label suffix."""
    h = F.regexp_replace(F.when(F.contains(url, F.lit("://")), host(url)).otherwise(F.regexp_replace(F.lower(F.trim(url)), r"^www\.|[:/].*$", "")), r":\d+$", "")
    return F.when(F.substring_index(h, ".", -2).isin(SUFFIXES), F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))


def publisher_identity(url: Column) -> Column:
    """The registrable domain; on a shared platform, the platform and who writes there."""
    domain, h = registrable_domain(url), host(url)
    rule = reduce(lambda c, kv: c.when(domain == kv[0], F.lit(kv[1])), PLATFORMS.items(), F)
    sub = F.when(h != domain, F.substring(h, F.lit(1), F.length(h) - F.length(domain) - 1)).otherwise("")
    first = F.regexp_extract(part(url, 3), "^/+([^/]+)", 1)
    who = F.when(rule == "subdomain", sub).when(rule == "first_path_segment", F.lower(first)).otherwise("")
    return F.when(who != "", F.concat(domain, F.lit("/"), who)).otherwise(domain)


def publisher_family(url: Column) -> Column:
    domain, h = registrable_domain(url), host(url)
    named = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    return F.coalesce(F.try_element_at(named, domain), F.try_element_at(named, h), F.nullif(domain, F.lit("")), F.lit("unknown"))


def source_band(url: Column) -> Column:
    domain = registrable_domain(url)
    return first_that([(F.contains(domain, F.lit("google.com")) | domain.isin(AGGREGATORS), "aggregator"), (publisher_family(url).isin(LEGACY), "known_legacy")], "unknown")

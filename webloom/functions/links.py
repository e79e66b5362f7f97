"""Link rules: which addresses are pages worth a visit, and under which spelling."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.fixed import ENGLISH_ONLY_SITES, FILE_SUFFIXES, FORBIDDEN_ON_SITE, FORBIDDEN_PATHS, FORBIDDEN_SITES

_PARTS = r"^(?i)([a-z][a-z0-9+.\-]*:)//([^/?#]*)([^?#]*)"


def scheme(uri: Column) -> Column:
    """With its colon, as it is spelled; empty where there is no authority."""
    return F.regexp_extract(uri, _PARTS, 1)


def host(uri: Column) -> Column:
    """The registered name, without user and port, as it is spelled."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(uri, _PARTS, 2), "^.*@", ""), r":\d*$", "")


def path(uri: Column) -> Column:
    return F.regexp_extract(uri, _PARTS, 3)


def any_of(words: list[str]) -> str:
    """One pattern for all of a list: a single pass instead of one LIKE for each."""
    return "(?:" + "|".join(re.escape(w).replace("/", "/") for w in words) + ")"


def on_domain(name: Column, domain: str) -> Column:
    return (name == domain) | name.endswith("." + domain)


def year_month_page(lower_path: Column) -> Column:
    """Whether the path ends in a year, or a year and a two-digit month: an archive page."""
    tight = F.regexp_replace(F.regexp_replace(lower_path, "/+", "/"), "^/|/$", "")
    return tight.rlike(r"(?:^|/)[12]\d{3}(?:/\d{2})?$")


def acceptable_link(uri: Column) -> Column:
    """The rules for a link met while crawling; an address without authority isn't acceptable, null stays null."""
    name, low = host(uri), F.lower(path(uri))
    english = reduce(and_, [~on_domain(name, s) | on_domain(name, f"en.{s}") for s in ENGLISH_ONLY_SITES])
    by_site = reduce(or_, [on_domain(name, s) & low.rlike(any_of(paths)) for s, paths in FORBIDDEN_ON_SITE.items()])
    return (
        scheme(uri).isin("http:", "https:")
        & ~low.rlike(any_of(FILE_SUFFIXES) + "$")
        & ~name.rlike("(?:^|\\.)" + any_of(FORBIDDEN_SITES) + "$")
        & english & ~low.rlike(any_of(FORBIDDEN_PATHS)) & ~by_site & ~year_month_page(low)
    )


def quickly_acceptable(uri: Column) -> Column:
    """The coarser rule used on whole tables: no forbidden path and no forbidden site anywhere in the address, as it is spelled."""
    return ~uri.rlike(any_of(FORBIDDEN_PATHS + [f"{s}/" for s in FORBIDDEN_SITES]))


def normalized_uri(uri: Column) -> Column:
    """Without query, fragment and trailing slashes; mobile and new editions of two sites under their main name."""
    bare = F.regexp_replace(F.regexp_replace(uri, r"[?#][\s\S]*$", ""), "/+$", "")
    head, rest = F.regexp_extract(bare, r"^([^/]*//[^/]*)([\s\S]*)$", 1), F.regexp_extract(bare, r"^([^/]*//[^/]*)([\s\S]*)$", 2)
    head = F.replace(F.replace(head, F.lit("m.wikipedia.org"), F.lit("wikipedia.org")), F.lit("new.reddit.com"), F.lit("old.reddit.com"))
    return F.when(bare.rlike("^[^/]*//[^/]"), F.concat(head, rest)).otherwise(bare)


def domain_key(uri: Column) -> Column:
    """The authority alone, under https."""
    authority = F.regexp_extract(uri, _PARTS, 2)
    return F.when(authority != "", F.concat(F.lit("https://"), authority))


def favicon(uri: Column) -> Column:
    return F.when(F.regexp_extract(uri, _PARTS, 2) != "", F.concat(scheme(uri), F.lit("//"), F.regexp_extract(uri, _PARTS, 2), F.lit("/favicon.ico")))


def mime(content_type: Column) -> Column:
    return F.substring_index(content_type, ";", 1)


def robots_allowed(uri_path: Column, allow: Column, disallow: Column) -> Column:
    """An allowed prefix wins over a denied one; null lists are empty and empty prefixes say nothing."""
    none = F.array().cast("array<string>")
    starts = lambda rules: F.exists(F.coalesce(rules, none), lambda r: F.coalesce((r != "") & uri_path.startswith(r), F.lit(False)))
    return starts(allow) | ~starts(disallow)


#: Status codes of a probe: what they say about the address.
def probe_result(status: Column, location: Column, uri: Column) -> Column:
    """The address that answers: itself for 2xx, where it is moved to for 3xx, else none."""
    return F.when(status.between(200, 299), uri).when(status.between(300, 399), location)

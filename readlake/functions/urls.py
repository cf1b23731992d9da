"""Addresses: what is a page to read, its host, its tidy form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_URL = 2048
# Sites whose addresses are not documents to read in full.
NOT_DOCUMENTS = (
    "youtube.com",
    "youtu.be",
    "facebook.com",
    "instagram.com",
    "tiktok.com",
    "x.com",
    "twitter.com",
    "reddit.com",
    "quora.com",
    "pinterest.com",
    "linkedin.com",
)
# Publishers whose licence is known without looking the article up.
ND_HOSTS, ND_LICENSE = ("theconversation.com",), "CC BY-ND 4.0"


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def valid_url(raw: Column) -> Column:
    """http(s), a host, no user-info, at most 2048 characters."""
    url = F.trim(F.coalesce(raw, F.lit("")))
    good = (
        (F.length(url) > 0)
        & (F.length(url) <= MAX_URL)
        & F.rlike(url, F.lit("(?i)^https?://[^/?#]"))
        & F.try_parse_url(url, F.lit("HOST")).isNotNull()
        & F.try_parse_url(url, F.lit("USERINFO")).isNull()
    )
    return F.coalesce(good, F.lit(False))


def on_site(name: Column, sites: tuple[str, ...]) -> Column:
    """The host is one of the sites or below one."""
    pattern = "(^|\\.)(" + "|".join(s.replace(".", "\\.") for s in sites) + ")$"
    return F.coalesce(F.rlike(name, F.lit(pattern)), F.lit(False))


def is_document_host(url: Column) -> Column:
    return ~on_site(domain(url), NOT_DOCUMENTS)


def clean_url(raw: Column) -> Column:
    """The address without tracking parameters and fragment; null when it is no page to read."""
    url = F.regexp_replace(F.trim(raw), "#.*$", "")
    kept = F.filter(
        F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"),
        lambda p: (p != "") & ~F.startswith(p, F.lit("utm_")),
    )
    base = F.substring_index(url, "?", 1)
    whole = F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)
    return F.when(valid_url(raw) & is_document_host(raw), whole)


def same_page_key(url: Column) -> Column:
    """What two addresses of one page share."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    return F.lower(F.concat(domain(url), path, F.lit("?"), query))


def known_license(license: Column, url: Column) -> Column:
    """The article's licence, else the one its publisher always uses."""
    return F.coalesce(license, F.when(on_site(host(url), ND_HOSTS), ND_LICENSE))


def tidy_title(title: Column, url: Column) -> Column:
    """A page's title without the site's name after a separator, when that part names the host."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    whole = F.substring(F.trim(F.regexp_replace(title, r"\s+", " ")), 1, 500)
    labels = F.split(domain(url), r"\.")
    named = F.when(F.size(labels) > 1, F.slice(labels, 1, F.size(labels) - 1)).otherwise(labels)
    site = squeeze(
        F.aggregate(named, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    )
    flat = squeeze(domain(url))
    out = F.nullif(whole, F.lit(""))
    for mark in (" - ", " — ", " – ", " | "):  # the first mark that fits wins, so it is tried last here
        tail = F.substring_index(whole, mark, -1)
        head = F.trim(F.substr(whole, F.lit(1), F.length(whole) - F.length(tail) - len(mark)))
        name = squeeze(tail)
        fits = (
            F.contains(whole, F.lit(mark))
            & (F.length(head) > 0)
            & (F.length(name) >= 3)
            & (F.contains(flat, name) | ((F.length(site) >= 4) & F.contains(name, site)))
        )
        out = F.when(fits, head).otherwise(out)
    return F.coalesce(out, host(url))


@F.pandas_udf(T.BooleanType())
def is_public_ip(values: pd.Series) -> pd.Series:
    """Whether a literal v4/v6 address is on the public net; null for what is no address."""
    import ipaddress

    def one(value):
        try:
            ip = ipaddress.ip_address(str(value).split("%", 1)[0])
        except ValueError:
            return None
        ip = getattr(ip, "ipv4_mapped", None) or ip
        closed = (
            ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved
            or ip.is_unspecified
        )
        return bool(ip.is_global and not closed)

    return values.map(one, na_action="ignore")

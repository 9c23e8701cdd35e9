"""URL and host functions as Column expressions; all stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track where a visit came from.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "source", "_ga")

#: Public suffixes of two labels that the registered domain must not stop at; other suffixes have one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "co.za", "com.br", "com.cn", "com.mx", "com.tr", "com.vn", "co.in", "co.kr", "github.io", "blogspot.com")

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def with_scheme(url: Column) -> Column:
    """The trimmed URL; http:// before one that has no scheme."""
    text = F.trim(url)
    return F.when(F.contains(text, F.lit("://")) | (text == ""), text).otherwise(F.concat(F.lit("http://"), text))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def authority(url: Column) -> Column:
    """Host and port, without user information."""
    return F.regexp_replace(F.regexp_extract(url, _PARTS, 2), "^.*@", "")


def host(url: Column) -> Column:
    """Lower-case host without port; empty if the URL has none."""
    return F.lower(F.regexp_replace(authority(with_scheme(url)), r":[0-9]*$", ""))


def path(url: Column) -> Column:
    """The path; / if it is empty."""
    return F.coalesce(F.nullif(F.regexp_extract(with_scheme(url), _PARTS, 3), F.lit("")), F.lit("/"))


def query(url: Column) -> Column:
    """The query without its question mark; empty if there is none."""
    return F.substring(F.coalesce(F.regexp_extract(with_scheme(url), _PARTS, 4), F.lit("")), 2, 1 << 30)


def tld(host_name: Column) -> Column:
    return F.substring_index(host_name, ".", -1)


def reverse_host(host_name: Column) -> Column:
    """Labels in reverse order; its own inverse."""
    return F.concat_ws(".", F.reverse(F.split(host_name, r"\.")))


def surt_host_key(host_name: Column) -> Column:
    """The host part of sort keys: reversed labels between commas; a leading www stays."""
    bare = F.regexp_replace(F.lower(F.trim(host_name)), r"^\.+|\.+$", "")
    return F.concat_ws(",", F.reverse(F.split(bare, r"\.")))


def surt(url: Column) -> Column:
    """Sort-friendly key: reversed host without one leading www., lower-case path, and the query as it is."""
    text = with_scheme(url)
    name = F.regexp_replace(host(url), r"^www\.", "")
    asked = query(url)
    key = F.concat(surt_host_key(name), F.lit(")"), F.lower(path(url)), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")))
    return F.when(F.trim(url) == "", F.lit("")).when(name == "", F.lower(text)).otherwise(key)


def canonical_url(url: Column) -> Column:
    """A scheme, a lower-case host, no fragment."""
    text = with_scheme(url)
    name = F.regexp_extract(text, _PARTS, 2)
    rest = F.concat(F.regexp_extract(text, _PARTS, 3), F.coalesce(F.regexp_extract(text, _PARTS, 4), F.lit("")))
    return F.when(name == "", text).otherwise(F.concat(scheme(text), F.lit("://"), F.lower(name), rest))


def strip_tracking(raw_query: Column) -> Column:
    """The query's pairs, in order, without tracking parameters."""
    pairs = F.split(raw_query, "&")
    kept = F.filter(pairs, lambda p: ~F.substring_index(p, "=", 1).isin(*TRACKING))
    return F.array_join(kept, "&")


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, no tracking parameters."""
    kind, name = scheme(url), F.lower(F.regexp_extract(url, _PARTS, 2))
    name = F.when(kind == "http", F.regexp_replace(name, ":80$", "")).when(kind == "https", F.regexp_replace(name, ":443$", "")).otherwise(name)
    asked = strip_tracking(F.substring(F.coalesce(F.regexp_extract(url, _PARTS, 4), F.lit("")), 2, 1 << 30))
    made = F.concat(kind, F.lit("://"), name, F.regexp_extract(url, _PARTS, 3), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")))
    return F.when(kind == "", url).otherwise(made)


def naive_domain(host_name: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host_name, ".", -2)


def registered_domain(host_name: Column) -> Column:
    """The public suffix and the label before it, by the rules above; empty for a bare suffix."""
    name = F.lower(host_name)
    long = F.substring_index(name, ".", -2).isin(*TWO_LABEL_SUFFIXES)
    found = F.when(long, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return F.when(F.size(F.split(name, r"\.")) < F.when(long, 3).otherwise(2), F.lit("")).otherwise(found)

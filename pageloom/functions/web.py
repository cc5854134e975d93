"""Column functions for URLs, requests and caches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without port; empty when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def canonical_url(url: Column) -> Column:
    """Lower case, without a fragment."""
    return F.lower(F.regexp_replace(url, "#.*$", ""))


def is_internal(href: Column, host: Column) -> Column:
    """Whether a link stays on a host: relative, or absolute to the same host."""
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(href) == host).otherwise(~href.rlike(r"^(?:#|mailto:|javascript:|tel:|data:)|^$"))


def is_hostname(text: Column) -> Column:
    return (F.length(text) <= 253) & text.rlike(r"^(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)*[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?$")


def is_public_url(url: Column) -> Column:
    """http(s) to a host that is no loopback, private or link-local literal."""
    host = host_of(url)
    private = r"^(?:localhost|.*\.localhost|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(?:1[6-9]|2[0-9]|3[01])\..*|0\..*|\[.*)$"
    return url.rlike("^https?://") & (F.length(host) > 0) & ~host.rlike(private)


def accept_quality(accept: Column, kind: str) -> Column:
    """The q value of a media type in an Accept header: exact over type/* over */*; 1 without a header, 0 without a match."""
    parts = F.transform(F.split(F.lower(F.regexp_replace(accept, r"\s", "")), ","), lambda p: F.struct(F.split_part(p, F.lit(";"), F.lit(1)).alias("type"), p.alias("raw")))
    q = lambda p: F.coalesce(F.nullif(F.regexp_extract(p["raw"], r";q=([0-9.]+)", 1), F.lit("")).cast("double"), F.lit(1.0))
    best = lambda name: F.array_max(F.transform(F.filter(parts, lambda p: p["type"] == name), q))
    return F.when(accept.isNull() | (F.trim(accept) == ""), 1.0).otherwise(F.coalesce(best(kind), best(kind.split("/")[0] + "/*"), best("*/*"), F.lit(0.0)))


def sorted_query(url: Column, drop: str = "format") -> Column:
    """A URL's query with its parameters in order, one of them left out."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (F.length(p) > 0) & ~p.startswith(drop + "="))), "&")


def cache_key(method: Column, url: Column, profile: Column) -> Column:
    """A cache key from method, scheme, host, path, ordered query and profile."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(F.lit("md:"), F.sha2(F.concat_ws("|", F.upper(method), scheme, host_of(url), path, sorted_query(url), profile), 256))


def etag(body: Column) -> Column:
    return F.concat(F.lit('"'), F.sha2(body, 256), F.lit('"'))


def cache_control(max_age: Column, public: Column, stale: Column) -> Column:
    return F.concat_ws(", ", F.when(public, "public").otherwise("private"), F.concat(F.lit("max-age="), max_age.cast("string")), F.when(stale > 0, F.concat(F.lit("stale-while-revalidate="), stale.cast("string"))))


def excerpt(text: Column, size: int = 4096) -> Column:
    """White space runs as one space, lower case, at most ``size`` characters: the excerpt is the feature."""
    return F.left(F.lower(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))), F.lit(size))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\*_`])", r"\\$1")

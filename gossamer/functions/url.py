"""URL identity: normalisation, origins, paths and lookup variants as column expressions."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, and extensions that are not pages.
TRACKING = ("fbclid", "gclid", "msclkid")
TRACKING_PREFIX = "utm_"
ASSETS = ("pdf", "jpg", "png", "svg", "webp", "gif", "zip", "xml", "json", "mp4", "avif", "ics")

_ABS = r"^(?i:https?)://"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def port(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z]+://[^/?#:]*:([0-9]+)", 1)


def origin(u: Column) -> Column:
    """scheme://host[:port] without a default port; null for anything but absolute http(s)."""
    default = ((scheme(u) == "http") & (port(u) == "80")) | ((scheme(u) == "https") & (port(u) == "443")) | (port(u) == "")
    return F.when(u.rlike(_ABS) & (host(u) != ""), F.concat(scheme(u), F.lit("://"), host(u), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port(u)))))


def path(u: Column) -> Column:
    """Path with single slashes and no trailing slash; '/' at least."""
    raw = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    one = F.regexp_replace(F.when(raw == "", F.lit("/")).otherwise(raw), "/+", "/")
    return F.when(F.length(one) > 1, F.regexp_replace(one, "/$", "")).otherwise(one)


def query_params(u: Column) -> Column:
    """Kept parameters, stably sorted by name."""
    raw = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    name = lambda p: F.regexp_extract(p, "^([^=]*)", 1)
    kept = F.filter(raw, lambda p: ~(name(p).startswith(TRACKING_PREFIX) | name(p).isin(*TRACKING)))
    keyed = F.transform(kept, lambda p, i: F.named_struct(F.lit("k"), name(p), F.lit("i"), i, F.lit("p"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))))
    return F.transform(F.array_sort(keyed), lambda s: F.replace(s.p, F.lit("%20"), F.lit("+")))


def normalize_url(u: Column, strip_query: bool = False, to_path: bool = False) -> Column:
    """Canonical form of an absolute http(s) URL; null for other schemes, assets and garbage."""
    u = F.trim(u)
    q = F.lit("") if strip_query else F.array_join(query_params(u), "&")
    tail = F.concat(path(u), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    asset = path(u).rlike(r"(?i)\.(" + "|".join(ASSETS) + ")$")
    return F.when(origin(u).isNotNull() & ~asset, tail if to_path else F.concat(origin(u), tail))


def normalize_one(url: str | None, base: str | None = None, strip_query: bool = False, to_path: bool = False) -> str | None:
    """The general case, with relative references resolved against ``base``."""
    if not url:
        return None
    try:
        parts = urlsplit(urljoin(base or "", url.strip()))
        if parts.scheme.lower() not in ("http", "https") or not parts.hostname:
            return None
        name = parts.hostname.lower()
        if not name.isascii():
            name = name.encode("idna").decode()
        number = parts.port
    except (ValueError, UnicodeError):
        return None
    keep = number and (parts.scheme.lower(), number) not in (("http", 80), ("https", 443))
    p = re.sub("/+", "/", quote(parts.path or "/", safe="/%:@!$&'()*+,;=~-._"))
    if len(p) > 1 and p.endswith("/"):
        p = p[:-1]
    if re.search(r"\.(" + "|".join(ASSETS) + ")$", p, re.I):
        return None
    q = ""
    if not strip_query and parts.query:
        pairs = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.startswith(TRACKING_PREFIX) and k not in TRACKING]
        q = urlencode(sorted(pairs, key=lambda kv: kv[0]))
    tail = p + ("?" + q if q else "")
    return tail if to_path else f"{parts.scheme.lower()}://{name}{f':{number}' if keep else ''}{tail}"


def normalize_url_udf(url: Column, base: Column, strip_query: bool = False, to_path: bool = False) -> Column:
    """Arrow-batched ``normalize_one`` for relative references."""

    @F.pandas_udf("string")
    def run(u: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([normalize_one(x, y, strip_query, to_path) for x, y in zip(u, b)], dtype=object)

    return run(url, base)


def extract_domain(u: Column) -> Column:
    """Host without a leading 'www.'; a bare domain counts as https."""
    full = F.when(u.rlike("^[A-Za-z]+://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.regexp_replace(host(full), r"^www\.", "")


def site_origin(domain: Column, preferred: Column, ssl: Column) -> Column:
    return F.coalesce(origin(preferred), F.concat(F.when(ssl == 0, F.lit("http://")).otherwise(F.lit("https://")), domain))


def to_path(u: Column, site: Column) -> Column:
    """Path and query of a URL of the site, others as they are."""
    rest = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1)
    return F.when(origin(u) == site, F.when(rest == "", F.lit("/")).otherwise(F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))).otherwise(u)


def to_absolute(u: Column, site: Column) -> Column:
    return F.when(u.startswith("/"), F.concat(site, u)).otherwise(u)


def is_internal(u: Column, site: Column) -> Column:
    return ~u.startswith("http") | F.coalesce(origin(u) == site, F.lit(False))


def lookup_candidates(u: Column, site: Column) -> Column:
    """Forms under which a page may be stored, most likely first, without repeats."""
    p = to_path(u, site)
    short, long = F.regexp_replace(p, "(?<=.)/$", ""), F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/")))
    return F.array_distinct(F.array(u, p, short, long, to_absolute(short, site)))


def label_suffix(name: Column, root: Column) -> Column:
    """Is a host the root or one of its sub-domains?"""
    return (name == root) | F.endswith(name, F.concat(F.lit("."), root))


def clean_host(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\.$", "")


def scope(u: Column, root: Column, allowed: list[str] | None = None, denied: list[str] | None = None, subdomains: bool = False) -> Column:
    """allowed / blocked_by_domain_filter / blocked_subdomain. Denials win; an allow list excludes all else."""
    h = clean_host(host(u))
    listed = lambda names: h.isin(*[n.lower().rstrip(".") for n in names]) if names else F.lit(False)
    inside = label_suffix(h, root) if subdomains else (h == root)
    chain = F.when(u.startswith("/"), "allowed").when(listed(denied), "blocked_by_domain_filter")
    if allowed:
        return chain.when(listed(allowed), "allowed").otherwise("blocked_by_domain_filter")
    return chain.when(inside, "allowed").otherwise("blocked_subdomain")


#: Parameters that carry sessions.
SESSION_PARAMS = ("sid", "session", "phpsessid", "sessid", "token", "intended")


def is_internal_ipv4(ip: Column) -> Column:
    """Private, loopback, link-local and 0/8 addresses; what is no IPv4 address counts as internal."""
    part = lambda i: F.try_element_at(F.split(ip, r"\."), F.lit(i)).try_cast("int")
    a, b = part(1), part(2)
    valid = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(F.split(ip, r"\."), lambda x: x.try_cast("int") <= 255)
    private = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
    return ~F.coalesce(valid, F.lit(False)) | private


def is_internal_ip(ip: Column) -> Column:
    """As above, with IPv6 loopback, unspecified, fc00::/7, fe80::/10 and mapped addresses."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        import ipaddress

        v4 = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16")]
        v6 = [ipaddress.ip_network(n) for n in ("::1/128", "::/128", "fc00::/7", "fe80::/10")]

        def one(x: str | None) -> bool:
            try:
                a = ipaddress.ip_address(x or "")
            except ValueError:
                return True
            if a.version == 6 and a.ipv4_mapped:
                a = a.ipv4_mapped
            return any(a in n for n in (v4 if a.version == 4 else v6))

        return s.map(one)

    return run(ip)


def trap_flags(df, url: str = "url", ordinal: str = "ordinal", limit: int = 30):
    """Adds trap_risk and trap_type: session parameters, calendars, deep pagination, facets.

    Facets count the distinct parameter combinations of a path up to the row, by ``ordinal``.
    """
    from pyspark.sql import Window

    u = F.col(url)
    raw = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    name = lambda p: F.lower(F.regexp_extract(p, "^([^=]*)", 1))
    session = F.exists(raw, lambda p: name(p).isin(*SESSION_PARAMS) | name(p).contains("session"))
    calendar = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1).rlike(r"/\d{4}[-/]\d{2}[-/]\d{2}/|/\d{2}[-/]\d{2}[-/]\d{4}/")
    deep = F.exists(raw, lambda p: name(p).isin("page", "p", "pg") & (F.coalesce(F.regexp_extract(p, "=([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)) > 50))
    place = F.regexp_extract(u, "^([^?#]*)", 1)
    combo = F.array_join(F.array_sort(raw), "&")
    out = df.withColumn("_place", place).withColumn("_combo", combo)
    first = F.row_number().over(Window.partitionBy("_place", "_combo").orderBy(ordinal)) == 1
    out = out.withColumn("_first", first.cast("int"))
    run = F.sum("_first").over(Window.partitionBy("_place").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("_facets", run > limit)
    f = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    kind = F.when(deep, "pagination_loop").when(calendar, "calendar_trap").when(session, "session_trap").when(F.col("_facets"), "faceted_navigation")
    return out.withColumn("trap_risk", F.greatest(f(session, 0.9), f(calendar, 0.7), f(deep, 0.85), f(F.col("_facets"), 0.95))).withColumn("trap_type", kind).drop("_place", "_combo", "_first", "_facets")

"""Fetching over a transport function that the caller gives: retries, redirects, conditional requests, byte limits.

A transport is ``send(url, headers) -> {"status", "headers", "body"}`` with the body as bytes or text;
it raises on network errors. Nothing here opens a connection itself.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions.url import host

#: Limits of a fetch, and the states that stand for a status where there is none.
MAX_BYTES, MAX_HOPS, MAX_RETRIES, BASE_MS, JITTER = 2_000_000, 5, 3, 500, 0.1
STATES = ("oversized", "redirect_loop", "redirect_limit_exceeded", "blocked_internal_ip", "blocked_by_domain_filter", "blocked_subdomain", "proxy_connection_failed", "network_error", "failed_after_retries")

FETCHED = "url string, status int, state string, final_url string, redirect_chain array<struct<url:string,status:int,target:string>>, etag string, last_modified string, retries int, bytes bigint, headers map<string,string>, body string"


class Oversized(Exception):
    pass


class Blocked(Exception):
    """Raised by a transport that refuses an internal address."""


def retry_delays(retries: int = MAX_RETRIES, base_ms: float = BASE_MS, jitter: float = JITTER, draw: Callable[[], float] = random.random) -> Iterator[float]:
    """Milliseconds before each retry: doubled each time, give or take the jitter."""
    for n in range(retries):
        delay = base_ms * 2**n
        yield max(0.0, delay + delay * jitter * (2 * draw() - 1))


def with_retries(operation: Callable[[], dict], retryable: Callable[[Exception], bool], retries: int = MAX_RETRIES, base_ms: float = BASE_MS, sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random) -> tuple[dict, int]:
    """(result, retries used); the last error is raised once retries are spent or do not help."""
    delays = retry_delays(retries, base_ms, draw=draw)
    used = 0
    while True:
        try:
            return operation(), used
        except Exception as e:
            wait = next(delays, None)
            if wait is None or not retryable(e):
                e.retries = used
                raise
            sleep(wait / 1000)
            used += 1


def limited(body: bytes | str | None, most: int) -> tuple[str, int]:
    """(text, bytes) of a body of at most so many bytes; a larger one is refused, not cut."""
    raw = body.encode() if isinstance(body, str) else body or b""
    if len(raw) > most:
        raise Oversized(str(len(raw)))
    return raw.decode("utf-8", "replace"), len(raw)


def fetch_one(url: str, send: Callable[[str, dict], dict], etag: str | None = None, last_modified: str | None = None, scope: Callable[[str], str] | None = None, max_bytes: int = MAX_BYTES, max_hops: int = MAX_HOPS, retries: int = MAX_RETRIES, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One page with its redirects. The conditional headers go with the first request only; statuses
    429 and 5xx and network errors are tried again; ``scope`` says "allowed" or why not, for every hop."""
    now, chain, used = url, [], 0
    seen = {url.split("#")[0]}
    out = {"url": url, "status": None, "state": None, "etag": None, "last_modified": None, "bytes": 0, "headers": {}, "body": None}
    close = lambda **kw: {**out, "final_url": now, "redirect_chain": chain, "retries": used, **kw}
    while True:
        verdict = scope(now) if scope else "allowed"
        if verdict != "allowed":
            return close(state=verdict)
        headers = {}
        if not chain:
            headers |= {"If-None-Match": etag} if etag else {}
            headers |= {"If-Modified-Since": last_modified} if last_modified else {}

        def once() -> dict:
            r = send(now, headers)
            if r["status"] == 429 or 500 <= r["status"] <= 599:
                raise ConnectionError(f"status {r['status']}")
            return r

        try:
            r, n = with_retries(once, lambda e: isinstance(e, (ConnectionError, TimeoutError)) and not isinstance(e, ConnectionRefusedError), retries, sleep=sleep)
            used += n
        except Blocked:
            return close(state="blocked_internal_ip")
        except Exception as e:  # noqa: BLE001 - any failure of a transport is a row, not the end of a crawl
            used += getattr(e, "retries", 0)
            refused = isinstance(e, ConnectionRefusedError) or "proxy" in str(e).lower()
            return close(state="failed_after_retries" if used >= retries > 0 else "proxy_connection_failed" if refused else "network_error")
        head = {k.lower(): v for k, v in (r.get("headers") or {}).items()}
        if 300 <= r["status"] < 400 and r["status"] != 304 and head.get("location"):
            target = urljoin(now, head["location"])
            if target.split("#")[0] in seen:
                return close(state="redirect_loop")
            if len(chain) >= max_hops:
                return close(state="redirect_limit_exceeded")
            seen.add(target.split("#")[0])
            chain.append({"url": now, "status": r["status"], "target": target})
            now = target
            continue
        try:
            body, size = ("", 0) if r["status"] == 304 else limited(r.get("body"), max_bytes)
        except Oversized as e:
            return close(state="oversized", headers=head, bytes=int(str(e)), body="")
        return close(status=r["status"], headers=head, body=body, bytes=size, etag=head.get("etag"), last_modified=head.get("last-modified"))


def fetch_pages(urls: DataFrame, send: Callable[[str, dict], dict], url: str = "url", rate: float | None = None, crawl_delay: float = 0.0, clock: Callable[[], float] = time.time, wait: Callable[[float], None] = time.sleep, **limits) -> DataFrame:
    """A row of ``FETCHED`` for each url; columns ``etag`` and ``last_modified`` make requests conditional.

    With a ``rate`` a host is asked so often a second at most, or once every ``crawl_delay`` seconds: its urls are dealt to one
    task, which waits for tokens of the host's bucket. Hosts take turns, so that one host's wait is another's time.
    """
    from gossamer.streaming.limiter import bucket

    rule = bucket(rate) if rate else None
    names = [x.split()[0] for x in ("url", "status", "state", "final_url", "redirect_chain", "etag", "last_modified", "retries", "bytes", "headers", "body")]
    extra = [c for c in ("etag", "last_modified") if c in urls.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens: dict[str | None, list[float]] = {}

        def one(u: str, e: str | None, m: str | None) -> dict:
            if rule:
                pause = rule.step(tokens.setdefault(urlsplit(u).hostname, rule.fresh()), int(clock() * 1e6), crawl_delay)
                if pause > 0:
                    wait(pause)
            return fetch_one(u, send, e, m, **limits)

        for b in batches:
            known = [b[c] if c in extra else [None] * len(b) for c in ("etag", "last_modified")]
            rows = [one(u, e, m) for u, e, m in zip(b[url], *known)]
            out = pd.DataFrame(rows, columns=names)
            out["status"] = out["status"].astype("Int32")
            yield out

    asked = urls.select(url, *extra)
    if rule:
        of = host(F.col(url))
        n = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        turn = F.row_number().over(Window.partitionBy("_host").orderBy(url))
        asked = asked.withColumn("_host", of).withColumn("_turn", turn).repartition(n, "_host").sortWithinPartitions("_turn", "_host").drop("_host", "_turn")
    return asked.mapInPandas(run, FETCHED)


def parsed_as_html(headers: Column) -> Column:
    """The content-type gate: only text/html is parsed."""
    return F.coalesce(F.contains(F.lower(F.try_element_at(headers, F.lit("content-type"))), F.lit("text/html")), F.lit(False))


def resolve(given: str, send: Callable[[str, dict], dict], preferred: str | None = None) -> tuple[str, str | None]:
    """(url, preference to remember) of an address that may lack its protocol.

    A protocol that is there stays. Without one the remembered preference wins; else https is tried, then
    http; if neither answers with 2xx or 3xx, https is returned and nothing remembered.
    """
    if given.startswith(("http://", "https://")):
        return given, preferred or given
    name = urlsplit(f"https://{given}").hostname
    if not name:
        raise ValueError(f"no url or domain: {given}")
    if preferred:
        return preferred, preferred
    for protocol in ("https", "http"):
        r = fetch_one(f"{protocol}://{name}/", send, retries=0)
        if r["status"] is not None and 200 <= r["status"] < 400:
            return r["final_url"], r["final_url"]
    return f"https://{given}", None


def pagespeed_report(url: str, key: str, send: Callable[[str, dict], dict], strategy: str = "mobile", sleep: Callable[[float], None] = time.sleep) -> str:
    """The report of a PageSpeed service for a url, tried again twice."""
    from urllib.parse import urlencode

    asked = "https://www.googleapis.com/pagespeedonline/v5/runPagespeed?" + urlencode({"url": url, "key": key, "strategy": strategy})

    def once() -> dict:
        r = send(asked, {})
        if r["status"] != 200:
            raise ConnectionError(f"status {r['status']}")
        return r

    got, _ = with_retries(once, lambda e: True, 2, sleep=sleep, draw=lambda: 0.5)
    return limited(got.get("body"), 1 << 30)[0]


def days_left(valid_to: Column, now: Column) -> Column:
    """Whole days until a certificate ends; negative once it has."""
    return F.floor((F.unix_micros(valid_to.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / F.lit(86_400_000_000))


def probe_summary(probe: Column) -> Column:
    """What the transport audit takes from a recorded probe (a JSON text of DNS, TLS and HTTP findings)."""
    get = lambda p: F.get_json_object(probe, p)
    return F.struct(
        F.regexp_extract(get("$.tls.protocol"), r"(\d+(\.\d+)?)$", 1).try_cast("double").alias("tls"), (get("$.url").startswith("https:")).alias("https"), (get("$.tls.authorized") == "true").alias("cert_ok"),
        get("$.tls.validTo").try_cast("timestamp").alias("valid_to"), (get("$.http.version") == "2").alias("h2"), F.coalesce(get("$.http.encoding"), F.lit("")).isin("gzip", "br", "deflate", "zstd").alias("compressed"),
        get("$.timing.ttfb").try_cast("double").alias("ttfb"), F.coalesce(F.json_array_length(get("$.redirects")), F.lit(0)).alias("redirects"), get("$.size").try_cast("bigint").alias("size"),
        (F.coalesce(F.json_array_length(get("$.dns.aaaa")), F.lit(0)) > 0).alias("ipv6"), (F.coalesce(F.json_array_length(get("$.dns.a")), F.lit(0)) + F.coalesce(F.json_array_length(get("$.dns.aaaa")), F.lit(0))).alias("ips"),
    )


# -- probes ---------------------------------------------------------------------------------------

#: Fixed value: a probe follows so many redirects.
PROBE_HOPS = 10


def probe_dns(name: str, resolve: Callable[[str, str], list[str]]) -> dict:
    """Addresses and names of a host. ``resolve(name, kind)`` answers a, aaaa, cname and ptr, or raises; what fails is empty."""

    def ask(what: str, kind: str) -> list[str]:
        try:
            return list(resolve(what, kind))
        except Exception:  # noqa: BLE001 - no answer is an answer
            return []

    out = {kind: ask(name, kind) for kind in ("a", "aaaa", "cname")}
    first = next(iter(out["a"] + out["aaaa"]), None)
    return out | {"reverse": ask(first, "ptr") if first else []}


def probe_one(url: str, resolve: Callable[[str, str], list[str]], send: Callable[[str], dict], inside: Callable[[str], bool] | None = None, hops: int = PROBE_HOPS) -> dict:
    """What DNS, TLS and HTTP tell of a url, in the form that ``probe_summary`` reads.

    ``send(url)`` is one exchange: status, headers, body, version, timings (ttfb and total, ms) and, for https, tls (protocol, authorized, validTo).
    ``inside(host)`` says that a host must not be asked. ``error`` is blocked_internal_ip, too_many_redirects or network_error, else null.
    """
    now, chain, waited = url, [], 0.0
    out = {"asked": url, "dns": probe_dns(urlsplit(url).hostname or "", resolve), "redirects": chain, "error": None}
    while True:
        if inside and inside(urlsplit(now).hostname or ""):
            return out | {"url": now, "error": "blocked_internal_ip"}
        try:
            r = send(now)
        except Exception:  # noqa: BLE001 - a site that does not answer is a row
            return out | {"url": now, "error": "network_error"}
        head = {k.lower(): v for k, v in (r.get("headers") or {}).items()}
        timings = r.get("timings") or {}
        if 300 <= r["status"] < 400 and head.get("location"):
            if len(chain) + 1 >= hops:
                return out | {"url": now, "error": "too_many_redirects"}
            target = urljoin(now, head["location"])
            chain.append({"url": now, "status": r["status"], "location": target})
            waited += timings.get("total", 0.0)
            now = target
            continue
        body = r.get("body") or b""
        return out | {
            "url": now, "status": r["status"], "tls": r.get("tls"), "http": {"version": str(r.get("version", "1.1")).removesuffix(".0"), "encoding": head.get("content-encoding"), "keep_alive": head.get("connection", "").lower() != "close", "server": head.get("server")},
            "headers": head, "timing": timings | {"redirects": waited, "total": timings.get("total", 0.0) + waited}, "size": len(body.encode() if isinstance(body, str) else body),
        }


def probe_sites(urls: DataFrame, resolve: Callable[[str, str], list[str]], send: Callable[[str], dict], inside: Callable[[str], bool] | None = None, url: str = "url") -> DataFrame:
    """(url, probe): a probe of each url as JSON, made by all tasks."""
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"url": b[url], "probe": [json.dumps(probe_one(u, resolve, send, inside)) for u in b[url]]})

    return urls.select(url).mapInPandas(run, "url string, probe string")


def audit_sites(probes: DataFrame, now: Column) -> DataFrame:
    """(url, error, score, grade, issues) of probes: transport, headers, speed and addresses. A site without an answer has neither score nor grade."""
    from gossamer.operators.scoring import security_headers, transport_audit

    heads = F.from_json(F.get_json_object("probe", "$.headers"), "map<string,string>")
    rows = probes.select("url", F.get_json_object("probe", "$.error").alias("error"), probe_summary(F.col("probe")).alias("s"), heads.alias("h"))
    has = lambda name: F.coalesce(F.try_element_at("h", F.lit(name)).isNotNull(), F.lit(False))
    no = lambda c: F.coalesce(c, F.lit(False))
    score = F.coalesce(security_headers(F.coalesce("h", F.create_map().cast("map<string,string>"))).score, F.lit(0))
    a = transport_audit(F.col("s.tls"), no(F.col("s.https")), no(F.col("s.cert_ok")), days_left(F.col("s.valid_to"), now), score, has("strict-transport-security"), has("content-security-policy"), no(F.col("s.h2")), no(F.col("s.compressed")), F.col("s.ttfb"), F.col("s.redirects"), F.col("s.size"), F.col("s.ipv6"), F.col("s.ips"))
    return rows.withColumn("a", F.when(F.col("error").isNull(), a)).select("url", "error", "a.score", "a.grade", "a.issues")

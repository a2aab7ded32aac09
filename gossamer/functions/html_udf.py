"""Extraction that needs a document tree or JSON recursion: one Arrow-batched pass a page."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gossamer.functions.simhash import _WORD, simhashes
from gossamer.functions.url import normalize_one
from gossamer.session import bounded_batches, trimmed

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript", "iframe"}

PARSED = "noindex boolean, nofollow boolean, canonical string, links array<struct<url:string,weight:double>>, content_hash string, simhash bigint, unique_token_ratio double, jsonld int, jsonld_valid int, schema_types array<string>, title string, description string, h1s array<string>, images int, missing_alts int, blank_alts int, internal_links int, external_links int, nofollow_links int"

NAMES = [x.split()[0] for x in re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", PARSED)).split(", ")]


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.hidden = 0
        self.in_body = False
        self.robots, self.canonical = "", None
        self.anchors: list[tuple[str, str, float]] = []
        self.text: list[str] = []
        self.blocks: list[str] = []
        self.block: list[str] | None = None
        self.title: list[str] | None = None
        self.description: str | None = None
        self.h1s: list[list[str]] = []
        self.alts: list[str | None] = []

    def weight(self) -> float:
        tags = [t for t, _ in self.open]
        if "nav" in tags or "header" in tags:
            return 0.7
        if "footer" in tags:
            return 0.4
        near = " ".join(c for _, c in self.open[-2:]).lower()
        return 0.7 if "nav" in near or "menu" in near else 0.4 if "footer" in near else 1.0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("name", "").lower() == "robots":
            self.robots += " " + a.get("content", "").lower()
        elif tag == "link" and a.get("rel", "").lower() == "canonical" and self.canonical is None:
            self.canonical = a.get("href")
        elif tag == "a" and "href" in a:
            self.anchors.append((a["href"], a.get("rel", "").lower(), self.weight()))
        if tag == "meta" and a.get("name", "").lower() == "description" and self.description is None:
            self.description = a.get("content")
        elif tag == "title" and self.title is None:
            self.title = []
        elif tag == "h1":
            self.h1s.append([])
        elif tag == "img":
            self.alts.append(a.get("alt"))
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.block = []
        if tag == "body":
            self.in_body = True
        if tag not in VOID:
            self.open.append((tag, f"{a.get('class', '')} {a.get('id', '')}"))
            self.hidden += tag in HIDDEN

    def handle_endtag(self, tag):
        if tag == "script" and self.block is not None:
            self.blocks.append("".join(self.block))
            self.block = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.hidden -= sum(t in HIDDEN for t, _ in self.open[i:])
                del self.open[i:]
                break

    def handle_data(self, data):
        tags = [t for t, _ in self.open[-8:]]
        if self.title is not None and tags[-1:] == ["title"]:
            self.title.append(data)
        if "h1" in tags:
            self.h1s[-1].append(data)
        if self.block is not None:
            self.block.append(data)
        elif not self.hidden and self.in_body:
            self.text.append(data)


def schema_types(value) -> list[str]:
    """Every @type of a JSON-LD value, at any depth, in order."""
    out: list[str] = []
    if isinstance(value, list):
        for v in value:
            out += schema_types(v)
    elif isinstance(value, dict):
        t = value.get("@type")
        out += [t] if isinstance(t, str) else [x for x in t if isinstance(x, str)] if isinstance(t, list) else []
        for k, v in value.items():
            if k != "@type":
                out += schema_types(v)
    return out


def parse_page(html: str | None, base: str | None) -> dict:
    p = _Page()
    p.feed(html or "")
    p.close()
    directives = set(re.split(r"[,\s]+", p.robots))
    nofollow = bool(directives & {"nofollow", "none"})
    links: dict[str, float] = {}
    if not nofollow:
        for href, rel, w in p.anchors:
            url = None if "nofollow" in rel.split() else normalize_one(href, base)
            if url:
                links[url] = max(w, links.get(url, 0.0))
    flat = lambda parts: re.sub(r"\s+", " ", "".join(parts)).strip()
    text = flat(p.text)
    tokens = _WORD.findall(text.lower())
    # every anchor whose address can be normalised counts, also ones that are not followed
    found = [(normalize_one(href, base), rel.split()) for href, rel, _ in p.anchors]
    found = [(u, rel) for u, rel in found if u]
    own = _host(normalize_one(base, base) if base else None)
    inside = sum(_host(u) == own for u, _ in found)
    values = []
    for b in p.blocks:
        try:
            values.append(json.loads(b))
        except ValueError:
            pass
    return {
        "noindex": bool(directives & {"noindex", "none"}), "nofollow": nofollow, "canonical": normalize_one(p.canonical, base) if p.canonical else None,
        "links": [{"url": u, "weight": w} for u, w in links.items()], "content_hash": hashlib.sha256(text.encode()).hexdigest(), "text": text,
        "unique_token_ratio": len(set(tokens)) / len(tokens) if tokens else 0.0, "jsonld": len(p.blocks), "jsonld_valid": len(values), "schema_types": list(dict.fromkeys(schema_types(values))),
        "title": flat(p.title) or None if p.title is not None else None, "description": p.description, "h1s": [x for x in map(flat, p.h1s) if x],
        "images": len(p.alts), "missing_alts": sum(x is None for x in p.alts), "blank_alts": sum(x is not None and not x.strip() for x in p.alts),
        "internal_links": inside, "external_links": len(found) - inside, "nofollow_links": sum("nofollow" in rel for _, rel in found),
    }


def _host(url: str | None) -> str | None:
    host = urlsplit(url).hostname if url else None
    return host.removeprefix("www.") if host else None


def parse_html(html: Column, base: Column) -> Column:
    """What one pass over the document tree tells, as one struct: robots, canonical, weighted links,
    content hash, SimHash, JSON-LD types, title, description, first headings, image and link counts."""
    bounded_batches(SparkSession.active())

    @F.pandas_udf(PARSED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return trimmed(parsed)(batches)

    def parsed(batches):
        for h, b in batches:
            rows = [parse_page(x, y) for x, y in zip(h, b)]
            for r, value in zip(rows, simhashes([r.pop("text") for r in rows]).tolist()):
                r["simhash"] = value
            yield pd.DataFrame(rows, columns=NAMES)

    return run(html, base)

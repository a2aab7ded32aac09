"""Readers for spark.read.format: robots.txt files, sitemaps and exported graphs, a partition for each file.

``register(spark)`` makes them known. ``load(path)`` takes a file, a folder or several of them joined by commas, over any file
system that pyarrow knows. Filters on columns that are of a whole file, or that tell rows of a file apart early, are
pushed down: files that cannot match are not opened, and rows that do not match are not made.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition


@dataclass
class OneFile(InputPartition):
    path: str


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_files(paths: str) -> list[str]:
    """The files below some paths, without those that Spark hides (names with _ or . before them)."""
    from pyarrow import fs

    out = []
    for path in paths.split(","):
        system, inner = _system(path.strip())
        prefix = path.strip()[: len(path.strip()) - len(inner)] if path.strip().endswith(inner) else "file://"
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
        out += [prefix + i.path for i in found if i.type == fs.FileType.File and not re.search(r"/[._][^/]*$", i.path)]
    return sorted(out)


class FileReader(DataSourceReader):
    """Rows of files. ``exact`` names columns on which equality is pushed down, ``least`` those with a lower bound."""

    exact: tuple[str, ...] = ("file",)
    least: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.paths, self.options = options["path"], options
        self.equal: dict[str, object] = {}
        self.low: dict[str, float] = {}

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and name in self.exact and name not in self.equal:
                self.equal[name] = f.value
            elif isinstance(f, GreaterThanOrEqual) and name in self.least and name not in self.low:
                self.low[name] = f.value
            else:
                yield f

    def partitions(self) -> list[OneFile]:
        files = list_files(self.paths)
        return [OneFile(p) for p in files if self.equal.get("file", p) == p] or [OneFile("")]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        if not partition.path:
            return
        system, inner = _system(partition.path)
        with system.open_input_stream(inner) as f:
            text = f.read().decode("utf-8", "replace")
        yield from self.rows(partition.path, text)

    def rows(self, path: str, text: str) -> Iterator[tuple]:
        raise NotImplementedError

    def wanted(self, name: str, value) -> bool:
        return (name not in self.equal or self.equal[name] == value) and (name not in self.low or (value is not None and value >= self.low[name]))


class RobotsReader(FileReader):
    exact = ("file", "agent", "kind")

    def rows(self, path: str, text: str) -> Iterator[tuple]:
        """One row for each rule of each agent, crawl delay and sitemap, numbered as they stand."""
        agents: list[str] = []
        fresh, number = True, 0
        for line in text.splitlines():
            k, _, v = line.split("#", 1)[0].partition(":")
            k, v = k.strip().lower(), v.strip()
            if k == "user-agent":
                agents = [*agents, v.lower()] if fresh else [v.lower()]
                fresh = True
                continue
            if k == "sitemap":
                if self.wanted("kind", k) and self.wanted("agent", None):
                    yield path, number, None, k, v
                number += 1
            elif k in ("allow", "disallow", "crawl-delay") and v:
                for a in agents:
                    if self.wanted("kind", k) and self.wanted("agent", a):
                        yield path, number, a, k, v
                fresh = False
                number += 1
            elif k in ("allow", "disallow"):
                fresh = False


class SitemapReader(FileReader):
    exact = ("file", "kind")

    def rows(self, path: str, text: str) -> Iterator[tuple]:
        """The locs of a file: files of an index, else urls. What is no XML has none."""
        from xml.etree import ElementTree

        try:
            root = ElementTree.fromstring(text.strip())
        except ElementTree.ParseError:
            return
        local = lambda e: e.tag.rsplit("}", 1)[-1].lower() if isinstance(e.tag, str) else ""
        for kind in ("sitemap", "url"):
            locs = [(c.text or "").strip() for e in root.iter() if local(e) == kind for c in e if local(c) == "loc"]
            locs = [x for x in locs if x]
            if locs:
                if self.wanted("kind", kind):
                    yield from ((path, n, kind, loc) for n, loc in enumerate(locs))
                return


class GraphReader(FileReader):
    exact = ("file", "kind")
    least = ("weight",)

    def rows(self, path: str, text: str) -> Iterator[tuple]:
        """Nodes (url, depth, status) and edges (source, target, weight, 1.0 where there is none) of an exported graph."""
        graph = json.loads(text)
        if self.wanted("kind", "node") and self.wanted("weight", None):
            for n in graph.get("nodes") or []:
                yield path, "node", n.get("url"), n.get("depth"), n.get("status"), None, None, None
        if self.wanted("kind", "edge"):
            for e in graph.get("edges") or []:
                weight = 1.0 if e.get("weight") is None else float(e["weight"])
                if self.wanted("weight", weight):
                    yield path, "edge", None, None, None, e.get("source"), e.get("target"), weight


def _source(label: str, columns: str, kind: type[FileReader]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> FileReader:
            return kind(self.options)

    return Source


FORMATS = {
    "robots": ("file string, number int, agent string, kind string, value string", RobotsReader),
    "sitemap": ("file string, number int, kind string, loc string", SitemapReader),
    "graph-json": ("file string, kind string, url string, depth int, status int, source string, target string, weight double", GraphReader),
}


def register(spark: SparkSession) -> None:
    """Make robots, sitemap and graph-json formats of this session; filters reach them from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for label, (columns, kind) in FORMATS.items():
        spark.dataSource.register(_source(label, columns, kind))

"""Feeds and sitemaps as Spark data sources: ``spark.read.format("feed_files")`` and ``readStream``, by files.

Files are listed and read through Arrow's file systems, so a path can be local (and shared), HDFS or an object store. A
document is read as a stream of elements, so a large one takes little memory.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FEED = "file string, place int, title string, link string, date string, summary string"
SITEMAP = "file string, place int, kind string, loc string, lastmod string"


@dataclass
class Files(InputPartition):
    """The paths of one task."""

    paths: list[str]


def _listed(path: str) -> list[tuple[int, str, int]]:
    """(time, path, size) of a file, or of all files below a folder, in order of time; hidden ones are left out."""
    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    top = system.get_file_info(root)
    found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    own = [x for x in found if x.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in x.path[len(root) :].split("/"))]
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((x.mtime_ns or 0, scheme + x.path, x.size or 0) for x in own)


def _dealt(files: list[tuple[int, str, int]], size: int) -> list[Files]:
    """Files in groups of about ``size`` bytes; a larger one is a group of its own. At least one group, as Spark asks for one."""
    out, held = [], 0
    for _, path, n in files:
        if not out or held + n > size:
            out.append(Files([]))
            held = 0
        out[-1].paths.append(path)
        held += n
    return out or [Files([])]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _elements(path: str, wanted: tuple[str, ...]) -> Iterator[ET.Element]:
    """The elements of these names as they end. A document that breaks off gives those before the break."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    parser = ET.XMLPullParser(("start", "end"))
    inside, above = 0, []
    with system.open_input_stream(name) as stream:
        broken = False
        while not broken and (data := stream.read(1 << 16)):
            try:
                parser.feed(data)
            except ET.ParseError:
                broken = True
            try:
                for event, element in parser.read_events():
                    if event == "start":
                        above.append(element)
                        inside += _local(element.tag) in wanted
                        continue
                    above.pop()
                    if _local(element.tag) in wanted:
                        inside -= 1
                        if not inside:
                            yield element
                    if not inside and above:
                        above[-1].remove(element)  # what has been read needs no room
            except ET.ParseError:
                return


def _text(element: ET.Element, *names: str) -> str | None:
    for name in names:
        for child in element:
            if _local(child.tag) == name and (said := "".join(child.itertext()).strip()):
                return said
    return None


def _feed_rows(path: str) -> Iterator[tuple]:
    for place, item in enumerate(_elements(path, ("item", "entry"))):
        links = [c for c in item if _local(c.tag) == "link"]
        href = next((c.get("href") for c in links if c.get("href") and c.get("rel", "alternate") == "alternate"), None)
        yield path, place, _text(item, "title"), _text(item, "link") or href or _text(item, "guid", "id"), _text(item, "pubdate", "published", "updated", "date"), _text(item, "description", "summary", "encoded", "content")


def _sitemap_rows(path: str) -> Iterator[tuple]:
    for place, item in enumerate(_elements(path, ("url", "sitemap"))):
        yield path, place, _local(item.tag), _text(item, "loc"), _text(item, "lastmod", "publication_date")


class _Reader(DataSourceReader):
    def __init__(self, rows, options):
        self.rows, self.path, self.size = rows, options["path"], int(options.get("bytesPerTask", 32_000_000))

    def partitions(self) -> list[Files]:
        return _dealt(_listed(self.path), self.size)

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self.rows(path)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the time and path of the last file that went in; files come in by time, so each has to be whole when it gets its name."""

    def __init__(self, rows, options):
        self.rows, self.path, self.size = rows, options["path"], int(options.get("bytesPerTask", 32_000_000))

    def initialOffset(self) -> dict:
        return {"time": "-1", "path": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.path)
        return {"time": str(files[-1][0]), "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((int(x["time"]), x["path"]) for x in (start, end))
        return _dealt([f for f in _listed(self.path) if low < f[:2] <= high], self.size)

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self.rows(path)


class FeedFiles(DataSource):
    """RSS and Atom files: a row for each item, with its file and place in it. Options: path, bytesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "feed_files"

    def schema(self) -> str:
        return FEED

    def reader(self, schema) -> _Reader:
        return _Reader(_feed_rows, self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(_feed_rows, self.options)


class SitemapFiles(FeedFiles):
    """Sitemap files: a row for each location, of a page (``url``) or of another sitemap."""

    @classmethod
    def name(cls) -> str:
        return "sitemap_files"

    def schema(self) -> str:
        return SITEMAP

    def reader(self, schema) -> _Reader:
        return _Reader(_sitemap_rows, self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(_sitemap_rows, self.options)


def register(spark: SparkSession) -> None:
    for source in (FeedFiles, SitemapFiles):
        spark.dataSource.register(source)

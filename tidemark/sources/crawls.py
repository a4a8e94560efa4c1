"""Finished crawls as a data source, in batch and as a stream.

A crawl is a folder ``<path>/<crawl_id>`` with its pages as JSON lines under ``pages`` and one JSON line of flags under
``flags``; it is finished when its flags are there.  Crawl ids sort in the order in which crawls finish.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGE = "page_id long, url string, page_type string, status_code int, fetched_at string, html string, render_mode string, duration_ms int, discovery_score double"
FLAGS = "root_url string, has_sitemap boolean, has_robots_txt boolean, sitemap_url_count int, blocked_by_robots int"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
_FIELDS = [tuple(f.split()) for f in f"crawl_id string, {PAGE}, {FLAGS}".split(", ")]
#: Pages in one Arrow batch.
ROWS = 256


@dataclass
class PagesFile(InputPartition):
    """One file of a crawl's pages."""

    crawl_id: str
    path: str
    flags: str


class _Crawls:
    """The finished crawls under a folder, and their files."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")

    def _list(self, *names: str) -> list[arrow_fs.FileInfo]:
        fs, root = arrow_fs.FileSystem.from_uri("/".join((self.uri, *names)))
        return sorted((f for f in fs.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)) if not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)

    def finished(self, after: str = "", upto: str | None = None) -> list[str]:
        names = [f.base_name for f in self._list() if f.base_name > after and (upto is None or f.base_name <= upto)]
        return [n for n in names if any(f.size for f in self._list(n, "flags"))]

    def files(self, crawls: list[str]) -> list[PagesFile]:
        fs, _ = arrow_fs.FileSystem.from_uri(self.uri)
        out = []
        for name in crawls:
            with fs.open_input_stream(next(f.path for f in self._list(name, "flags") if f.size)) as file:
                flags = file.read().decode().strip()
            out += [PagesFile(name, f.path, flags) for f in self._list(name, "pages") if f.size]
        return out

    def rows(self, part: PagesFile | None) -> Iterator[pa.RecordBatch]:
        """A file's pages, a few at a time, with their crawl's flags; none for None, which stands for no file at all."""
        if part is None:
            return
        fs, _ = arrow_fs.FileSystem.from_uri(self.uri)
        schema = pa.schema([(name, _KINDS[kind]) for name, kind in _FIELDS])
        more = json.loads(part.flags) | {"crawl_id": part.crawl_id}
        held: list[dict] = []
        with fs.open_input_stream(part.path) as raw, pa.PythonFile(raw, "r") as file:
            for line in _lines(file):
                held.append(json.loads(line) | more)
                if len(held) == ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


def _lines(file, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while block := file.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from filter(None, whole)
    if rest:
        yield rest


class CrawlReader(DataSourceReader):
    def __init__(self, uri: str):
        self.crawls = _Crawls(uri)

    def partitions(self) -> list[PagesFile]:
        return self.crawls.files(self.crawls.finished())

    def read(self, partition: PagesFile) -> Iterator[pa.RecordBatch]:
        return self.crawls.rows(partition)


class CrawlStreamReader(DataSourceStreamReader):
    """Offsets are the last crawl that was read."""

    def __init__(self, uri: str):
        self.crawls, self.last = _Crawls(uri), ""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        self.last = max(self.crawls.finished(self.last), default=self.last)
        return {"after": self.last}

    def partitions(self, start: dict, end: dict) -> list[PagesFile]:
        return self.crawls.files(self.crawls.finished(start["after"], end["after"])) if end["after"] > start["after"] else []

    def read(self, partition: PagesFile) -> Iterator[pa.RecordBatch]:
        return self.crawls.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class CrawlSource(DataSource):
    """``spark.dataSource.register(CrawlSource)``, then ``spark.read`` or ``spark.readStream`` of format ``crawls`` with a path."""

    @classmethod
    def name(cls) -> str:
        return "crawls"

    def schema(self) -> str:
        return ", ".join(" ".join(f) for f in _FIELDS)

    def reader(self, schema) -> CrawlReader:
        return CrawlReader(self.options["path"])

    def streamReader(self, schema) -> CrawlStreamReader:  # noqa: N802
        return CrawlStreamReader(self.options["path"])


def write_crawl(pages: DataFrame, path: str, crawl_id: str, flags: dict) -> None:
    """Store ``pages`` (with any of the columns of ``PAGE``) as a finished crawl; ``flags`` has those of ``FLAGS`` that are known."""
    pages.write.mode("overwrite").json(f"{path}/{crawl_id}/pages")
    rows = pages.sparkSession.createDataFrame([tuple(flags.get(f.split()[0]) for f in FLAGS.split(", "))], FLAGS)
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/{crawl_id}/flags")

"""Harvests of paged services as a Spark source: tables and resumable streams of records.

A fetcher lands the pages of a harvest in a folder, one file for each, named by the
page's number and the token that asked for it: ``00000003~<token, URL-quoted>.xml``.
The first token is empty.  Each sub-folder is a harvest of its own: a set, a venue,
a day.  ``spark.read`` and ``spark.readStream`` of the format ``paged`` give one row
for each record, and the offsets of a stream are how many pages of each harvest have
been taken.  So a stream that was stopped goes on at the page it would have read
next, and gives the records of a page once.

Offsets come from names alone; the pages are read by the executors, one task for
each.  A page says itself which token comes next; the task holds it against the name
of the page that follows, and the first page of a batch against the one before, so pages that are missing, swapped or left over from
another harvest fail the read instead of passing as data, as does a page that
reports an error.

Three protocols: ``oai`` (XML, ``resumptionToken``), ``notes`` (JSON, offsets; a
short page is the last) and ``bulk`` (JSON, ``token``).
"""

from __future__ import annotations

import json
import posixpath
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import landing

SCHEMA = "harvest string, page int, place int, value string"
#: Records of a page of notes that isn't the last, unless an option says otherwise.
NOTES_A_PAGE = 1000
_NAME = re.compile(r"^(\d+)~([^~]*)\.(?:xml|json)$")
_OAI = "{http://www.openarchives.org/OAI/2.0/}"


class BrokenHarvest(ValueError):
    """Pages that don't follow each other, or a page that reports an error."""


@dataclass
class Page(InputPartition):
    """A page; the token in the name of the page behind it, None if there is none yet; and the page before it, where another batch read that."""

    harvest: str
    number: int
    token: str
    path: str
    follows: str | None
    before: str | None


# --- protocols: of a page's bytes its records and the next token, "" at the end ---


def oai(raw: bytes, page: Page, options: dict) -> tuple[list[str], str]:
    root = ET.fromstring(raw)
    error = root.find(f"{_OAI}error")
    if error is not None:
        raise BrokenHarvest(f"{page.path}: {error.get('code')}: {(error.text or '').strip()}")
    records = root.find(f"{_OAI}ListRecords")
    if records is None:
        return [], ""
    token = records.find(f"{_OAI}resumptionToken")
    plain = lambda e: re.sub(r"<(/?)(?:\w+:)", r"<\1", re.sub(r'\sxmlns(:\w+)?="[^"]*"', "", ET.tostring(e, encoding="unicode"))).strip()
    return [plain(r) for r in records.findall(f"{_OAI}record")], (token.text or "").strip() if token is not None else ""


def _json(raw: bytes, page: Page, field: str) -> tuple[dict, list[str]]:
    body = json.loads(raw)
    if not isinstance(body, dict) or not isinstance(body.get(field), list):
        said = body.get("message") or body.get("error") or body.get("errors") if isinstance(body, dict) else None
        raise BrokenHarvest(f"{page.path}: {said or f'no list {field!r}'}")
    return body, [json.dumps(r, ensure_ascii=False) for r in body[field]]


def notes(raw: bytes, page: Page, options: dict) -> tuple[list[str], str]:
    _, rows = _json(raw, page, "notes")
    size = int(options.get("page_size", NOTES_A_PAGE))
    return rows, str(int(page.token or 0) + size) if len(rows) >= size else ""


def bulk(raw: bytes, page: Page, options: dict) -> tuple[list[str], str]:
    body, rows = _json(raw, page, "data")
    return rows, str(body.get("token") or "")


PROTOCOLS: dict[str, Callable[[bytes, Page, dict], tuple[list[str], str]]] = {"oai": oai, "notes": notes, "bulk": bulk}


class _Harvests:
    """The folder of harvests: what has landed, and the reading of a page."""

    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.protocol = self.options.get("protocol", "")
        if self.protocol not in PROTOCOLS:
            raise ValueError(f"option protocol must be one of {', '.join(PROTOCOLS)}")
        self.files, self.root = pafs.FileSystem.from_uri(self.options["path"])

    def landed(self) -> dict[str, list[tuple[int, str, str]]]:
        """Of each harvest its pages from the first on, as (number, token, path), up to the first that is missing."""
        found: dict[str, list[tuple[int, str, str]]] = {}
        for info in self.files.get_file_info(pafs.FileSelector(self.root, recursive=True)):
            name = _NAME.match(info.base_name)
            if name and info.type == pafs.FileType.File:
                harvest = posixpath.relpath(posixpath.dirname(info.path), self.root)
                found.setdefault(harvest, []).append((int(name[1]), unquote(name[2]), info.path))
        out = {}
        for harvest, pages in found.items():
            pages.sort()
            if len({n for n, _, _ in pages}) < len(pages):
                raise BrokenHarvest(f"{harvest}: two pages of one number")
            run = [p for i, p in enumerate(pages) if p[0] == i]
            if run:
                out[harvest] = run
        return out

    def pages(self, start: dict, end: dict | None) -> list[Page]:
        out = []
        for harvest, run in sorted(self.landed().items()):
            begin = start.get(harvest, 0)
            stop = len(run) if end is None else end.get(harvest, begin)
            if stop > len(run):
                raise BrokenHarvest(f"{harvest}: pages that were there are gone")
            if run[0][1]:
                raise BrokenHarvest(f"{harvest}: the first page was asked for with a token")
            for number, token, path in run[begin:stop]:
                before = run[number - 1][2] if number == begin > 0 else None
                out.append(Page(harvest, number, token, path, run[number + 1][1] if number + 1 < len(run) else None, before))
        return out

    def _parsed(self, path: str, token: str, page: Page) -> tuple[list[str], str]:
        with self.files.open_input_stream(path) as f:
            rows, following = PROTOCOLS[self.protocol](f.read(), replace(page, path=path, token=token), self.options)
        return rows, following

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        if page.before is not None:
            asked = unquote(_NAME.match(posixpath.basename(page.before))[2])
            self._follows(page.before, self._parsed(page.before, asked, page)[1], page.token)
        rows, following = self._parsed(page.path, page.token, page)
        if page.follows is not None:
            self._follows(page.path, following, page.follows)
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([page.harvest] * n, pa.string()), pa.array([page.number] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(rows, pa.string())], names=["harvest", "page", "place", "value"])

    @staticmethod
    def _follows(path: str, said: str, there: str) -> None:
        if said != there:
            raise BrokenHarvest(f"{path}: the next page is {said!r}, but {there!r} follows" if said else f"{path}: pages follow the last one")


class _Table(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.harvests = _Harvests(options)

    def partitions(self) -> list[Page]:
        return self.harvests.pages({}, None)

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return self.harvests.read(partition) if partition is not None else iter(())  # None: a table without pages


class _Stream(DataSourceStreamReader):
    """Offsets: of each harvest the number of pages taken."""

    def __init__(self, options: dict) -> None:
        self.harvests = _Harvests(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {harvest: len(run) for harvest, run in sorted(self.harvests.landed().items())}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.harvests.pages(start, end)

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return self.harvests.read(partition)

    def commit(self, end: dict) -> None:
        return None


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Table:  # noqa: ANN001
        return _Table(self.options)

    def streamReader(self, schema) -> _Stream:  # noqa: ANN001, N802
        return _Stream(self.options)


def records(spark: SparkSession, path: str, protocol: str, stream: bool = False, **options: str) -> DataFrame:
    """``harvest, page, place, value`` of all records below ``path``; ``value`` is the record as XML or JSON."""
    spark.dataSource.register(PagedSource)
    reader = (spark.readStream if stream else spark.read).format("paged").option("protocol", protocol)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


# --- connectors: a protocol and the way from its records to papers ---


def _from_oai(rows: DataFrame, **_: object) -> DataFrame:
    # Fields of a record stand in its header and its one metadata element.
    schema = f"header struct<identifier:string,_status:string>, metadata struct<arXiv:struct<{', '.join(x.replace(' ', ':', 1) for x in landing.OAI.split(', ')[1:-1])}, {landing.OAI.split(', ')[-1].replace(' ', ':', 1)}>>"
    parsed = rows.select(F.from_xml("value", schema).alias("r"))
    return landing.oai_papers(parsed.select("r.header", "r.metadata.arXiv.*"))


def _from_notes(rows: DataFrame, venue: str = "", rank: str = "", year: int = 0) -> DataFrame:
    return landing.note_papers(rows, venue, rank, year)


def _from_bulk(rows: DataFrame, **_: object) -> DataFrame:
    return landing.record_papers(rows.select(F.from_json("value", landing.RECORD).alias("r")).select("r.*"))


@dataclass(frozen=True)
class Connector:
    """What every source of papers offers: its name, and papers of landed harvests, as a table or a stream."""

    name: str
    protocol: str
    mapped: Callable[..., DataFrame]

    def papers(self, spark: SparkSession, path: str, stream: bool = False, options: dict[str, str] | None = None, **given: object) -> DataFrame:
        return self.mapped(records(spark, path, self.protocol, stream, **(options or {})), **given)


CONNECTORS = {c.name: c for c in (Connector("arxiv", "oai", _from_oai), Connector("openreview", "notes", _from_notes), Connector("s2", "bulk", _from_bulk))}

"""A folder of list documents as a data source, in batch and as a stream.

`register(spark)`, then `spark.read.format("list_documents").load(folder)` or `readStream`. Every document is a partition. A stream's offset says which state of each document was read, so a
later run reads changed and new documents only; a batch read can be told the same by the option `known`.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from larkspur.session import travels
from larkspur.sources import documents
from larkspur.sources.documents import markdown_rows

SCHEMA = "document string, line int, company string, title string, location string, url string, closed boolean, etag string"
#: Bytes that one document and all documents of a read may have.
DOCUMENT_BYTES, SOURCE_BYTES = 8 << 20, 64 << 20
# The roles that the section layout abbreviates.
ROLES = {"QD": "Quantitative Developer Intern", "QR": "Quantitative Research Intern", "QT": "Quantitative Trading Intern", "SWE": "Software Engineering Intern", "HW": "Hardware Engineering Intern"}
_LINK = re.compile(r"\[([^\]]*)\]\((https?://[^\s)]+)\)", re.I)
_BARE = re.compile(r"https?://[^\s<>\"')\]]+", re.I)
_CLOSED = re.compile(r"\b(?:closed|inactive|filled|expired)\b|\U0001f512", re.I)


def _plain(text: str) -> str:
    """A cell without tags, link targets and emphasis, blanks squeezed."""
    text = re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", re.sub(r"<[^>]*>", " ", text))
    return " ".join(html.unescape(re.sub(r"[*_`]", "", text)).split())


def _usable(url: str) -> str | None:
    """The address, if it has a host."""
    url = html.unescape(url)
    try:
        return url if urlsplit(url).hostname else None
    except ValueError:
        return None


def table_listings(text: str) -> Iterator[tuple]:
    """line, company, title, location, url, closed of each row of pipe tables; an arrow in the company column repeats the one above in its table."""
    number, company = 0, None
    for table, line, header, cells in markdown_rows(text):
        names = [h.lower() for h in header]
        cell = lambda *wanted, n=names, c=cells: next((c[n.index(w)] for w in wanted if w in n), "")
        if table != number:
            number, company = table, None
        said = _plain(cell("company"))
        company = company if said in ("", "↳") else said
        apply = cell("apply", "application", "link")
        found = _BARE.search(apply)
        yield line, company, _plain(cell("role", "position", "title")), _plain(cell("location")), found and _usable(found[0]), bool(_CLOSED.search(" ".join(cells)))


def section_listings(text: str) -> Iterator[tuple]:
    """As above for companies as headings, their locations in a line of their own, and rows of a role and its links: a listing for each link."""
    company, location = "", "Unspecified"
    for line, said in enumerate(text.replace("\r", "").split("\n"), 1):
        if m := re.match(r"##\s+(.+?)\s*$", said):
            company, location = _plain(m[1]), "Unspecified"
        elif m := re.match(r"\*\*Locations\*\*:\s*(.+?)\s*$", said, re.I):
            location = _plain(m[1]) or "Unspecified"
        elif company and (m := re.match(r"\|\s*([^|]+?)\s*\|\s*(.+?)\s*\|\s*$", said)):
            role = _plain(m[1])
            if role.lower() == "role" or re.fullmatch(r"[\s:-]+", m[1]):
                continue
            for label, url in _LINK.findall(m[2]):
                special = re.sub(r"[✅❌]", "", _plain(label)).strip()
                special = "" if special.lower() == "apply" else special
                title = ROLES.get(role.upper(), f"{role} Intern") + (f" — {special}" if special else "")
                if address := _usable(url):
                    yield line, company, title, location, address, bool(_CLOSED.search(f"{m[1]} {m[2]}"))


LAYOUTS = {"table": table_listings, "sections": section_listings}


@dataclass
class Document(InputPartition):
    """One document: its path in the store, its name below the folder, and the state that is to be read."""

    path: str
    name: str
    etag: str


class _Folder:
    """Which documents there are and how they read; any store that pyarrow can name."""

    def __init__(self, options: dict[str, str]):
        if options.get("layout", "table") not in LAYOUTS:
            raise ValueError(f"layout is one of {', '.join(LAYOUTS)}")
        self.folder, self.layout, self.suffix = options["path"], options.get("layout", "table"), options.get("suffix", "")
        self.most, self.most_all = int(options.get("documentBytes", DOCUMENT_BYTES)), int(options.get("sourceBytes", SOURCE_BYTES))

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder)

    def listed(self) -> dict[str, fs.FileInfo]:
        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = lambda name: any(p[:1] in "._" for p in name.split("/"))
        by_name = {f.path.removeprefix(root.rstrip("/") + "/"): f for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix)}
        return {n: f for n, f in sorted(by_name.items()) if not hidden(n)}

    def states(self) -> dict[str, str]:
        """Each document's etag: its time of change and its size."""
        return {n: f"{f.mtime_ns}-{f.size}" for n, f in self.listed().items()}

    def changed(self, known: dict[str, str], now: dict[str, str]) -> list[Document]:
        root, sizes = self._store()[1].rstrip("/"), {n: int(e.rpartition("-")[2]) for n, e in now.items() if known.get(n) != e}
        if large := [n for n, s in sizes.items() if s > self.most]:
            raise ValueError(f"{large[0]} has more than {self.most} bytes")
        if sum(sizes.values()) > self.most_all:
            raise ValueError(f"the documents have more than {self.most_all} bytes")
        return [Document(f"{root}/{n}", n, now[n]) for n in sizes]

    def rows(self, document: Document) -> Iterator[tuple]:
        """A document's listings; it must still be in the state that was planned, so that one read never mixes two."""
        store, _ = self._store()
        info = store.get_file_info(document.path)
        if f"{info.mtime_ns}-{info.size}" != document.etag:
            raise RuntimeError(f"{document.name} changed while it was read")
        with store.open_input_stream(document.path) as stream:
            text = stream.read().decode("utf-8", "replace")
        for row in LAYOUTS[self.layout](text):
            yield (document.name, *row, document.etag)


class ListReader(_Folder, DataSourceReader):
    """All documents, or those whose state isn't the one that the option `known` (JSON, name to etag) gives."""

    def __init__(self, options: dict[str, str]):
        _Folder.__init__(self, options)
        self.known = json.loads(options.get("known", "{}"))

    def partitions(self) -> list[Document]:
        return self.changed(self.known, self.states())

    def read(self, partition: Document) -> Iterator[tuple]:
        yield from self.rows(partition) if partition else ()


class ListStream(_Folder, DataSourceStreamReader):
    """Documents whose state isn't that of the last offset. One that is gone yields nothing, one that comes back unchanged neither."""

    def initialOffset(self) -> dict[str, str]:
        return {}

    def latestOffset(self) -> dict[str, str]:
        return self.states()

    def partitions(self, start: dict[str, str], end: dict[str, str]) -> list[Document]:
        return self.changed(start, end)

    def read(self, partition: Document) -> Iterator[tuple]:
        yield from self.rows(partition)

    def commit(self, end: dict[str, str]) -> None:
        pass


class ListDocuments(DataSource):
    """Options: path (folder), layout (table or sections), suffix of the documents' names, known, documentBytes, sourceBytes.

    A document or a read beyond its bytes fails as a whole, so that a list is never seen in part. Rows: SCHEMA; a row
    without a usable address has a null url.
    """

    @classmethod
    def name(cls) -> str:
        return "list_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListReader:
        return ListReader(self.options)

    def streamReader(self, schema) -> ListStream:
        return ListStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known. Its code travels with it, as the workers that plan a read don't see files added to a session."""
    travels(__name__, documents.__name__)
    spark.dataSource.register(ListDocuments)

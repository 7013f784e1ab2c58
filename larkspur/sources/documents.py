"""Tables in list documents, as table functions: one row of cells for each data row of a document."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_SEPARATOR = re.compile(r":?-{1,}:?")
_CELL = re.compile(r"(?<!\\)\|")
_TAGS = re.compile(r"<(/?)(table|tr|th|td)\b[^>]*>", re.I)
ROWS = "table_no int, line int, header array<string>, cells array<string>"


def _cells(line: str) -> list[str]:
    inner = line.strip().removeprefix("|")
    inner = inner[:-1] if inner.endswith("|") and not inner.endswith("\\|") else inner
    return [c.strip().replace("\\|", "|") for c in _CELL.split(inner)]


def markdown_rows(text: str | None) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """Table number, line (from 1), header and cells of each row of a text's pipe tables whose number of cells is the header's."""
    lines = (text or "").split("\n")
    number, i = 0, 0
    while i + 1 < len(lines):
        if "|" in lines[i] and "|" in lines[i + 1] and all(_SEPARATOR.fullmatch(c) for c in _cells(lines[i + 1])):
            header = _cells(lines[i])
            number, i = number + 1, i + 2
            while i < len(lines) and "|" in lines[i]:
                cells = _cells(lines[i])
                if len(cells) == len(header):
                    yield number, i + 1, header, cells
                i += 1
        else:
            i += 1


@udtf(returnType=ROWS)
class MarkdownTables:
    """Pipe tables: a header, a separator, and the rows whose number of cells is the header's. Lines count from 1."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from markdown_rows(text)


@udtf(returnType=ROWS)
class HtmlTables:
    """HTML tables in one pass over their tags; a row's line comes from counting breaks as the pass goes on, so long documents cost in proportion."""

    def eval(self, text: str) -> Iterator[tuple]:
        text = text or ""
        number, header, cells, cell, row_line, line, seen, is_header = 0, None, None, None, 0, 1, 0, False
        for m in _TAGS.finditer(text):
            line += text.count("\n", seen, m.start())
            seen = m.start()
            closing, tag = bool(m[1]), m[2].lower()
            if tag == "table" and not closing:
                number, header = number + 1, None
            elif tag == "tr" and not closing:
                cells, row_line, is_header = [], line, True
            elif tag in ("td", "th"):
                if closing and cell is not None and cells is not None:
                    cells.append(html.unescape(re.sub(r"<[^>]+>", " ", text[cell : m.start()])).strip())
                    cell = None
                elif not closing:
                    cell, is_header = m.end(), is_header and tag == "th"
            elif tag == "tr" and closing and cells is not None:
                if header is None and is_header:
                    header = cells
                elif header is not None and len(cells) == len(header):
                    yield number, row_line, header, cells
                cells = None


def scan(docs: DataFrame, text: str, kind: str = "markdown") -> DataFrame:
    """The rows of all tables of each document, with the document's other columns."""
    table = MarkdownTables if kind == "markdown" else HtmlTables
    return docs.lateralJoin(table(F.col(text).outer()))


def column(names: list[str]) -> Column:
    """The cell under the first header that is one of the names, case folded."""
    at = F.expr("filter(sequence(1, size(header)), i -> array_contains(array(" + ",".join(f"'{n.lower()}'" for n in names) + "), lower(header[i - 1])))[0]")
    return F.when(at.isNotNull(), F.try_element_at("cells", at))


def listings(docs: DataFrame, doc: str, text: str, kind: str = "markdown") -> DataFrame:
    """Company, role, location, link, closed of each row; an arrow in the company column repeats the one above in its table."""
    rows = scan(docs, text, kind).select(doc, "table_no", "line", column(["company"]).alias("c"), column(["role", "position", "title"]).alias("role"), column(["location"]).alias("location"), column(["apply", "application", "link"]).alias("apply"))
    w = Window.partitionBy(doc, "table_no").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("company", F.last(F.when(~F.trim("c").isin("↳", ""), F.regexp_replace("c", r"[*_`]|\[|\]\([^)]*\)", "")), ignorenulls=True).over(w))
    link = F.regexp_extract("apply", r"(https?://[^\s<>\"')\]]+)", 1)
    return carried.select(doc, "table_no", "line", "company", "role", "location", F.nullif(link, F.lit("")).alias("url"), F.col("apply").rlike("🔒|(?i)closed").alias("closed"))

"""Readers of source documents: HTML tables, workbooks, JSON results, table dumps, checked CSV and text pages.

Parsers of formats that Spark cannot read run per document in Arrow batches; each document is worked on by itself.
"""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType


class _Tables(HTMLParser):
    """Cells of tables as (table, row, cells); tables inside cells are tables of their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, list[str]]] = []
        self.open: list[list] = []  # [number, rows so far, cells or None, text parts or None]
        self.n = 0

    def _end_cell(self, t):
        if t[3] is not None:
            t[2].append(" ".join("".join(t[3]).split()))
            t[3] = None

    def _end_row(self, t):
        self._end_cell(t)
        if t[2] is not None:
            self.rows.append((t[0], t[1], t[2]))
            t[1] += 1
            t[2] = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([self.n, 0, None, None])
            self.n += 1
        elif self.open and tag == "tr":
            self._end_row(self.open[-1])
            self.open[-1][2] = []
        elif self.open and tag in ("td", "th"):
            t = self.open[-1]
            self._end_cell(t)
            if t[2] is None:
                t[2] = []
            t[3] = []

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag == "table":
            self._end_row(self.open.pop())
        elif tag == "tr":
            self._end_row(self.open[-1])
        elif tag in ("td", "th"):
            self._end_cell(self.open[-1])

    def handle_data(self, data):
        if self.open and self.open[-1][3] is not None:
            self.open[-1][3].append(data)


def _per_document(df: DataFrame, id_col: str, content_col: str, parse, schema: str) -> DataFrame:
    """Rows of ``parse(content)`` for each document, with its id in front."""
    kind = df.schema[id_col].dataType.simpleString()
    whole = pa.schema([("doc", to_arrow_type(df.schema[id_col].dataType)), *to_arrow_schema(StructType.fromDDL(schema))])

    def run(batches):
        for batch in batches:
            rows = [(doc, *row) for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if content is not None for row in parse(content)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(whole)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, whole, strict=True)], schema=whole)

    return df.select(id_col, content_col).mapInArrow(run, f"doc {kind}, {schema}")


def html_tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(doc, table, row, cells): the text of every cell, white space collapsed; numbers count from 0."""

    def parse(html: str):
        reader = _Tables()
        reader.feed(html)
        reader.close()
        while reader.open:
            reader._end_row(reader.open.pop())
        return reader.rows

    return _per_document(pages, id_col, html_col, parse, "table bigint, row bigint, cells array<string>")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def workbook_cells(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(doc, sheet, cell, value, formula) of every cell that has a value; shared and inline strings are resolved."""

    def parse(content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            names = book.namelist()
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
            for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n)):
                for cell in ElementTree.fromstring(book.read(name)).iter(f"{_SHEET}c"):
                    value, formula = cell.find(f"{_SHEET}v"), cell.find(f"{_SHEET}f")
                    if cell.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                    elif value is None:
                        continue
                    else:
                        text = shared[int(value.text)] if cell.get("t") == "s" else value.text
                    yield name.removeprefix("xl/worksheets/").removesuffix(".xml"), cell.get("r"), text, None if formula is None else formula.text

    return _per_document(files, id_col, content_col, parse, "sheet string, cell string, value string, formula string")


def dump_rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, table, columns, cells) of the COPY blocks of plain table dumps; ``\\N`` is null."""

    def parse(text: str):
        name = None
        for line in text.split("\n"):
            if name is None:
                if head := re.fullmatch(r"COPY ([\w.]+) \(([^)]*)\) FROM stdin;", line):
                    name, columns = head[1], [c.strip() for c in head[2].split(",")]
            elif line == "\\.":
                name = None
            else:
                yield name, columns, [None if c == "\\N" else c for c in line.split("\t")]

    return _per_document(texts, id_col, text_col, parse, "table string, columns array<string>, cells array<string>")


def json_results(texts: DataFrame, id_col: str, json_col: str, rows_path: str, row_schema: str) -> DataFrame:
    """(doc, index, row): the rows of a JSON array below ``rows_path``, addressed by their place from 0."""
    rows = F.from_json(F.get_json_object(json_col, rows_path), f"array<{row_schema}>")
    return texts.select(F.col(id_col).alias("doc"), F.posexplode(rows).alias("index", "row"))


def located_row(json_text: str, index: int) -> tuple[int, int] | None:
    """Start and end of row ``index`` of the first array in a JSON text, in characters; None if there is none."""
    import json

    decoder, at = json.JSONDecoder(), json_text.find("[") + 1
    if not at:
        return None
    for n in range(index + 1):
        while at < len(json_text) and json_text[at] in " \t\r\n,":
            at += 1
        if at >= len(json_text) or json_text[at] == "]":
            return None
        _, end = decoder.raw_decode(json_text, at)
        if n == index:
            return at, end
        at = end
    return None


def checked_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file whose header must name exactly the columns of ``schema``, in order; a malformed row is an error."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")


def page_lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, page, line, text) of extracted text: form feeds part pages, numbers count from 1 and 0."""
    pages = texts.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\f")).alias("page", "body"))
    return pages.select("doc", (F.col("page") + 1).alias("page"), F.posexplode(F.split("body", "\n")).alias("line", "text"))


def bounded_layout(lines: DataFrame, row_pattern: str, fields: list[str]) -> DataFrame:
    """Candidates of a text layout: each line as (raw, fields, parse_status, unresolved): parsed where the whole line matches
    ``row_pattern`` (one group a field, an empty group is null), blank lines left out, others unresolved."""
    parts = F.create_map(*(x for i, f in enumerate(fields) for x in (F.lit(f), F.nullif(F.regexp_extract("text", row_pattern, i + 1), F.lit("")))))
    whole = F.col("text").rlike(f"^(?:{row_pattern})$")
    return lines.where(F.trim("text") != "").select(
        *[c for c in lines.columns if c != "text"], F.col("text").alias("raw"), F.when(whole, parts).alias("fields"),
        F.when(whole, "parsed").otherwise("unresolved").alias("parse_status"), F.when(~whole, F.array(F.lit("no-row-match"))).otherwise(F.array().cast("array<string>")).alias("unresolved"),
    )


def strict_utf8(files: DataFrame, content_col: str) -> DataFrame:
    """text and quarantined: bytes that are no UTF-8 have no text and are set apart, never replaced."""
    text = F.try_validate_utf8(F.col(content_col).cast("string"))
    return files.withColumn("text", text).withColumn("quarantined", F.col(content_col).isNotNull() & F.col("text").isNull())

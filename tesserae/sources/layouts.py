"""Layouts of extracted text as data, and one pass over documents for all of them.

A layout is a finite-state transducer over the lines of a document: in each state an ordered list of rules, each a
pattern with an action and the state it leads to. Layouts are tables (``rules_of`` reads them from rows); adding one adds rows, not
code. A document is one row and one unit of work, whatever its layout; its lines come out as rows, each with what became of it, so
that the accounting of a document sums to its lines.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a rule does with its line: begin a section (its groups hold for the rows after it), emit a row, set the status of the next or the last row,
#: go on with the last row, pass over a line that is known not to be a row.
ACTIONS = ("section", "row", "status-ahead", "status-behind", "more", "skip")
#: A status ahead of a row holds for so many lines.
NEAR = 2


@dataclass(frozen=True)
class Rule:
    """``pattern`` must match the whole line. A row takes its named groups as fields; with ``columns`` it is split at two
    spaces or more instead, and has a field for each column, in order. ``checks`` (field, pattern, reason) must hold for a row
    to be parsed; a missing field fails."""

    state: str
    pattern: str
    action: str
    goes_to: str
    columns: tuple[str, ...] = ()
    checks: tuple[tuple[str, str, str], ...] = ()


@dataclass(frozen=True)
class Layout:
    """``marks`` must all stand on the first page of a document, and its sha256 must be one of ``bound`` if any is given."""

    name: str
    marks: tuple[str, ...]
    rules: tuple[Rule, ...]
    bound: tuple[str, ...] = ()
    expected: dict[str, int] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        states = {r.state for r in self.rules}
        for r in self.rules:
            re.compile(r.pattern)
            if r.action not in ACTIONS or r.goes_to not in states:
                raise ValueError(f"layout {self.name}: rule {r.pattern!r} has an unknown action or state")
        if "start" not in states:
            raise ValueError(f"layout {self.name} has no state start")


def rules_of(rows: Iterable[dict]) -> list[Layout]:
    """Layouts from table rows (layout, marks, state, pattern, action, goes_to, columns, checks), in the order of the rows."""
    found: dict[str, dict] = {}
    for r in rows:
        own = found.setdefault(r["layout"], {"marks": tuple(r["marks"] or ()), "rules": []})
        own["rules"].append(Rule(r["state"], r["pattern"], r["action"], r["goes_to"], tuple(r.get("columns") or ()), tuple(tuple(c) for c in r.get("checks") or ())))
    return [Layout(name, own["marks"], tuple(own["rules"])) for name, own in found.items()]


def claims(docs: DataFrame, layouts: list[Layout], text: Column, sha256: Column | None = None) -> Column:
    """Names of the layouts that recognise a document."""
    first = F.substring_index(text, "\f", 1)

    def fits(layout: Layout) -> Column:
        out = F.lit(True)
        for mark in layout.marks:
            out = out & F.contains(first, F.lit(mark))
        return out & sha256.isin(*layout.bound) if layout.bound and sha256 is not None else out

    return F.array_compact(F.array(*(F.when(fits(x), x.name) for x in layouts)))


@functools.lru_cache(maxsize=1024)
def _by_state(layout: Layout) -> dict[str, list[tuple[re.Pattern, Rule]]]:
    """The rules of each state with their patterns, made once for a layout and not for each document."""
    out: dict[str, list[tuple[re.Pattern, Rule]]] = {}
    for r in layout.rules:
        out.setdefault(r.state, []).append((re.compile(r.pattern), r))
    return out


def transduced(layout: Layout, text: str) -> Iterator[dict]:
    """Every line that is not blank: page, line, state, role, raw, fields, reasons."""
    by_state = _by_state(layout)
    state, section, last, ahead = "start", {}, None, None
    for page, body in enumerate(text.split("\f"), 1):
        for number, raw in enumerate(body.split("\n"), 1):
            if not raw.strip():
                continue
            out = {"page": page, "line": number, "state": state, "raw": raw, "fields": None, "reasons": None}
            match, rule = next(((m, r) for p, r in by_state.get(state, ()) if (m := p.fullmatch(raw))), (None, None))
            if rule is None:
                yield out | {"role": "unmatched"}
                continue
            state = rule.goes_to
            if rule.action == "row":
                if last is not None:
                    yield last
                cells = re.split(r"\s{2,}", raw.strip()) if rule.columns else ()
                own = dict(zip(rule.columns, cells, strict=False)) if rule.columns else {k: v for k, v in match.groupdict().items() if v}
                reasons = ["cells"] if rule.columns and len(cells) != len(rule.columns) else []
                if ahead is not None and (page, number - NEAR) <= ahead[:2]:
                    own["status"] = ahead[2]
                ahead = None
                reasons += [why for name, pattern, why in rule.checks if not re.fullmatch(pattern, own.get(name, ""))]
                last = out | {"role": "unparsed" if reasons else "row", "fields": section | own, "reasons": reasons}
                continue
            if rule.action == "more" and last is not None:
                last["raw"] += "\n" + raw
                last["fields"] = last["fields"] | {k: (last["fields"].get(k, "") + " " + v).strip() for k, v in match.groupdict().items() if v}
            elif rule.action == "status-behind" and last is not None:
                last["fields"] = last["fields"] | {k: v for k, v in match.groupdict().items() if v}
            elif rule.action == "status-ahead":
                ahead = (page, number, match.groupdict().get("status") or raw.strip())
            elif rule.action == "section":
                section = {k: v.strip() for k, v in match.groupdict().items() if v}
            yield out | {"role": rule.action, "fields": dict(match.groupdict()) if rule.action == "section" else None}
    if last is not None:
        yield last


#: So many lines of any documents are handed on at once.
LINES = 10_000
_LINES = "doc string, layout string, page int, line int, state string, role string, raw string, fields map<string,string>, reasons array<string>"


def laid_out(docs: DataFrame, layouts: list[Layout], id_col: str, text_col: str, sha_col: str | None = None) -> DataFrame:
    """(doc, layout, page, line, state, role, raw, fields, reasons) of every line that is not blank.

    Roles: ``row`` and ``unparsed`` (a row that fails a check, with reasons), the other actions, ``unmatched``. A document that no layout
    recognises has one row ``unsupported``, one that several do one row ``ambiguous``, one without text one row ``needs-ocr``; none
    of these is read. Each document is read once, by its own layout.
    """
    known = {x.name: x for x in layouts}
    sha = F.col(sha_col) if sha_col else None
    claimed = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text"), claims(docs, layouts, F.col(text_col), sha).alias("claims"))
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")) == "", F.lit(True))
    verdict = F.when(blank, "needs-ocr").when(F.size("claims") == 0, "unsupported").when(F.size("claims") > 1, "ambiguous")
    judged = claimed.withColumn("verdict", verdict)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []

        def frame() -> pa.RecordBatch:
            kinds = {"page": pa.int32(), "line": pa.int32(), "fields": pa.map_(pa.string(), pa.string()), "reasons": pa.list_(pa.string())}
            value = {"fields": lambda x: x if x is None else list(x.items())}
            columns = {c: pa.array([value.get(c, lambda x: x)(r[c]) for r in rows], kinds.get(c, pa.string())) for c in names}
            return pa.RecordBatch.from_pydict(columns)

        names = ["doc", "layout", "page", "line", "state", "role", "raw", "fields", "reasons"]
        for batch in batches:
            for doc, text, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for row in transduced(known[own[0]], text):
                    rows.append({"doc": doc, "layout": own[0]} | row)
                    if len(rows) >= LINES:
                        yield frame()
                        rows.clear()
        if rows:
            yield frame()

    none = lambda kind: F.lit(None).cast(kind)
    unread = judged.where("verdict is not null").select(
        "doc", none("string").alias("layout"), none("int").alias("page"), none("int").alias("line"), none("string").alias("state"), F.col("verdict").alias("role"), none("string").alias("raw"),
        none("map<string,string>").alias("fields"), F.when(F.col("verdict") == "ambiguous", F.col("claims")).alias("reasons"),
    )
    return judged.where("verdict is null").select("doc", "text", "claims").mapInArrow(read, _LINES).unionByName(unread)


def reconciled(lines: DataFrame, docs: DataFrame, id_col: str, text_col: str, expected: DataFrame | None = None) -> DataFrame:
    """(doc, layout, lines, rows, unparsed, sections, others, unmatched, expected, coverage): the accounting of each document.

    ``lines`` is the number of lines that are not blank, counted from the text itself, and must be the sum of the five counts; coverage is
    complete where it is, nothing is unparsed and rows are as many as expected (or nothing is expected), else partial; documents
    that were not read have their verdict. ``expected`` is (doc, expected).
    """
    count = lambda *roles: F.count_if(F.col("role").isin(*roles))
    told = lines.groupBy("doc").agg(
        F.max("layout").alias("layout"), count("row").alias("rows"), count("unparsed").alias("unparsed"), count("section").alias("sections"), count("skip", "more", "status-ahead", "status-behind").alias("others"),
        count("unmatched").alias("unmatched"), F.max(F.when(F.col("role").isin("unsupported", "ambiguous", "needs-ocr"), F.col("role"))).alias("verdict"),
    )
    body = F.filter(F.split(F.col(text_col), "[\n\f]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")
    out = told.join(docs.select(F.col(id_col).cast("string").alias("doc"), F.coalesce(F.size(body), F.lit(0)).cast("long").alias("lines")), "doc")
    out = out.join(expected, "doc", "left") if expected is not None else out.withColumn("expected", F.lit(None).cast("long"))
    whole = (F.col("rows") + F.col("unparsed") + F.col("sections") + F.col("others") + F.col("unmatched") == F.col("lines")) & (F.col("unparsed") == 0) & F.coalesce(F.col("rows") == F.col("expected"), F.lit(True))
    coverage = F.when(F.col("verdict").isNotNull(), F.col("verdict")).when(whole, "complete").otherwise("partial")
    return out.select("doc", "layout", "lines", "rows", "unparsed", "sections", "others", "unmatched", "expected", coverage.alias("coverage"))


def read_layouts(spark: SparkSession, path: str) -> list[Layout]:
    """Layouts from a JSON table of rules, one row a rule with its place ``n``; a handful of rows a layout."""
    rows = spark.read.json(path).orderBy("n").collect()
    return rules_of(r.asDict(recursive=True) for r in rows)


_TIME, _YEAR = r"\d+:\d{2}(?:\.\d{2})?", r"(?:19|20)\d{2}"

#: A ranking with sections by category and discipline; a row is cells parted by two spaces, statuses stand on lines of their own before it.
RANKING = Layout(
    "ranking", ("Ranking of results",),
    (
        Rule("start", r"\s*Ranking of results.*", "skip", "start"),
        Rule("start", r"\s*Category (?P<category>.+?) - (?P<discipline>[A-Z0-9]+)\s*", "section", "rows"),
        Rule("rows", r"\s*Category (?P<category>.+?) - (?P<discipline>[A-Z0-9]+)\s*", "section", "rows"),
        Rule("rows", r"\s*(?P<status>BO|DQ)\s*", "status-ahead", "rows"),
        Rule("rows", rf"\s*\d+\s{{2,}}\S.*\s{{2,}}{_YEAR}\s{{2,}}.+", "row", "rows", ("rank", "surname", "given", "club", "year", "time"), (("year", _YEAR, "birth-year"), ("time", _TIME, "time"))),
        Rule("rows", r"\s*Page \d+ of \d+\s*", "skip", "rows"),
    ),
)

#: Numbered entries by unit; long names go on in the next line, absences are said in the line behind.
ENTRIES = Layout(
    "entries", ("Start list",),
    (
        Rule("start", r"Start list.*", "skip", "start"),
        Rule("start", r"Unit (?P<unit>\S+)", "section", "entries"),
        Rule("entries", r"Unit (?P<unit>\S+)", "section", "entries"),
        Rule("entries", rf"(?P<number>\d+)\. (?P<name>.+) \((?P<country>[A-Z]{{3}})\)(?: (?P<time>{_TIME}))?", "row", "entries", (), (("time", _TIME, "announced-time"),)),
        Rule("entries", r" {4,}(?P<name>\S.*)", "more", "entries"),
        Rule("entries", r"-> (?P<status>DNS|DSQ)", "status-behind", "entries"),
    ),
)

#: A report whose table lies between two rules; what stands around it is prose.
REPORT = Layout(
    "report", ("Report of the jury",),
    (
        Rule("start", r"-{5,}", "section", "table"),
        Rule("start", r".*", "skip", "start"),
        Rule("table", r"-{5,}", "skip", "start"),
        Rule("table", r"(?P<place>[^|]+)\|(?P<gender> [FM] )\|(?P<result>[^|]*)", "row", "table", (), (("result", r"\s*\d+(?:[.,]\d+)?\s*", "result"),)),
    ),
)
EXAMPLES = [RANKING, ENTRIES, REPORT]

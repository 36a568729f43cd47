"""Rules on facts of a record: cohort, continent, collision key, public fields, canonical JSON, label words, numbers in cells."""

from __future__ import annotations

import html
import json
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from tesserae.functions.reasons import reasons
from tesserae.functions.scalars import compatible

#: Sports continent of the country codes that sources print; PHL is a listed spelling, other codes are unknown.
CONTINENTS = {
    "europe": "ARM AUT AZE BEL CRO CZE DEN FIN FRA GBR GER GRE HUN ITA LAT LUX MDA NED NOR POL POR ROU SUI SVK SWE TUR UKR",
    "asia": "CHN HKG INA IND JPN KOR LBN MAS TPE PHL",
    "africa": "EGY RSA",
    "americas": "BRA CAN COL ECU PER USA",
    "oceania": "AUS",
}
#: Spellings of a gender that count as one.
GENDERS = {"M": "MALE", "MEN": "MALE", "F": "FEMALE", "WOMEN": "FEMALE"}
#: Headers of result tables and the public field each one fills.
HEADERS = {
    "Diver": "source-name", "Name": "source-name", "Nationality": "representation", "Discipline": "discipline", "AP": "announced-performance",
    "Announced": "announced-performance", "RP": "realised-performance", "Result": "realised-performance", "Card": "card", "Remarks": "remarks",
    "Points": "points", "Penalties": "penalty", "#": "rank",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def sports_continent(code: Column) -> Column:
    """The continent of an exactly known code; null for any other token, whatever its case."""
    return _lookup({code: continent for continent, codes in CONTINENTS.items() for code in codes.split()}, code)


def collision_key(federation: Column, event: Column, date: Column, discipline: Column, gender: Column, athlete: Column) -> Column:
    """Key under which rows may be the same: spelling of discipline, gender and athlete id is levelled, nothing else."""
    upper = lambda c: F.upper(F.trim(c))
    return F.struct(
        federation.alias("federation"), event.alias("event"), date.alias("date"), upper(discipline).alias("discipline"),
        F.coalesce(_lookup(GENDERS, upper(gender)), upper(gender)).alias("gender"), F.lower(athlete).alias("athlete"),
    )


def public_fields(fields: Column, allowed: list[str]) -> Column:
    """The entries of a map whose key may be published; a null map stays null."""
    return F.map_filter(fields, lambda k, _: k.isin(*allowed))


def renamed_headers(cells: Column, headers: dict[str, str] | None = None) -> Column:
    """Cells by header as a map by public field. Unknown headers go; of two headers of one field the later listed one stays."""
    headers = HEADERS if headers is None else headers
    fields = {}
    for header, field in headers.items():
        fields.setdefault(field, []).insert(0, header)
    named = F.map_from_entries(F.array(*(F.struct(F.lit(f), F.coalesce(*(cells[h] for h in hs))) for f, hs in fields.items())))
    return F.map_filter(named, lambda _, v: v.isNotNull())


def in_year(date: Column, year: int) -> Column:
    """Whether a text is an ISO date of the year; false for anything that is no date."""
    return F.coalesce(date.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.year(date.try_cast("date")) == year), F.lit(False))


def target_cohort(federation: Column, discipline: Column, date: Column, category: Column, wanted: tuple[str, str, int]) -> Column:
    """Whether a row is of the (federation, discipline, year) and of the senior women's category, with any of three dashes."""
    found = (federation == wanted[0]) & (discipline == wanted[1]) & in_year(date, wanted[2]) & category.rlike("^SENIORS [–—-] WOMEN$")
    return F.coalesce(found, F.lit(False))


def observation_class(parse_status: Column, raw_fields: Column, raw_line: Column, fragments: list[str]) -> Column:
    """result-row where a row was parsed or shows fields, fragment for a known detached line, else unclassified."""
    shown = F.coalesce(F.size(raw_fields) > 0, F.lit(False))
    fragment = ~shown & (parse_status == "unparsed") & F.trim(raw_line).isin(*fragments)
    return F.when(fragment, "fragment").when((parse_status == "parsed") | shown, "result-row").otherwise("unclassified")


def identity_compatible(scheme_a: Column, person_a: Column, scheme_b: Column, person_b: Column, sex_a: Column, sex_b: Column) -> Column:
    """False where two ids of one publisher differ or two known sexes differ; unknown contradicts nothing."""
    other_id = (scheme_a == scheme_b) & (person_a != person_b)
    return ~F.coalesce(other_id, F.lit(False)) & compatible(sex_a, sex_b)


def replay_blockers(snapshot: Column, bound_snapshot: Column, observation_revision: Column, decision_revision: Column, api_mapping: Column) -> Column:
    """What stands against a replay, in order; an empty list lets it run. A binding that names no snapshot mismatches nothing."""
    return reasons(
        ("snapshot-binding-mismatch", bound_snapshot != snapshot),
        ("missing-observation-store-revision", F.coalesce(observation_revision, F.lit("")) == ""),
        ("missing-decision-store-revision", F.coalesce(decision_revision, F.lit("")) == ""),
        ("missing-decision-api-mapping", F.coalesce(F.size(api_mapping), F.lit(0)) <= 0),
    )


def owner_queue_filter(wanted: str, effective: Column, status: Column) -> Column:
    """Rows of a wanted effective status; a decided row whose projection is pending counts under its own decision too."""
    decided = ("human_approved", "human_corrected", "rejected", "reversed")
    waiting = (effective == "projection_pending") & (status == wanted) if wanted in decided else F.lit(False)
    return (effective == wanted) | waiting


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no spaces, numbers in their shortest form; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(text))


def integer_with_unit(text: Column, unit: str) -> Column:
    """The whole number of a text such as ``72 m`` or ``72``; null for anything else."""
    return F.nullif(F.regexp_extract(text, rf"^\s*(-?[0-9]+)\s*(?:{unit})?\s*$", 1), F.lit("")).try_cast("long")


def cell_number(text: Column) -> Column:
    """(whole, real) of a workbook's number: whole where it is written without point or exponent, null where it is no number."""
    whole = text.rlike("^-?[0-9]+$")
    return F.struct(F.when(whole, text.try_cast("long")).alias("whole"), F.when(~whole, text.try_cast("double")).alias("real"))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def cell_text(source: Column) -> Column:
    """Text of an HTML fragment: tags out, entities read, white space collapsed. Fragments without ``&`` stay in the JVM."""
    bare = F.regexp_replace(source, "<[^>]*>", "")
    return F.trim(F.regexp_replace(F.when(bare.contains("&"), _unescaped(bare)).otherwise(bare), r"[\s ]+", " "))


@F.pandas_udf(ArrayType(StringType()))
def label_words(names: pd.Series) -> pd.Series:
    """Words of letters and numbers without marks, in lower case and in order: equal for reordered names."""

    def words(name: str) -> list[str]:
        bare = regex.sub(r"\p{M}", "", unicodedata.normalize("NFD", name)).lower()
        return sorted(w for w in regex.split(r"[^\p{L}\p{N}]+", bare) if w)

    return names.map(words, na_action="ignore")


_DIFFERENCE = ArrayType(
    StructType([StructField("field", StringType()), *(StructField(f"{side}_present", BooleanType()) for side in ("before", "after")), StructField("before", StringType()), StructField("after", StringType())])
)
_ABSENT = object()


@F.pandas_udf(_DIFFERENCE)
def json_differences(before: pd.Series, after: pd.Series) -> pd.Series:
    """Where two JSON values differ, by dotted path in order of keys: objects are compared key by key, anything else whole and
    by type (1, 1.0 and true differ). Values are JSON texts; an absent key has no text. A null side gives null."""

    def text(v) -> str | None:
        return None if v is _ABSENT else json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    def compared(x: str | None, y: str | None):
        if x is None or y is None:
            return None
        out, waiting = [], [("", json.loads(x), json.loads(y))]
        while waiting:
            path, a, b = waiting.pop()
            if isinstance(a, dict) and isinstance(b, dict):
                keys = sorted(a.keys() | b.keys(), reverse=True)
                waiting.extend((f"{path}.{k}" if path else k, a.get(k, _ABSENT), b.get(k, _ABSENT)) for k in keys)
            elif type(a) is not type(b) or a != b:
                out.append({"field": path, "before_present": a is not _ABSENT, "after_present": b is not _ABSENT, "before": text(a), "after": text(b)})
        return out

    return pd.Series([compared(x, y) for x, y in zip(before, after, strict=True)], dtype=object)

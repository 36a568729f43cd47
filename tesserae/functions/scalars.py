"""Scalar functions on dates, numbers, URLs, maps and boxes; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_hash(value: Column) -> Column:
    """A bare SHA-256 in hex gets the prefix ``sha256:``; anything else stays."""
    return F.when(value.rlike("^[0-9a-f]{64}$"), F.concat(F.lit("sha256:"), value)).otherwise(value)


def composite_id(*parts: Column) -> Column:
    """SHA-256 of the parts, joined by a unit separator; null parts count as empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def floor_to(value: Column, increment: Column) -> Column:
    """The greatest multiple of ``increment`` that ``value`` reaches (value > 0)."""
    return F.floor(value / increment) * increment


def has_places(value: Column, places: Column | int) -> Column:
    """Whether a decimal needs no more than ``places`` decimal places (a number, or a column of its own for each row)."""
    if isinstance(places, int):
        return value == F.round(value, places)
    return F.length(F.regexp_extract(value.cast("string"), r"\.([0-9]*[1-9])0*$", 1)) <= places


def iso_date(value: Column, pattern: str) -> Column:
    """The date in ISO form if ``value`` is a date in ``pattern`` and reads back to itself, else null."""
    date = F.try_to_timestamp(value, F.lit(pattern))
    return F.when(F.date_format(date, pattern) == value, F.date_format(date, "yyyy-MM-dd"))


def is_instant(value: Column) -> Column:
    """Whether a timestamp names its zone (``Z`` or ``+hh:mm``) and can be read."""
    return F.coalesce(value.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$") & F.try_to_timestamp(value).isNotNull(), F.lit(False))


def decimal_comma(value: Column, kind: str = "decimal(18,6)") -> Column:
    """A number with a decimal comma or point; null if it is not one."""
    return F.regexp_replace(F.trim(value), ",", ".").try_cast(kind)


def performance(value: Column) -> Column:
    """``72 m NR`` or ``5:03 WR`` as (minutes, amount, unit, badge); null fields where the text has none."""
    distance = r"^\s*([0-9]+(?:[.,][0-9]+)?)\s*(m|pts)\s*([A-Z]{2})?\s*$"
    clock = r"^\s*([0-9]+):([0-9]{2}(?:[.,][0-9]+)?)\s*([A-Z]{2})?\s*$"
    part = lambda pattern, n: F.nullif(F.regexp_extract(value, pattern, n), F.lit(""))
    return F.when(
        value.rlike(clock),
        F.struct(part(clock, 1).cast("int").alias("minutes"), decimal_comma(part(clock, 2)).alias("amount"), F.lit("s").alias("unit"), part(clock, 3).alias("badge")),
    ).when(
        value.rlike(distance),
        F.struct(F.lit(None).cast("int").alias("minutes"), decimal_comma(part(distance, 1)).alias("amount"), part(distance, 2).alias("unit"), part(distance, 3).alias("badge")),
    )


def backoff(attempt: Column, base: float) -> Column:
    """Seconds before the given attempt: none before the first, then doubling from ``base``."""
    return F.when(attempt <= 1, F.lit(0.0)).otherwise(F.lit(base) * F.pow(F.lit(2.0), attempt - 2))


def fixed_columns(text: Column, cuts: list[int]) -> Column:
    """The trimmed cells of a line that is cut at the given character positions."""
    ends = [*cuts[1:], 1 << 20]
    return F.array(*(F.trim(F.substring(text, a + 1, b - a)) for a, b in zip(cuts, ends, strict=True)))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 where they have no area together."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
    common = side("x0", "x1") * side("y0", "y1")
    whole = area(a) + area(b) - common
    return F.when(whole > 0, common / whole).otherwise(F.lit(0.0))


def map_diff(before: Column, after: Column) -> Column:
    """For each key whose values differ (null and missing are equal): key -> (before, after)."""
    both = F.map_zip_with(before, after, lambda _, x, y: F.struct(x.alias("before"), y.alias("after")))
    return F.map_filter(both, lambda _, v: ~v["before"].eqNullSafe(v["after"]))


def compatible(a: Column, b: Column) -> Column:
    """Three-valued agreement: unknown is compatible with anything."""
    return a.isNull() | b.isNull() | (a == b)


def one_scope(values: Column) -> Column:
    """Whether an array holds at most one distinct value besides null."""
    return F.size(F.array_distinct(F.array_compact(values))) <= 1


def first_filled(fields: Column, keys: list[str]) -> Column:
    """The first non-empty value of a string map among ``keys``."""
    return F.coalesce(*(F.nullif(fields[k], F.lit("")) for k in keys))


def safe_url(url: Column) -> Column:
    """Whether a URL is http(s), names a host, and carries no credentials, spaces or control characters."""
    return F.coalesce(url.rlike(r"^https?://[^/@\s]+(/|$)") & ~url.rlike(r"[\x00-\x20\x7f]") & ~url.rlike(r"(?i)[?&](token|key|password|secret)="), F.lit(False))


def probabilities(value: Column, tolerance: float) -> Column:
    """A JSON object of chances as a map; null unless all lie in 0 to 1 and their sum is 1 within ``tolerance``."""
    chances = F.from_json(value, "map<string,double>")
    held = F.map_values(chances)
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(held) > 0) & F.forall(held, lambda x: x.between(0, 1)) & (F.abs(total - 1) <= tolerance), chances)

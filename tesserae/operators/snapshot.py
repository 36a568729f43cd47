"""Snapshot records: flattened packets, classification, and the browse filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arrays of a packet's objects that hold rows of their own.
NESTED = ("rows", "aggregate_rows", "athlete_rows")


def flattened(packets: DataFrame, name_col: str = "source_name", json_col: str = "body") -> DataFrame:
    """(source_name, collection, record_path, parent_path, fields): every object of a packet's top-level arrays, and the
    objects of their nested row arrays. ``fields`` is the object as JSON text. A text that is no JSON object gives no rows."""
    source = packets.select(name_col, F.try_parse_json(json_col).alias("__v"))
    nested = ", ".join(f"'{n}'" for n in NESTED)
    return packets.sparkSession.sql(f"""
        with top as (
          select {name_col}, c.key as collection, i.pos as pos, i.value as value
          from {{packets}}, lateral variant_explode(__v) c, lateral variant_explode(c.value) i
          where c.key is not null and schema_of_variant(c.value) like 'ARRAY%' and schema_of_variant(i.value) like 'OBJECT%'
        )
        select {name_col}, collection, concat(collection, '/', pos) as record_path, cast(null as string) as parent_path, to_json(value) as fields from top
        union all
        select {name_col}, n.key as collection, concat(t.collection, '/', t.pos, '/', n.key, '/', i.pos), concat(t.collection, '/', t.pos), to_json(i.value)
        from top t, lateral variant_explode(t.value) n, lateral variant_explode(n.value) i
        where n.key in ({nested}) and schema_of_variant(n.value) like 'ARRAY%' and schema_of_variant(i.value) like 'OBJECT%'
    """, packets=source)


def overlaps(date_from: Column, date_to: Column, at: Column, low: Column, high: Column) -> Column:
    """Whether an interval (or a single date where an end is unknown) meets [low, high]; unknown dates do not."""
    return (F.coalesce(date_to, at) >= low) & (F.coalesce(date_from, at) <= high)


def browse(records: DataFrame, **equal: object) -> DataFrame:
    """Rows that equal every given value; a None filters nothing."""
    for column, value in equal.items():
        if value is not None:
            records = records.where(F.col(column) == F.lit(value))
    return records


def mapped(records: DataFrame, mapping: DataFrame, keys: list[str], label: str, wanted: str) -> DataFrame:
    """Records that ``mapping`` gives the label ``wanted``; ``unknown`` asks for those without any."""
    if wanted == "unknown":
        return records.join(mapping.select(*keys), keys, "left_anti")
    return records.join(mapping.where(F.col(label) == wanted).select(*keys), keys, "left_semi")

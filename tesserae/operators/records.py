"""Snapshot records: the kind of each flattened object and its normalised columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import canonical_hash

#: Collections whose name alone decides the kind.
COLLECTIONS = {
    "result_rows": "candidate_position", "observations": "candidate_position", "overall_rows": "aggregate", "gia_team.rows": "aggregate",
    "san_mauro.rows": "aggregate", "endpoint_records": "endpoint_source_record", "routes": "discovery_route", "leads": "discovery_lead",
    "candidate_result_appearances": "relationship", "sources": "source", "source_objects": "source", "artifacts": "source",
    "unmatched_daily": "gap", "gia_team.placeholder": "other",
}
#: What a page says of a row of its own.
DISPOSITIONS = {"duplicate_render": "repeated_position", "summary": "summary", "aggregate": "aggregate"}
#: Object kinds that stand for aggregates, and collections of positions.
AGGREGATES = ("aggregate", "club_standing", "standings", "combined_score", "secondary_score")
POSITIONS = ("positions", "pdf_positions", "observation_versions", "pages.rows", "pages.athlete_rows", "athlete_appearances", "sheets.rows")
#: Fixed value: the schema whose observation versions are no positions.
SUPPLEMENT = "san-mauro-jpg-supplement/v1"


def _decided(names: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[key]


def kind(collection: Column, obj: Column, parent: Column, schema: Column) -> Column:
    """One of 13 kinds of a flattened object; ``obj`` and ``parent`` are variants (parent null at the top).

    The collection's exact name decides first, then what the object and its parent say of themselves, then words within the
    collection's name. Nothing known is ``other``.
    """
    name = F.lower(collection)
    said = lambda v, key: F.try_variant_get(v, f"$.{key}", "string")
    own = said(obj, "kind")
    standing = F.lit("aggregate_standings")
    aggregate = F.coalesce(own.isin(*AGGREGATES), F.lit(False)) | said(obj, "role").eqNullSafe(standing) | said(parent, "role").eqNullSafe(standing)
    by_page = F.when(name == "pages.rows", _decided(DISPOSITIONS, said(obj, "disposition")))
    by_supplement = F.when((name == "observation_versions") & (schema == SUPPLEMENT), F.lit("observation_version"))
    by_self = F.when(own == "formula_placeholder", F.lit("other")).when(
        aggregate | said(parent, "page_kind").eqNullSafe(F.lit("aggregate")) | name.contains("aggregate"), "aggregate"
    )
    by_words = (
        F.when(name.rlike("gap|unparsed|retained_only"), "gap")
        .when(name.contains("relationship"), "relationship")
        .when(name.contains("candidate") | name.isin(*POSITIONS), "candidate_position")
        .when(name == "events", "event")
    )
    return F.coalesce(_decided(COLLECTIONS, name), by_supplement, by_page, by_self, by_words, F.lit("other"))


def _flattened(fields: Column) -> Column:
    """JSON of a map of variants with sorted keys. If any of its values is an object with a key ``value``, every object in it
    is replaced by what it has there (null if nothing); other values stay."""
    inner = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    wrapped = F.exists(F.map_values(fields), lambda v: is_object(v) & F.coalesce(F.map_contains_key(inner(v), "value"), F.lit(False)))
    json = lambda v: F.coalesce(F.to_json(v), F.lit("null"))

    def member(key: Column) -> Column:
        v = F.element_at(fields, key)
        own = F.when(wrapped & is_object(v), json(F.try_variant_get(v, "$.value", "variant"))).otherwise(json(v))
        quoted = F.to_json(F.array(key))
        return F.concat(F.substr(quoted, F.lit(2), F.char_length(quoted) - 2), F.lit(":"), own)

    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(fields)), member), ","), F.lit("}"))


def normalized(records: DataFrame) -> DataFrame:
    """Normalised columns beside ``records`` (obj, parent, root: variants; kind).

    Each column takes the first place that has a value: the object, then what it cites, then its parent and the packet. JSON
    null is no value. Nested values come as JSON with sorted keys. A column of ``records`` with one of the new names is replaced.
    """
    obj, parent, root = F.col("obj"), F.col("parent"), F.col("root")
    get = lambda v, path, as_="string": F.try_variant_get(v, f"$.{path}", as_)
    tree = lambda v, path: F.nullif(F.to_json(F.try_variant_get(v, f"$.{path}", "variant")), F.lit("null"))
    first = lambda *places: F.coalesce(*places)
    filled = lambda v, path: F.when(~tree(v, path).isin("{}", "[]", '""', "0", "false"), tree(v, path))
    mapping = lambda text: F.when(text.startswith("{"), text)

    scope = lambda i: first(get(obj, f"date_scope[{i}]"), F.when(tree(obj, "date_scope").isNull(), get(parent, f"date_scope[{i}]")))
    spans = scope(1).isNotNull()
    date_from = first(get(obj, "date_from"), F.when(spans, scope(0)), get(obj, "competition_date.start"))
    date_to = first(get(obj, "date_to"), F.when(spans, scope(1)), get(obj, "competition_date.end"))
    parsed = lambda field: first(get(obj, f"parsed_fields.{field}.value"), F.when(~tree(obj, f"parsed_fields.{field}").startswith("{"), get(obj, f"parsed_fields.{field}")))
    is_source = F.col("kind") == "source"
    root_hash = first(get(root, "source_sha256"), get(root, "source.sha256"))
    source_object = first(
        get(obj, "source_object_id"), get(obj, "source_id"), get(obj, "source_sha256"), F.when(is_source, first(get(obj, "id"), get(obj, "sha256"))),
        get(obj, "citation.source_sha256"), get(parent, "source_id"), get(parent, "source.sha256"), get(root, "source.id"), F.concat(F.lit("sha256:"), root_hash),
    )
    pair = F.when(
        (F.col("kind") == "relationship") & tree(obj, "daily").startswith("{") & tree(obj, "ranking").startswith("{"),
        F.concat(F.lit('{"daily":'), tree(obj, "daily"), F.lit(',"field_correspondences":'), F.coalesce(tree(obj, "field_correspondences"), F.lit("null")), F.lit(',"ranking":'), tree(obj, "ranking"), F.lit("}")),
    )
    return records.withColumns({
        "source_id": first(get(obj, "id"), get(obj, "position_id")),
        "source_object_id": canonical_hash(source_object),
        "acquisition_id": first(get(obj, "acquisition_id"), get(obj, "source.acquisition_id"), get(root, "source.acquisition_id")),
        "parser_version": first(get(obj, "parser_version"), get(obj, "observation_refs[0].parser_version")),
        "observation_version": first(get(obj, "observation_version"), get(obj, "job_id"), get(obj, "observation_refs[0].candidate_id")),
        "event_name": first(get(obj, "event_name"), F.when(F.col("kind") == "event", get(obj, "name")), get(root, "event_title_calendar")),
        "event_date": first(get(obj, "event_date"), get(obj, "position.date"), F.when(date_from == date_to, date_from), get(parent, "event_date"), get(root, "event_date_calendar")),
        "date_from": date_from,
        "date_to": date_to,
        "date_scope_json": first(tree(obj, "date_scope"), tree(parent, "date_scope")),
        "session": first(get(obj, "session"), get(parent, "session")),
        "category": first(get(obj, "category"), get(obj, "category_raw"), get(parent, "category_raw"), parsed("category")),
        "discipline": first(get(obj, "discipline"), get(obj, "discipline_raw"), get(obj, "cells.Discipline.value"), get(parent, "discipline_raw"), parsed("discipline")),
        "page": first(get(obj, "page", "int"), get(obj, "coordinates.page", "int"), get(parent, "page", "int"), get(obj, "citation.page", "int")),
        "citation_json": first(tree(obj, "citation"), pair, tree(obj, "position"), tree(obj, "locator"), tree(obj, "source_lines")),
        "review_status": first(get(obj, "review_status"), get(root, "owner_review_status"), F.when(F.col("kind") == "candidate_position", F.lit("unreviewed"))),
        "raw_fields_json": F.coalesce(mapping(first(*(filled(obj, f) for f in ("fields_raw", "raw_fields", "fields", "cells")))), F.lit("{}")),
        "parsed_fields_json": F.coalesce(F.when(mapping(filled(obj, "parsed_fields")).isNotNull(), _flattened(F.try_variant_get(obj, "$.parsed_fields", "map<string,variant>"))), F.lit("{}")),
    })

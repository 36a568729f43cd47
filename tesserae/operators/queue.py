"""The review queue: which group a record falls into, and what is known for and against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dispositions of assessments and relationship kinds, by the group that they belong to.
SAME_RESULT = ("duplicate_rendering", "supporting_overlap", "matching_timing_view")
SEMANTICS = ("unsupported_image_results", "supplemental_aggregate", "supplemental_combined_ranking")
REVISIONS = ("source_revision", "publisher_revision", "same_result")
#: The source and collection whose records are unmatched attempts.
UNMATCHED = ("ffessm-correspondences", "unmatched_daily")
GROUPS = ("source_revision_same_result", "same_attempt_relationship", "extraction_source_semantics", "event_publication", "coverage_finality")
#: Groups whose items also lack an approval until one is recorded.
APPROVED = ("source_revision_same_result", "event_publication")


def _text(raw: Column, path: str) -> Column:
    """The text of a field, null where it is absent, JSON null, empty, zero or false: such values say nothing."""
    value = F.try_variant_get(raw, f"$.{path}", "variant")
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(raw, f"$.{path}", "string")).otherwise(F.to_json(value))
    return F.when(~text.isin("", "null", "0", "false", "[]", "{}"), text)


def queue_group(kind: Column, source: Column, collection: Column, raw: Column) -> Column:
    """One of GROUPS, or null for a relationship of another kind."""
    relationship, disposition = _text(raw, "relationship_type"), _text(raw, "assessment.disposition")
    by_relationship = F.when(relationship.isin(*REVISIONS), GROUPS[0]).when(relationship == "same_attempt", GROUPS[1])
    return (
        F.when(kind == "relationship", by_relationship)
        .when(collection == "unparsed_rows", GROUPS[2])
        .when((source == UNMATCHED[0]) & (collection == UNMATCHED[1]), GROUPS[1])
        .when(collection == "source_relationship_gaps", GROUPS[3])
        .when(collection == "retained_only_artifacts", GROUPS[2])
        .when(disposition.isin(*SAME_RESULT), GROUPS[0])
        .when(disposition.isin(*SEMANTICS), GROUPS[2])
        .otherwise(GROUPS[4])
    )


def queue_items(records: DataFrame) -> DataFrame:
    """(id, group, trigger, supporting, contrary, unknown) of records (record_id, kind, source_name, collection, raw: variant) that belong in
    the queue. The trigger is the first thing that the record says of why it is there; ``unknown`` names what it does not say."""
    raw = F.col("raw")
    grouped = records.withColumn("group", queue_group(F.col("kind"), F.col("source_name"), F.col("collection"), raw)).where("group is not null")
    trigger = F.coalesce(*(_text(raw, p) for p in ("assessment.failure_reason", "reason", "value", "assessment.disposition", "relationship_type")), F.lit("Explicit evidence record"))
    said = lambda *paths: F.array_compact(F.array(*(_text(raw, p) for p in paths)))
    out = grouped.withColumns({"supporting": said("assessment.evidence", "basis"), "contrary": said("assessment.contrary_evidence", "contrary_evidence")})
    unknown = F.array_compact(F.array(
        F.when(F.size("supporting") == 0, "Supporting evidence not recorded in this item"),
        F.when(F.size("contrary") == 0, "Contrary evidence not recorded in this item"),
        F.when(F.col("group").isin(*APPROVED), "Relationship or publication approval not recorded"),
    ))
    return out.select(F.concat(F.lit("queue:"), "record_id").alias("id"), "group", trigger.alias("trigger"), "supporting", "contrary", unknown.alias("unknown"))

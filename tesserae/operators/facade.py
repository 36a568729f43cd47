"""Read-only views of a snapshot: overview, browse, detail, gaps, sources, and the command line over them."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import paging, snapshot
from tesserae.sources.archive import read_snapshot


class SnapshotQuery:
    """Bounded queries over ``records`` (record_id, source_name, collection, kind, event_name, date_from, date_to,
    event_date, parent_path, record_path, review_status, ...) and an optional label mapping of sources."""

    ORDER = ("source_name", "collection", "record_path", "record_id")

    def __init__(self, records: DataFrame, mapping: DataFrame | None = None):
        self.records, self.mapping = records, mapping

    def overview(self) -> DataFrame:
        return self.records.groupBy("source_name", "collection", "kind").agg(F.count("*").alias("records"))

    def browse(self, limit: int = 50, offset: int = 0, low=None, high=None, label: str | None = None, **equal) -> DataFrame:
        rows = snapshot.browse(self.records, **equal)
        if low is not None:
            rows = rows.where(snapshot.overlaps(F.col("date_from"), F.col("date_to"), F.col("event_date"), F.lit(low), F.lit(high if high is not None else low)))
        if label is not None:
            rows = snapshot.mapped(rows, self.mapping, ["source_name"], "label", label)
        return paging.page(rows, list(self.ORDER), limit, offset)

    def detail(self, record_id: str) -> DataFrame:
        """A record and its nested rows."""
        own = self.records.where(F.col("record_id") == record_id)
        below = self.records.join(F.broadcast(own.select("source_name", F.col("record_path").alias("parent_path"))), ["source_name", "parent_path"], "left_semi")  # one row
        return own.unionByName(below.select(own.columns))

    def gaps(self) -> DataFrame:
        return self.records.where("kind = 'gap'")

    def sources(self) -> DataFrame:
        return self.records.groupBy("source_name").agg(F.count("*").alias("records"), F.count_distinct("collection").alias("collections"), F.max("event_date").alias("newest"))

    def facets(self, *columns: str) -> DataFrame:
        """Over all records, whatever a browse filters."""
        return self.records.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns))


def main(arguments: list[str] | None = None) -> None:
    """overview, sources, gaps, or browse with column=value filters, of the snapshot at a path."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("path")
    parser.add_argument("verb", choices=("overview", "sources", "gaps", "browse"))
    parser.add_argument("filters", nargs="*", metavar="column=value")
    parser.add_argument("--limit", type=int, default=50)
    parser.add_argument("--offset", type=int, default=0)
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    view = SnapshotQuery(read_snapshot(spark, asked.path))
    out = view.browse(asked.limit, asked.offset, **dict(f.split("=", 1) for f in asked.filters)) if asked.verb == "browse" else getattr(view, asked.verb)()
    for line in out.toJSON().take(paging.MOST_ROWS):
        print(line)


if __name__ == "__main__":
    main()

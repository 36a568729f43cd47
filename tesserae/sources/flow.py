"""From files to readiness in four stages, each one commit of a versioned store: archive, extraction, ingestion, readiness.

Every stage works on what the stage before holds and it does not yet: a run that is lost between stages goes on where it was, a repeated
run adds nothing, and bytes that are there already are not read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.layouts import Layout, laid_out, reconciled
from tesserae.sources.versions import Pinned, Store

STAGES = ("archive", "extraction", "ingestion", "readiness")


def _new(rows: DataFrame, here: Pinned, table: str, key: str) -> DataFrame:
    """Rows whose key the table does not hold."""
    return rows.join(here.table(table).select(key).distinct(), key, "left_anti") if table in here.tables else rows


def flow(store: Store, arrived: DataFrame, layouts: list[Layout], parser: str, progress: Callable[[str, int], None] | None = None) -> Pinned:
    """Bring the store up to the arrived texts (text; other columns are ignored) and return its last commit.

    Tables: ``objects`` (sha256, text), one for each text; ``lines`` of ``laid_out`` by parser version; ``observations`` (job_id, ordinal,
    sha256, page, line, fields, parse_status), job_id being a digest of object and parser, ordinals in order of the lines from 0; ``readiness``
    (job_id, layout, lines, rows, unparsed, coverage). ``progress`` hears the stage and how many objects it took in.
    """
    here = store.pin()

    def done(stage: str, table: str, rows: DataFrame, count: DataFrame) -> Pinned:
        n = count.select("sha256").distinct().count()
        after = store.commit(here, append={table: rows}) if n else here
        if progress:
            progress(stage, n)
        return after

    job = F.sha2(F.concat_ws("\x1f", "sha256", F.lit(parser)), 256).alias("job_id")
    texts = arrived.where("text is not null").select(F.sha2("text", 256).alias("sha256"), "text").dropDuplicates(["sha256"])
    fresh = _new(texts, here, "objects", "sha256")
    here = done("archive", "objects", fresh, fresh)

    waiting = here.table("objects").select("sha256", "text", job)
    unread = _new(waiting, here, "lines", "job_id")
    read = laid_out(unread, layouts, "job_id", "text").withColumnRenamed("doc", "job_id").join(unread.select("job_id", "sha256"), "job_id")
    here = done("extraction", "lines", read, unread)

    lines = _new(here.table("lines"), here, "observations", "job_id")
    rows = lines.where("role in ('row', 'unparsed')")
    # lines of a document are one order: its rows are numbered within it
    numbered = rows.withColumn("fields_json", F.to_json("fields")).groupBy("job_id", "sha256").agg(F.array_sort(F.collect_list(F.struct("page", "line", "fields_json", "role"))).alias("all"))
    observed = numbered.select("job_id", "sha256", F.posexplode("all").alias("ordinal", "x")).select(
        "job_id", "ordinal", "sha256", "x.page", "x.line", F.col("x.fields_json").alias("fields"), F.when(F.col("x.role") == "row", "parsed").otherwise("unparsed").alias("parse_status")
    )
    here = done("ingestion", "observations", observed, rows)

    told = _new(here.table("lines"), here, "readiness", "job_id")
    objects = waiting.join(told.select("job_id").distinct(), "job_id", "left_semi")
    accounts = reconciled(told.withColumnRenamed("job_id", "doc").drop("sha256"), objects, "job_id", "text")
    ready = accounts.select(F.col("doc").alias("job_id"), "layout", "lines", "rows", "unparsed", "coverage")
    return done("readiness", "readiness", ready, told)

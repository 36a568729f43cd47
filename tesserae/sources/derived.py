"""Results that are computed once for each digest of input, parser and schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.sources.versions import Pinned, Store


def job_digest(inputs: list[str], parser: str, schema: str) -> Column:
    """sha256 over the parser, the schema and the input columns (nulls apart from empty texts)."""
    return F.sha2(F.to_json(F.struct(F.lit(parser).alias("parser"), F.lit(schema).alias("schema"), *inputs), {"ignoreNullFields": "false"}), 256)


def derive(store: Store, rows: DataFrame, inputs: list[str], parser: str, schema: str, produce: Callable[[DataFrame], DataFrame]) -> tuple[Pinned, DataFrame]:
    """(commit, results) of ``produce`` for every job of ``rows``; only jobs without a receipt are computed.

    ``produce`` gets (job, inputs) once for each distinct job and returns (job, value, error); a job with an error, or that it
    says nothing of, or twice, is a failure. Receipts and values are one commit: a crash before it leaves nothing, and a
    rerun computes the jobs again. Failures have receipts as well and are not tried again under the same digest.
    Results have a row for each of ``rows``: its columns, job, status (committed or failed), value, error and value_sha256.
    """
    here = store.pin()
    keyed = rows.withColumn("job", job_digest(inputs, parser, schema))
    jobs = keyed.select("job", *inputs).dropDuplicates(["job"])
    fresh = jobs.join(here.table("receipts").select("job"), "job", "left_anti") if "receipts" in here.tables else jobs
    if not fresh.isEmpty():
        made = produce(fresh).select("job", F.col("value").cast("string").alias("value"), F.col("error").cast("string").alias("error"))
        told = made.groupBy("job").agg(F.count("*").alias("n"), F.first("value").alias("value"), F.first("error").alias("error"))
        all_ = fresh.select("job").join(told, "job", "left")
        error = F.when(F.col("n").isNull(), "no-result").when(F.col("n") > 1, "several-results").otherwise(F.coalesce("error", F.when(F.col("value").isNull(), "no-value")))
        receipts = all_.select("job", F.lit(parser).alias("parser"), F.lit(schema).alias("schema"), F.when(error.isNull(), "committed").otherwise("failed").alias("status"), F.when(error.isNull(), F.col("value")).alias("value"), error.alias("error"))
        here = store.commit(here, append={"receipts": receipts.withColumn("value_sha256", F.sha2("value", 256))})
    found = here.table("receipts").drop("parser", "schema") if "receipts" in here.tables else None
    return here, keyed.join(found, "job", "left") if found is not None else keyed


def verified(pinned: Pinned) -> DataFrame:
    """Receipts (job, problem) that contradict themselves: another digest than the value's, a job twice, a value and an error."""
    receipts = pinned.table("receipts")
    problem = F.when(F.col("value_sha256") != F.sha2("value", 256), "digest").when((F.col("status") == "committed") == F.col("value").isNull(), "status")
    twice = receipts.groupBy("job").agg(F.count("*").alias("n")).where("n > 1").select("job", F.lit("repeated").alias("problem"))
    return receipts.select("job", problem.alias("problem")).where("problem is not null").unionByName(twice)


def forgotten(store: Store, parsers: list[str]) -> Pinned:
    """Drop the receipts of all parsers but these; their folders go with ``Store.clean``."""
    here = store.pin()
    return store.commit(here, replace={"receipts": here.table("receipts").where(F.col("parser").isin(*parsers))})

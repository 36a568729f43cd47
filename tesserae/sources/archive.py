"""Content-addressed registration, snapshots with a manifest, and idempotent imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.summaries import table_digest
from tesserae.sources.stored import stored
from tesserae.sources.versions import Store


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, path, bytes, modified) of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.sha2("content", 256).alias("sha256"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def registered(known: DataFrame, found: DataFrame) -> DataFrame:
    """Objects of ``found`` whose hash is not known yet, one for each hash (the first path)."""
    return found.join(known.select("sha256"), "sha256", "left_anti").groupBy("sha256").agg(F.min(F.struct("path", "bytes", "modified")).alias("x")).select("sha256", "x.*")


def listing_mismatches(index: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): missing, unexpected or changed files of an indexed file set."""
    both = index.select("path", F.col("sha256").alias("a")).join(files.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def imported(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of ``batch`` to append: those of new keys. A key that exists must be repeated exactly, else an error."""
    known, given = stored(existing.select(key).distinct(), "keys"), stored(batch.select(key).distinct(), "keys")
    again = batch.join(known, key, "left_semi").select(*existing.columns, F.lit(1).alias("__side"))
    held = existing.join(given, key, "left_semi").select(*existing.columns, F.lit(-1).alias("__side"))
    # rows of both sides are dealt by all their columns and counted against each other, not gathered by key
    if not again.unionByName(held).groupBy(*existing.columns).agg(F.sum("__side").alias("__n")).where("__n <> 0").isEmpty():
        raise ValueError("a job was imported before with other rows")
    return batch.join(known, key, "left_anti").select(existing.columns)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Rows and their digest as one commit of a versioned store at ``path``: a reader sees the snapshot before or this one whole, also
    when the writer is lost on its way."""
    store = Store(df.sparkSession, path)
    here = store.commit(store.pin(), replace={"records": df})
    # the digest is of what was written, and makes the snapshot valid
    told = table_digest(here.table("records")).first()
    store.commit(here, properties={"rows": told["rows"], "digest": told["digest"], "snapshot": here.number})


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest finished snapshot, after their count and digest agree with its manifest."""
    pinned = Store(spark, path).pin()
    done = pinned.properties.get("snapshot")
    if done is None:
        raise ValueError(f"{path} holds no finished snapshot")
    rows = Store(spark, path).pin(done).table("records")
    if (pinned.properties["rows"], pinned.properties["digest"]) != tuple(table_digest(rows).first()):
        raise ValueError(f"{path} does not agree with its manifest")
    return rows


def replayed(spark: SparkSession, path: str, rebuilt: DataFrame) -> bool:
    """Whether a snapshot that is built again has the rows and digest of the one at ``path``."""
    told = Store(spark, path).pin().properties
    return (told["rows"], told["digest"]) == tuple(table_digest(rebuilt).first())


def exported(df: DataFrame, path: str) -> None:
    """A portable copy: the files of ``df`` below ``path``/files and their index (path below files, sha256, bytes) below ``path``/index."""
    df.write.parquet(f"{path}/files")
    below = F.regexp_extract("path", "/files/(.*)$", 1)
    found = objects(df.sparkSession, f"{path}/files").where(~F.col("path").rlike(r"/[._][^/]*$")).select(below.alias("path"), "sha256", "bytes")
    found.coalesce(1).write.json(f"{path}/index")


def restored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a portable copy, after every file of it is there with its digest and no other is."""
    below = F.regexp_extract("path", "/files/(.*)$", 1)
    index = spark.read.schema("path string, sha256 string, bytes long").json(f"{path}/index")
    found = objects(spark, f"{path}/files").where(~F.col("path").rlike(r"/[._][^/]*$")).select(below.alias("path"), "sha256")
    if bad := [tuple(r) for r in listing_mismatches(index, found).orderBy("path").limit(20).collect()]:
        raise ValueError(f"{path} is not as it was exported: {bad}")
    return spark.read.parquet(f"{path}/files")


def inventory(objects_: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Every acquisition (acquisition_id, sha256, ...) with ``state``: verified where an object of that hash, computed from its bytes now, is
    there, else missing."""
    return acquisitions.join(objects_.select("sha256").distinct().withColumn("__held", F.lit(True)), "sha256", "left").withColumn("state", F.when(F.col("__held"), "verified").otherwise("missing")).drop("__held")


def extended(base: DataFrame, new: DataFrame, namespace: str) -> DataFrame:
    """``base`` with the namespaces of ``new`` added; one that is there already is an error."""
    if not base.select(namespace).join(new.select(namespace), namespace, "left_semi").isEmpty():
        raise ValueError("a namespace is there already")
    return base.unionByName(new)

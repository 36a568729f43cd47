"""Corpus pipeline over ``documents``: five stages, each one operator of ``tesserae.llm``.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and lets its decisions take effect:
low or toxic quality goes, one document of each near-duplicate group stays (that of the smallest id), documents that hold
a benchmark item go, secrets are redacted in the text, and what is left is packed into token sequences. All but the last
return the columns of ``documents`` (and whatever other columns came in).

Rows with a null text are kept by the filters as far as their empty text allows; rows with a null id take part in the
quality stage, redaction and packing, and pass the two stages that remove by id. An empty table stays empty throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.decontaminate import decontaminated
from tesserae.llm.jaccard_join import jaccard_join
from tesserae.llm.ordinal_quality import fitted, graded, toxicity_grade
from tesserae.llm.packing import pack
from tesserae.llm.secrets import redacted
from tesserae.sources.stored import removed, scope, stored
from tesserae.sources.tables import table

#: Steps of learning, hashing and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose chance of the best grade reaches one half."""
    labels = table(spark, sf_dir, "labels").select("doc_id", toxicity_grade().alias("grade"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "text")  # whatever the columns are called
    return graded(rows, fitted(docs, labels, 3)).where("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the document of the smallest id of each group linked by similarity 0.75 or more."""
    gone = jaccard_join(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["__gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: all documents, each secret replaced by a mark; n_chars follows the text."""
    out = redacted(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the pieces of all documents in token sequences."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_redaction),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written to the shared folder and read again.

    A stage's own tables, and the result that it worked on, go when its result is written; the last stage's stay, as its rows
    are read by the caller."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before = docs
        with scope() as keep:
            docs = keep(stored(stage(spark, before, sf_dir), f"stage{i}"))
        if i:
            removed(before)
    return STAGES[-1][1](spark, docs, sf_dir)

from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm.queries import oracle_sql, queries
from tesserae.llm.ordinal_quality import fitted, graded, toxicity_grade
from tesserae.llm.secrets import scan
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def test_queries_are_named():
    assert sorted(n.split("_")[0] for n in queries()) == sorted([*(f"op{i}" for i in range(1, 14)), "pipeline"])
    assert set(oracle_sql()) <= set(queries())


def test_pipeline_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, SMALL)
    assert good.columns == docs.columns
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", toxicity_grade().alias("grade"))
    scores = {r["doc_id"]: r["tail_2"] for r in graded(docs, fitted(docs, labels, 3)).collect()}
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert set(kept) == {i for i, p in scores.items() if p >= 0.5} and len(kept) > 20
    alone = stages[1](spark, good, SMALL).cache()
    assert {r["doc_id"] for r in alone.collect()} == {i for i, (_, c) in brute.linked(list(kept.items())).items() if i == c}
    clean = stages[2](spark, alone, SMALL).cache()
    held = {r["doc_id"]: r["text"] for r in clean.collect()}
    items = [" ".join(r["text"].split()).lower() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for row in alone.collect():
        leaked = any(item in " ".join(row["text"].split()).lower() for item in items)
        assert not (leaked and row["doc_id"] in held)
    redacted = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages[3](spark, clean, SMALL).collect()}
    assert set(redacted) == set(held)
    for i, (text, n) in redacted.items():
        assert n == len(text) and not brute.spans(text) and (brute.spans(held[i]) or "[REDACTED]" in text or text == held[i])
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in pieces} == set(held)


def bag(df):
    return sorted(map(str, df.collect()))


def test_odd_tables_row_by_row(spark, odd, none):
    """What each stage makes of nulls, copies, repeated ids and clashing columns, rows and texts compared."""
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        empty = stage(spark, none, SMALL)
        assert empty.count() == 0 and (name == "packing" or empty.columns == odd.columns)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", toxicity_grade().alias("grade"))
    row = F.struct(*odd.columns).alias("row")
    judged = graded(odd.select(row, "text"), fitted(odd, labels, 3))
    assert bag(stages["quality classifier"](spark, odd, SMALL)) == bag(judged.where("tail_2 >= 0.5").select("row.*"))

    # one document of each group, all rows without an id
    rows = odd.collect()
    component = {i: c for i, (_, c) in brute.linked(list({r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}.items())).items()}
    alone = stages["n-gram Jaccard join"](spark, odd, SMALL)
    assert bag(alone) == sorted(str(r) for r in rows if r["doc_id"] is None or component[r["doc_id"]] == r["doc_id"])

    # nothing of the benchmark stands in the odd rows but what is put there
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    leaked = odd.withColumn("text", F.when(F.col("doc_id") == 6, F.concat_ws(" ", "text", F.lit(item), "text")).otherwise(F.col("text")))
    assert bag(stages["benchmark decontamination"](spark, leaked, SMALL)) == sorted(str(r) for r in leaked.collect() if r["doc_id"] != 6)

    # every span and nothing else gives way to a mark
    spans_of = {r["doc_id"]: r["spans"] for r in scan(spark.createDataFrame([(n, r["text"]) for n, r in enumerate(rows)], "doc_id long, text string")).collect()}
    found = {rows[n]["text"]: spans for n, spans in spans_of.items()}

    def redacted(r):
        spans = found[r["text"]]
        if not spans:
            return r["text"]
        out, at = "", 0
        for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
            if start >= at:
                out += r["text"][at:start] + "[REDACTED]"
            at = max(at, end)
        return out + r["text"][at:]

    wanted = []
    for r in rows:
        text = redacted(r)
        wanted.append(str(Row(**(r.asDict() | {"text": text, "n_chars": None if text is None else len(text)}))))
    assert bag(stages["secret scans"](spark, odd, SMALL)) == sorted(wanted)
    packed = stages["packing"](spark, odd, SMALL).collect()
    assert sorted(str(r["doc_id"]) for r in packed if r["start"] == 0) == sorted(str(r["doc_id"]) for r in rows)

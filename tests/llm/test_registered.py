"""Registered queries on the smallest tables, all rows, against plain Python."""

import hashlib
import zlib
from collections import Counter

import numpy as np

from tesserae.llm.queries import queries
from tests.llm import brute
from tests.llm.test_links import places, similar
from tests.llm.test_texts import checked

SMALL = "/root/testdata/sf0.001"


def run(spark, name):
    return queries()[name](spark, SMALL).collect()


def texts(spark, table="documents", key="doc_id"):
    return {r[key]: r["text"] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").collect()}


def test_op1(spark):
    want = {i: brute.counts(t) for i, t in texts(spark).items()}
    out = run(spark, "op1_quality_rules")
    assert {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in out} == want
    assert not any(r["kept"] and r["base_failed"] for r in out)


def test_op2(spark):
    docs, out = texts(spark), run(spark, "op2_sharding")
    places(out, len(docs))
    for r in out:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    shards = {}
    for r in out:
        shards.setdefault(docs[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_op3(spark):
    docs = texts(spark)
    for r in run(spark, "op3_secrets"):
        found = brute.spans(docs[r["doc_id"]])
        kinds = Counter(k for _, k, _ in found)
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (kinds[0], kinds[1], kinds[2], brute.span_digest(found))


def test_op5(spark):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op5_jaccard_join")} == brute.linked(list(texts(spark).items()))


def test_op7(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts(spark).items()}
    windows = checked(run(spark, "op7_packing"), ids, 2048)
    assert sum(sum(r["length"] for r in w) < 2048 for w in windows.values()) <= 1


def test_op8(spark):
    wanted = similar(list(texts(spark).items()), list(texts(spark, "benchmark", "item_id").items()))
    found = {(r["doc_id"], r["item_id"]) for r in run(spark, "op8_decontaminate")}
    assert found <= wanted and len(found) >= 0.98 * len(wanted) and wanted


def test_op10(spark):
    want = brute.repeats_removed(list(texts(spark).items()), 100)
    for r in run(spark, "op10_suffix_dedup"):
        size, gone, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (size, gone, spans, hashlib.sha256(kept).hexdigest())

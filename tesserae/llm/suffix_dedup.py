"""Operator 10: removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (in a document of smaller id, or earlier in
the same one). Sorting every suffix of a corpus would be a shuffle of hundreds of bytes a byte, so the suffixes that can
matter are found first, without loss:

1. Each string of ``LENGTH`` bytes has an anchor, the least hash among the ``SEED``-byte strings in it (the leftmost of
   equals), so equal strings have equal anchors. Neighbouring strings share anchors; a run of strings with one anchor is a
   *piece*. A piece equal to an earlier one repeats as a whole; a task finds that among its own pieces (so that no group
   grows with the copies of a text), and pieces that are left meet in buckets by anchor, as hashes. The first of each distinct
   piece of an anchor that has several may repeat in part: those pieces, a small share of all, go on with their bytes.
2. A task that reads them builds, for each bucket, the Burrows-Wheeler transform of its pieces (a *shard*) and ships only
   the transform.
3. A bucket's task merges its shards' transforms by iterative interleave refinement: starting from the shards one after
   another, each round extends every suffix by the symbol in front of it (the LF step of its shard) and splits the blocks
   of suffixes that are still equal. Suffixes alone in their block are settled and leave. After ``LENGTH`` rounds the blocks
   are the intervals of common prefix ``LENGTH`` or more: the repeated strings, without sorting the suffixes again.
4. In each interval all but the earliest start are marked; marks become byte ranges of their documents.

An anchor with more than ``HOT_BYTES`` of distinct pieces (a passage with other text around it in very many documents) would
be one bucket. Its pieces are cut into their single strings, each task keeps the earliest of equal ones, and strings are dealt
to buckets by their own hash, which equal strings share. Buckets and shards are as many as the counted bytes need.

Hash collisions (64 bits for pieces of one anchor) are the only approximation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import textkernel as tk
from tesserae.operators.ordering import beside, numbered
from tesserae.sources.stored import stored

SEED = 32
#: Pieces that a task gathers before it hands them on, and bytes of pieces in a shard set.
FLUSH = 1_000_000
SHARD_BYTES = 8_000_000
#: Bytes of pieces that one merge should hold, and of documents whose pieces make one bucket.
MERGE_BYTES, BUCKET_BYTES = 2_000_000, 32_000_000
#: Bytes of distinct pieces from which on an anchor's pieces are cut into single strings.
HOT_BYTES = 8_000_000

_U = np.uint64
_NONE = np.iinfo(np.int64).min
_PIECES = pa.schema([("bucket", pa.int64()), ("anchors", pa.binary()), ("hashes", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary())])
_MARKS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("anchor", pa.int64())])
_SHARDS = pa.schema([("bucket", pa.int64()), ("transform", pa.binary()), ("ends", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary())])


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first start within the row, number of starts, anchor hash, piece hash) of the pieces of one chunk."""
    n, span = len(data), length - SEED + 1
    sizes = np.diff(offsets)
    if n < length or not (sizes >= length).any():
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    prefix = tk.prefix_hash(data)
    at = np.arange(n - SEED + 1)
    seeds = tk.spans(prefix, at, at + SEED)
    least, width = (seeds & _U(0xFFFFFFFF00000000)) | at.astype(np.uint64), 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    inside = np.zeros(n + 2, np.int64)
    long = sizes >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
    anchor = (least[start] & _U(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(offsets, start, "right") - 1
    head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
    counts = np.diff(np.append(head, len(start)))
    first, row = start[head], row[head]
    return row, first - offsets[row], counts, seeds[anchor[head]], tk.spans(prefix, first, first + counts - 1 + length)


def _raw(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _earliest(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are the earliest of their key, rows that start later than that one); a repeated row is in neither."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(key) else np.zeros(0, bool)
    alone = new & np.append(new[1:], True) if len(key) else new
    several = order[~alone]
    several = several[np.lexsort((start[several], doc[several], key[several]))]
    head = np.concatenate(([True], key[several][1:] != key[several][:-1])) if len(several) else np.zeros(0, bool)
    lead = several[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(several) else several
    later = ~head & ((doc[several] != doc[lead]) | (start[several] != start[lead]))
    return np.sort(np.concatenate((order[alone], several[head]))), several[later]


def _united(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of documents in order, those that touch or overlap as one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    # ranges of one document reach ever further where lengths are equal or ordered as the starts are
    head = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1]))) if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    return doc[at], start[at], np.maximum.reduceat(stop, at) if len(at) else stop


def _deal(length: int, bits: int):
    def run(batches):
        held, size = [], 0

        def flush():
            nonlocal size
            rows = []
            if held:
                doc, start, count, anchor, piece = (np.concatenate(x) for x in zip(*held, strict=True))
                mix = tk.mixed(anchor)
                first, later = _earliest(tk.mixed(mix ^ piece), doc, start)
                if len(later):  # byte ranges that repeat within the task's own pieces
                    d, s, e = _united(doc[later], start[later], start[later] + count[later] - 1 + length)
                    rows.append((-1 - TaskContext.get().partitionId() % 1024, b"", b"", _raw(np.diff(d, prepend=0), np.int64), _raw(s, np.uint32), _raw(e, np.uint32)))
                doc, start, count, mix, piece = doc[first], start[first], count[first], mix[first], piece[first]
                bucket = (mix >> _U(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True])))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    i = order[a:b]
                    rows.append((int(bucket[i[0]]), _raw(mix[i] & _U(0xFFFFFFFF), np.uint32), _raw(piece[i], np.uint64), _raw(np.diff(doc[i], prepend=0), np.int64), _raw(start[i], np.uint32), _raw(count[i], np.uint16)))
            held.clear()
            size = 0
            return _batch(rows, _PIECES)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in tk.chunks(batch.column(1)):
                row, start, count, anchor, piece = pieces(data, offsets, length)
                if len(row):
                    held.append((ids[lo + row].astype(np.int64), start, count, anchor, piece))
                    size += len(row)
                if size >= FLUSH:
                    yield flush()
        yield flush()

    return run


def _whole(length: int, hot_bytes: int):
    """One bucket of pieces: byte ranges of those that an earlier equal piece repeats (anchor null), and the first of each
    distinct piece of the anchors that have several (with its bytes' range and the anchor, below 0 if that is hot)."""

    def run(table: pa.Table) -> pa.Table:
        def column(name, kind):
            return np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])

        if table["bucket"][0].as_py() < 0:
            docs = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in table["docs"].to_pylist()])
            return pa.table([pa.array(docs), pa.array(column("starts", np.uint32).astype(np.int64)), pa.array(column("counts", np.uint32).astype(np.int64)), pa.nulls(len(docs), pa.int64())], schema=_MARKS)
        anchors, hashes = column("anchors", np.uint32), column("hashes", np.uint64)
        docs = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in table["docs"].to_pylist()])
        starts, counts = column("starts", np.uint32).astype(np.int64), column("counts", np.uint16).astype(np.int64)
        # anchors that stand once cannot repeat
        order = np.argsort(anchors, kind="stable")
        ordered = anchors[order]
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = ordered[1:] == ordered[:-1]
        keep = order[same[1:] | same[:-1]]
        keep = keep[np.lexsort((starts[keep], docs[keep], hashes[keep], anchors[keep]))]
        a, h, d, s, c = anchors[keep], hashes[keep], docs[keep], starts[keep], counts[keep]
        if not len(keep):
            return pa.Table.from_batches([_batch([], _MARKS)])
        new_anchor = np.concatenate(([True], a[1:] != a[:-1]))
        new_piece = new_anchor | np.concatenate(([True], h[1:] != h[:-1]))
        lead = np.flatnonzero(new_piece)[np.cumsum(new_piece) - 1]
        later = ~new_piece & ((d != d[lead]) | (s != s[lead]))  # a repeated row is not later than itself
        group = np.cumsum(new_anchor) - 1
        several = new_piece & (np.bincount(group, weights=new_piece)[group] > 1)
        out = np.concatenate((np.flatnonzero(later), np.flatnonzero(several)))
        partly = np.arange(len(out)) >= later.sum()
        name = (table["bucket"][0].as_py() << 32) | a.astype(np.int64)
        hot = np.bincount(group, weights=several * (c - 1 + length))[group] > hot_bytes
        name = np.where(hot, -1 - name, name)
        return pa.table([pa.array(d[out]), pa.array(s[out]), pa.array(s[out] + c[out] - 1 + length), pa.array(name[out], mask=~partly)], schema=_MARKS)

    return run


def transform(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of the texts, each closed by its own end (ordered as the texts, before all bytes), and
    the rows at which the symbol is an end; there the transform holds 0."""
    sizes = np.array([len(t) for t in texts], np.int64)
    close = np.cumsum(sizes + 1) - 1  # place of each text's end
    n = int(close[-1]) + 1
    symbols = np.zeros(n + 3, np.uint64)
    inner = np.ones(n, bool)
    inner[close] = False
    symbols[:n][inner] = np.concatenate(texts).astype(np.uint64) + _U(1)
    end = np.repeat(close, sizes + 1)
    place = np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(4):
        key = (key << _U(16)) | np.where(place + k < end, symbols[k : k + n], _U(0))
    order = np.argsort(key, kind="stable")  # ends come first, in the order of their texts
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    new[: len(texts)] = True
    rank = np.empty(n, np.int64)
    h = 4
    while True:
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[order] = begin
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            break
        rows = order[tied]
        follow = rank[np.minimum(rows + h, end[rows])]
        turn = np.lexsort((follow, begin[tied]))
        order[tied] = rows[turn]
        follow = follow[turn]
        apart = np.concatenate(([True], follow[1:] != follow[:-1]))
        new[tied] |= apart
        h *= 2
    before = order - 1
    first = np.concatenate(([0], close[:-1] + 1))
    whole = np.zeros(n, bool)
    whole[first] = True
    ends = np.flatnonzero(whole[order])
    out = (symbols[before] - _U(1)).astype(np.uint8)
    out[ends] = 0
    return out, ends


def merged_intervals(shards: list[tuple[np.ndarray, np.ndarray, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge shards (transform, rows of ends, number of texts) by interleave refinement.

    Returns (text, start in the text, interval) of every suffix that shares its first ``length`` bytes with another; texts
    are numbered over all shards.
    """
    symbols = np.concatenate([t for t, _, _ in shards])
    n = len(symbols)
    base = np.concatenate(([0], np.cumsum([len(t) for t, _, _ in shards])))
    is_end = np.zeros(n, bool)
    step = np.zeros(n, np.int64)  # the LF step: where the suffix that is longer by the symbol in front stands
    ends_at, text = [], np.full(n, -1, np.int64)
    n_texts = 0
    for at, (t, ends, count) in zip(base, shards, strict=False):
        is_end[at + ends] = True
        rest = np.flatnonzero(~is_end[at : at + len(t)])
        step[at + rest[np.argsort(t[rest], kind="stable")]] = at + count + np.arange(len(rest))
        ends_at.append(at + np.arange(count))
        text[at : at + count] = n_texts + np.arange(count)
        n_texts += count
    # walk from each text's end to its beginning: which text a suffix is of, and how long it is
    size = np.zeros(n, np.int64)
    now, far = np.concatenate(ends_at), 0
    sizes = np.zeros(n_texts, np.int64)
    while len(now):
        whole = is_end[now]
        sizes[text[now[whole]]] = far
        now = now[~whole]
        following = step[now]
        text[following] = text[now]
        far += 1
        size[following] = far
        now = following
    # refinement: suffixes in the order of their first h bytes, shards one after another among equals; two symbols a round
    step = step.astype(np.int32)
    rows, block, depth = np.arange(n, dtype=np.int32), np.zeros(n, np.int32), 0
    pair = (symbols[step].astype(np.uint16) << np.uint16(8)) | symbols
    two, whole_two = step[step], is_end | is_end[step]
    while depth < length and len(rows):
        double = length - depth != 1 and (length - depth) % 2 == 0
        keep = ~(whole_two if double else is_end)[rows]
        rows, block = rows[keep], block[keep]
        front = (pair if double else symbols)[rows]
        turn = np.argsort(front, kind="stable")
        front, block, rows = front[turn], block[turn], (two if double else step)[rows[turn]]
        new = np.ones(len(rows) + 1, bool)
        new[1:-1] = (front[1:] != front[:-1]) | (block[1:] != block[:-1])
        shared = ~(new[:-1] & new[1:])  # not alone in its block
        block = np.cumsum(new[:-1], dtype=np.int32)[shared]
        rows = rows[shared]
        depth += 2 if double else 1
    return text[rows], sizes[text[rows]] - size[rows], block


def _ranges(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop, anchor) of a list column of ranges; anchor is _NONE where it is null."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    start, stop, anchor = column.flatten().flatten()
    whole = lambda a: a.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), lengths), whole(start), whole(stop), whole(pc.fill_null(anchor, _NONE))


def _shards(length: int, buckets: int):
    """Documents with the ranges of their partly repeated pieces -> a transform for each bucket and set of documents, and the
    places of hot anchors' strings that repeat among the task's own (bucket below 0)."""

    def run(batches):
        held, strings, size = {}, [], 0

        def flush():
            nonlocal size
            rows = []
            if strings:
                key, doc, start, body = (np.concatenate(x) for x in zip(*strings, strict=True))
                first, later = _earliest(key, doc, start)
                if len(later):
                    rows.append((-1 - TaskContext.get().partitionId() % 1024, b"", b"", _raw(doc[later], np.int64), _raw(start[later], np.int64)))
                for i in first:
                    held.setdefault(int(key[i] % _U(buckets)), []).append((doc[i], start[i], body[i]))
            for bucket, found in held.items():
                out, ends = transform([f[2] for f in found])
                rows.append((bucket, _raw(out, np.uint8), _raw(ends, np.int32), _raw(np.array([f[0] for f in found]), np.int64), _raw(np.array([f[1] for f in found]), np.int64)))
            held.clear()
            strings.clear()
            size = 0
            return _batch(rows, _SHARDS)

        for batch in batches:
            row, start, stop, anchor = _ranges(batch.column(2))
            partly = anchor != _NONE
            row, start, stop, anchor = row[partly], start[partly], stop[partly], anchor[partly]
            bucket = (tk.mixed(anchor.view(np.uint64)) % _U(buckets)).astype(np.int64)
            docs, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for r in range(batch.num_rows):
                data = np.frombuffer(texts[r].as_buffer(), np.uint8)
                for i in range(cuts[r], cuts[r + 1]):
                    part = data[start[i] : stop[i]]
                    if anchor[i] >= 0:
                        held.setdefault(int(bucket[i]), []).append((docs[r], start[i], part))
                        size += len(part)
                    else:
                        at = np.arange(len(part) - length + 1)
                        strings.append((tk.spans(tk.prefix_hash(part), at, at + length), np.full(len(at), docs[r]), start[i] + at, np.lib.stride_tricks.sliding_window_view(part, length)))
                        size += len(at) * length
                if size >= SHARD_BYTES:
                    yield flush()
        yield flush()

    return run


def _merge(length: int):
    def run(table: pa.Table) -> pa.Table:
        columns = [table[c].to_pylist() for c in ("transform", "ends", "docs", "starts")]
        none = lambda n: pa.nulls(n, pa.int64())
        if table["bucket"][0].as_py() < 0:
            docs, starts = (np.concatenate([np.frombuffer(x, np.int64) for x in columns[i]]) for i in (2, 3))
            d, s, e = _united(docs, starts, starts + length)
            return pa.table([pa.array(d), pa.array(s), pa.array(e), none(len(d))], schema=_MARKS)
        docs, starts = (np.concatenate([np.frombuffer(x, np.int64) for x in columns[i]]) for i in (2, 3))
        shards = [(np.frombuffer(t, np.uint8), np.frombuffer(e, np.int32).astype(np.int64), len(d) // 8) for t, e, d in zip(*columns[:3], strict=True)]
        text, offset, interval = merged_intervals(shards, length)
        if not len(text):
            return pa.Table.from_batches([_batch([], _MARKS)])
        doc, start = docs[text], starts[text] + offset
        order = np.lexsort((start, doc, interval))
        interval, doc, start = interval[order], doc[order], start[order]
        new = np.concatenate(([True], interval[1:] != interval[:-1]))
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[lead]) | (start != start[lead])
        doc, start = doc[later], start[later]
        d, s, e = _united(doc, start, start + length)
        return pa.table([pa.array(d), pa.array(s), pa.array(e), none(len(d))], schema=_MARKS)

    return run


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(with_bytes: bool):
    def run(batches):
        for batch in batches:
            rows = []
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            found = [_ranges(batch.column(i)) for i in (2, 3)]
            row, start, stop = (np.concatenate([f[i][f[3] == _NONE] for f in found]) for i in range(3))
            order = np.argsort(row, kind="stable")
            start, stop = start[order], stop[order]
            cuts = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            for r, doc in enumerate(docs):
                data = np.frombuffer(texts[r].as_buffer(), np.uint8)
                a, b = cuts[r], cuts[r + 1]
                change = np.bincount(start[a:b], minlength=len(data) + 1) - np.bincount(stop[a:b], minlength=len(data) + 1)
                gone = np.cumsum(change)[:-1] > 0
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and bool(gone[0])))
                kept = data[~gone].tobytes()
                rows.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            yield _batch(rows, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]))

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, with_bytes: bool = False, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``; with ``with_bytes`` also ``kept``, the
    bytes that remain.

    Texts are UTF-8 bytes, null is empty; matches never cross documents. Equal rows that repeat an id count as one document
    and each gets its result. Rows that repeat an id with different texts are documents in the order of their text hashes; rows without an
    id come after all others, in that order too. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    by_id = rows.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("least"), F.max(F.xxhash64("text")).alias("most"), F.sum(F.octet_length("text")).alias("n"))
    n_bytes, doubtful = by_id.agg(F.sum("n"), F.count_if((F.col("least") != F.col("most")) | F.col("doc_id").isNull())).first()
    if not doubtful:
        return _deduped(rows, rows, length, with_bytes, hot_bytes, n_bytes or 0)
    # each text of an id gets a number that stands for it
    own = rows.withColumn("body", F.sha2("text", 256))
    numbers = stored(numbered(own.select("doc_id", "body").distinct(), [], [F.asc_nulls_last("doc_id"), F.col("body")], "number"), "numbers")
    named = stored(beside(own, numbers, ["doc_id", "body"]).select(F.col("number").alias("doc_id"), "text"), "numbered")
    out = _deduped(named, named, length, with_bytes, hot_bytes, n_bytes or 0)
    known = numbers.select(F.col("doc_id").alias("id"), F.col("number").alias("doc_id"))
    return out.join(known, "doc_id").select(F.col("id").alias("doc_id"), *(c for c in out.columns if c != "doc_id"))


def _unsearched(rows: DataFrame, with_bytes: bool) -> DataFrame:
    """Rows as they are, in the columns of dedup."""
    zero = F.lit(0).cast("long")
    same = [F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")]
    return rows.select("*", *same, *([F.col("text").alias("kept")] if with_bytes else []))


def _deduped(rows: DataFrame, known: DataFrame, length: int, with_bytes: bool, hot_bytes: int, n_bytes: int) -> DataFrame:
    bits = max(6, (n_bytes // BUCKET_BYTES).bit_length())
    dealt = known.mapInArrow(_deal(length, bits), "bucket long, anchors binary, hashes binary, docs binary, starts binary, counts binary")
    marks = stored(dealt.groupBy("bucket").applyInArrow(_whole(length, hot_bytes), "doc_id long, start long, stop long, anchor long"), "marks")
    by_doc = marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "anchor")).alias("marks"))
    touched = stored(known.join(by_doc, "doc_id"), "touched")

    some = F.exists("marks", lambda m: m["anchor"].isNotNull())
    size = F.col("stop") - F.col("start")
    partly = marks.where("anchor is not null").agg(F.sum(F.when(F.col("anchor") >= 0, size).otherwise((size - length + 1) * length))).first()[0] or 0
    buckets = max(16, partly // MERGE_BYTES)
    shards = touched.where(some).select("doc_id", "text", "marks").mapInArrow(_shards(length, buckets), "bucket long, transform binary, ends binary, docs binary, starts binary")
    more = shards.groupBy("bucket").applyInArrow(_merge(length), "doc_id long, start long, stop long, anchor long")
    more = stored(more.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "anchor")).alias("more")), "more")
    cut = touched.join(more, "doc_id", "left").select("doc_id", "text", "marks", "more").mapInArrow(_cut(with_bytes), _KEPT)
    cut = cut.dropDuplicates(["doc_id"]).select("doc_id", *(F.col(c).alias(f"new_{c}") for c in ("n_removed", "n_spans", "kept_sha256", "kept")))
    same = _unsearched(rows, with_bytes).drop("text")
    return same.join(cut, "doc_id", "left").select("doc_id", "n_bytes", *(F.coalesce(f"new_{c}", c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", *(["kept"] if with_bytes else []))))

"""Operator 7: sum-of-squares online packing of documents into token windows.

A document's token ids (its text's and one end id) are cut into full windows and a rest. The rest goes where the sum over
the fill levels of the squared number of partially filled windows grows least: ``counts[level]`` is the only state the
choice needs, so a placement costs one look at a level array of ``capacity`` numbers.

Each task packs the documents it reads, in one pass. The windows that it leaves open (``max_open`` at most at a time) are
handed on as a unit; ``FAN`` units meet in one group, which places their pieces anew by the same rule, longest first, and
leaves about as few open as one task would have. The last group, and groups that no longer get fewer (say, all rests fill two thirds of a window),
lay the pieces of their open windows end to end and cut them at window ends, so that one sequence at most is padded there.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import textkernel as tk
from tesserae.sources.stored import stored

#: Characters whose classes are the same in every Unicode release that a tokenizer library may carry.
_USUAL = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ‐-‧]")
#: Longest run of word bytes, or of white space, that the rank coder gets.
_RUN = 2000
#: Units of open windows that meet in one group.
FAN = 8


@lru_cache(2)
def _coders(vocabulary: str, ranks: str | None):
    slow = Tokenizer.from_file(vocabulary)
    fast = None
    if ranks:
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
    return slow, fast


def token_ids(column: pa.Array, vocabulary: str, ranks: str | None = None):
    """The uint32 ids of each text (null: none), as ``tokenizers`` gives them for ``vocabulary`` without added tokens.

    ``ranks`` names the same vocabulary as byte ranks; texts of usual characters are then coded by it, several times as
    fast and to the same ids. Others, and texts with very long runs, take the vocabulary itself.
    """
    slow, fast = _coders(vocabulary, ranks)
    for lo, hi, data, offsets in tk.chunks(column):
        texts = column.slice(lo, hi - lo).to_pylist()
        starts, ends, first = tk.word_bounds(data, offsets)
        for row, text in enumerate(texts):
            if not text:
                yield np.zeros(0, np.uint32)
                continue
            if fast is not None and not _USUAL.search(text):
                a, b = first[row], first[row + 1]
                marks = np.concatenate(([offsets[row]], np.stack((starts[a:b], ends[a:b]), 1).reshape(-1), [offsets[row + 1]]))
                if np.diff(marks).max() <= _RUN:
                    yield fast.encode_to_numpy(text, allowed_special="all")
                    continue
            yield np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Levels:
    """Open windows by fill level, and the sum-of-squares rule over their counts."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def choose(self, size: int) -> int:
        """The level (0: a new window) that ``size`` should be added to; of equals the fullest."""
        top = self.capacity - size
        after = np.where(np.arange(size, self.capacity + 1) < self.capacity, 2 * self.counts[size:] + 1, 0)
        cost = after - 2 * self.counts[: top + 1] + 1
        cost[0] = after[0]
        cost[1:][self.counts[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def place(self, piece: tuple) -> list | None:
        """Put a piece (its ids last) into a window; returns the window's pieces if that is full now."""
        size = len(piece[-1])
        level = self.choose(size)
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.open.setdefault(level + size, []).append(window)
        self.counts[level + size] += 1
        self.n_open += 1
        return None

    def taken(self) -> list[list]:
        """All open windows, fullest first; none is open afterwards."""
        windows = [window for level in sorted(self.open, reverse=True) for window in self.open[level]]
        self.counts[:] = 0
        self.open.clear()
        self.n_open = 0
        return windows

    def drain(self) -> list[list]:
        """All open windows, laid end to end and cut at window ends; fullest first. None is open afterwards."""
        pieces = [p for window in self.taken() for p in window]
        windows, window, room = [], [], self.capacity
        for doc, start, total, ids in pieces:
            while len(ids):
                part = ids[:room]
                window.append((doc, start, total, part))
                start, ids, room = start + len(part), ids[room:], room - len(part)
                if not room:
                    windows.append(window)
                    window, room = [], self.capacity
        return windows + [window] * bool(window)


_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_OPEN = pa.schema([("unit", pa.int64()), ("number", pa.int64()), *((n, pa.list_(pa.int64())) for n in ("docs", "starts", "totals", "lengths")), ("held", pa.binary())])


class _Out:
    """Rows of closed windows (pieces) and of open ones (handed on), in one schema; sequence_id is null for the latter."""

    def __init__(self, number: int, unit: int, with_ids: bool):
        self.number, self.unit = number, unit
        self.schema = pa.schema([*_PIECES, *([("ids", pa.list_(pa.int32()))] if with_ids else []), *_OPEN])
        self.with_ids, self.rows = with_ids, []

    def close(self, window: list[tuple]) -> None:
        offset = 0
        for doc, start, total, ids in window:
            row = (doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, self.number, offset)
            self.rows.append((*row, *([ids.astype(np.int32)] if self.with_ids else []), *[None] * len(_OPEN)))
            offset += len(ids)
        self.number += 1

    def hand_on(self, windows: list[list]) -> None:
        for n, window in enumerate(windows):
            docs, starts, totals, ids = zip(*window, strict=True)
            held = np.concatenate(ids).astype("<u4").tobytes()
            self.rows.append((*[None] * (len(self.schema) - len(_OPEN)), self.unit, n, list(docs), list(starts), list(totals), [len(i) for i in ids], held))
        self.unit += 1

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(self.schema)
        made = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows.clear()
        return made


def _first(capacity, vocabulary, ranks, end_id, max_open, with_ids):
    def run(batches):
        task = TaskContext.get().partitionId()
        levels, out = Levels(capacity), _Out(task << 32, task << 20, with_ids)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for doc, ids in zip(names, token_ids(batch.column(1), vocabulary, ranks), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                total, start = len(ids), 0
                while total - start >= capacity:
                    out.close([(doc, start, total, ids[start : start + capacity])])
                    start += capacity
                if start < total and (full := levels.place((doc, start, total, ids[start:].copy()))):
                    out.close(full)
                if levels.n_open > max_open:
                    out.hand_on(levels.taken())
                if len(out.rows) >= 5000:
                    yield out.batch()
        out.hand_on(levels.taken())
        yield out.batch()
        tk.release()

    return run


def _further(capacity, turn, last, max_open, with_ids):
    """Open windows of one group: their pieces are placed by the rule once more, longest first, and what stays open is laid
    end to end if that is the ``last`` turn."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("unit", "ascending"), ("number", "ascending")])
        group = table["group"][0].as_py()
        levels, out = Levels(capacity), _Out((turn << 56) | (group << 32), group << 20, with_ids)
        pieces = []
        for docs, starts, totals, lengths, held in zip(*(table[n].to_pylist() for n in ("docs", "starts", "totals", "lengths", "held")), strict=True):
            pieces += zip(docs, starts, totals, np.split(np.frombuffer(held, "<u4"), np.cumsum(lengths)[:-1]), strict=True)
        for piece in sorted(pieces, key=lambda p: -len(p[-1])):
            if full := levels.place(piece):
                out.close(full)
            if levels.n_open > max_open and not last:
                out.hand_on(levels.taken())
        if last:
            for window in levels.drain():
                out.close(window)
        else:
            out.hand_on(levels.taken())
        return pa.Table.from_batches([out.batch()])

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    vocabulary: str | None = None,
    ranks: str | None = None,
    end_id: int = 1,
    max_open: int = 2048,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and with
    ``with_ids`` the piece's ids as an array.

    Every id lies in exactly one piece; a sequence's pieces lie gapless from offset 0 and hold ``capacity`` ids but in
    the last sequence of a last group (one, where open windows come down to one group). sequence_id is the task's number
    times 2**32 plus a count, with the turn of packing above 2**56. Null and empty texts are their end id alone; repeated
    rows are packed each; a null id stays null; other columns are ignored; an empty table gives no rows. A very long text
    is one document of many full windows. ``vocabulary`` and ``ranks`` name the tokenizer's files (on every machine; by
    default the public 50k byte-level vocabulary).
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or (public_tokenizers.path("byte_bpe_50k.tiktoken") if vocabulary.endswith("byte_bpe_50k.json") else None)
    names = [*_PIECES.names, *(["ids"] if with_ids else [])]
    kinds = ", ".join([*(f"{n} long" for n in _PIECES.names), *(["ids array<int>"] if with_ids else []), "unit long, number long", *(f"{n} array<long>" for n in ("docs", "starts", "totals", "lengths")), "held binary"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = stored(rows.mapInArrow(_first(capacity, vocabulary, ranks, end_id, max_open, with_ids), kinds), "packed")
    pieces, turn, before = made.where("sequence_id is not null").select(names), 0, None
    while n_units := made.select("unit").where("unit is not null").distinct().count():
        turn, groups = turn + 1, -(-n_units // FAN)
        last = groups == 1 or (before is not None and 2 * n_units > before)
        grouped = made.where("sequence_id is null").withColumn("group", F.pmod(F.xxhash64("unit"), F.lit(groups)))
        made = stored(grouped.select("group", *_OPEN.names).groupBy("group").applyInArrow(_further(capacity, turn, last, max_open, with_ids), kinds), "packed")
        pieces, before = pieces.unionByName(made.where("sequence_id is not null").select(names)), n_units
    return pieces


def sequences(pieces: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_ids, ids): the windows of ``pack(..., with_ids=True)``, padded to ``capacity``."""
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), ids.alias("ids"))
    return whole.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), (capacity - F.col("n_ids")).cast("int"))))

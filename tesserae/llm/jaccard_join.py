"""Operator 5: n-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. It is cut into fragments (ranges of that order):

1. documents with equal sets are one node, named by a 64-bit hash of the set, so copies are never expanded to pairs;
2. every node's n-grams go, packed, to the fragments they lie in. A fragment counts how often each of its n-grams stands
   and returns those that stand twice or oftener, with that count. There are as many fragments as the counted n-grams need
   for ``FRAGMENT`` n-grams each. An n-gram that ``OFTEN`` sets or more of one chunk of documents hold goes to its fragment once
   for the chunk, with their number, while the chunk keeps who holds it; so an n-gram of a third of all documents is a row a
   chunk there, not a row a document;
3. a set of n n-grams can only reach the threshold if at least ``ceil(t * n)`` of its n-grams are shared at all. For those
   that do, the rarest ``n - ceil(t * n) + 1`` are its prefix; two nodes that link share a prefix n-gram;
4. candidate pairs are verified exactly: the sets are cut into fragments, each fragment's task counts the overlaps of its
   part of the sets (a part travels once to each block of pairs that asks for it), and the partial counts, not the sets,
   are summed per pair;
5. first each node is held against a leader (the most central member of a prefix list) and against its pivot, the leader
   that following leaders ends at; what this links is merged to components. Then all pairs of a prefix list that still lie
   in different components are verified, but for those that their overlaps with a common pivot rule out: what x and y have
   in common is at most the smaller of what either shares with that pivot plus what both share beside it, and the latter is
   counted on the n-grams that the pivot lacks. So a large group of near copies costs about one pair a copy, and no link
   between different components is lost. Long lists are split into blocks of ``LIST`` members.

Keys that hold very many rows (sets with many copies, large components) are looked up in a broadcast table of at most
``HOT`` rows, all others by a shuffle. Hash collisions (64 bits) are the only approximation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import textkernel as tk
from tesserae.operators.graph import components
from tesserae.sources.stored import removed, stored

#: n-grams that a task packs before it hands them on (7 bytes each and 2 for the document), and documents of such a chunk.
FLUSH, CHUNK = 1_000_000, 65_000
#: Sets of a chunk that hold an n-gram, from which on it is counted in the chunk.
OFTEN = 16
#: n-grams of a fragment, about.
FRAGMENT = 2_000_000
#: Fragments in which the overlap of a candidate pair is counted, and pairs of a block.
VERIFY_BITS, PAIRS = 2, 40_000
#: Members of a block of a prefix list.
LIST = 2_000
#: Rows of a broadcast table of hot keys, at most.
HOT = 5_000

_U = np.uint64


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct hashes of its k-word shingles); a shorter text has its whole word sequence as one."""
    for lo, hi, data, offsets in tk.chunks(column):
        data = tk.LOWER[data]
        starts, ends, first = tk.word_bounds(data, offsets)
        words = tk.spans(tk.prefix_hash(data), starts, ends)
        grams = tk.windows(words, k)
        for row in range(hi - lo):
            a, b = first[row], first[row + 1]
            if b - a >= k:
                found = np.sort(grams[a : b - k + 1])
                yield lo + row, found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif b > a:
                yield lo + row, tk.windows(words[a:b], int(b - a)) ^ _U(b - a)
            else:
                yield lo + row, np.zeros(0, np.uint64)


def _key(found: np.ndarray) -> int:
    """The node of a set: a sum of mixed hashes, the same for the same n-grams in whatever order."""
    return int(tk.mixed(found).sum(dtype=np.uint64).astype(np.int64))


def _summary(k: int):
    def run(batches):
        for batch in batches:
            n, keys = [], []
            for _, found in shingle_sets(batch.column(1), k):
                n.append(len(found))
                keys.append(_key(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "n_shingles", "node"])
        tk.release()

    return run


def _raw(x: np.ndarray, kind=None) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _low(grams: np.ndarray) -> bytes:
    """The low seven bytes of each hash; the fragment holds the others (it has eight bits or more)."""
    return np.ascontiguousarray(grams).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _whole(raw: bytes, high: int) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view(np.uint64) | _U(high)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


#: Of a chunk: its documents (fragment below 0: nodes and set sizes), what they hold of each fragment (place of the document in
#: the chunk and n-gram), how many of them hold its frequent n-grams (``times``), and who holds these (fragment below 0, ``own``).
_PACKED = pa.schema([("fragment", pa.int64()), ("chunk", pa.int64()), ("docs", pa.binary()), ("grams", pa.binary()), ("often", pa.binary()), ("times", pa.binary()), ("own", pa.bool_())])
#: Back at the chunk: documents (heads), shared n-grams with their holders and counts (found), counts of frequent ones (no docs), and
#: frequent ones with how many hold each (times) and their holders in that order.
_SHARED = pa.schema([("chunk", pa.int64()), ("heads", pa.bool_()), ("docs", pa.binary()), ("grams", pa.binary()), ("found", pa.binary()), ("times", pa.binary())])
_NODES = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("centre", pa.float64()), ("shared", pa.int64()), ("parts", pa.list_(pa.binary())), ("prefix", pa.list_(pa.int64()))])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double", pa.list_(pa.binary()): "array<binary>", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _deal(k: int, bits: int, flush_at: int, chunk_docs: int, often: int):
    """Documents -> for each chunk of them its documents, and one row for each fragment; equal sets of a chunk once."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        nodes, sets, held = {}, [], 0

        def flush():
            nonlocal seq, held
            rows, chunk = [], (part << 32) | seq
            if held:
                sizes = np.array([len(x) for x in sets], np.int32)
                rows.append((-1 - chunk % 1024, chunk, _raw(np.fromiter(nodes, np.int64)), _raw(sizes), None, None, False))
                grams = np.concatenate(sets)
                doc = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
                order = np.argsort(grams, kind="stable")
                grams, doc = grams[order], doc[order]
                first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
                times = np.diff(np.append(first, len(grams)))
                many = times >= often
                hot, hot_times = grams[first[many]], times[many]
                if len(hot):
                    held_often = np.repeat(many, times)
                    rows.append((-1 - chunk % 1024, chunk, _raw(doc[held_often]), _raw(hot), None, _raw(hot_times, np.uint32), True))
                    grams, doc = grams[~held_often], doc[~held_often]
                cut = lambda x: np.searchsorted(x >> _U(64 - bits), np.arange(1 << bits, dtype=np.uint64))
                at, hot_at = np.append(cut(grams), len(grams)), np.append(cut(hot), len(hot))
                for f in np.flatnonzero((np.diff(at) > 0) | (np.diff(hot_at) > 0)):
                    a, b, c, d = at[f], at[f + 1], hot_at[f], hot_at[f + 1]
                    rows.append((int(f), chunk, _raw(doc[a:b]), _low(grams[a:b]), _low(hot[c:d]), _raw(hot_times[c:d], np.uint32), False))
                seq += 1
            nodes.clear()
            sets.clear()
            held = 0
            return _rows(rows, _PACKED)

        for batch in batches:
            for _, found in shingle_sets(batch.column(0), k):
                if len(found) and (node := _key(found)) not in nodes:
                    nodes[node] = None
                    sets.append(found)
                    held += len(found)
                if held >= flush_at or len(sets) >= chunk_docs:
                    yield flush()
        yield flush()
        tk.release()

    return run


def _count(bits: int):
    """One fragment: keeps the n-grams that stand twice or oftener, with that count. Documents of chunks pass through."""

    def run(table: pa.Table) -> pa.Table:
        fragment = table["fragment"][0].as_py()
        chunks, docs = table["chunk"].to_pylist(), table["docs"].to_pylist()
        if fragment < 0:
            return pa.Table.from_batches([_rows([(c, not own, d, g, None, t) for c, d, g, t, own in zip(chunks, docs, *(table[n].to_pylist() for n in ("grams", "times", "own")), strict=True)], _SHARED)])
        high = fragment << (64 - bits)
        parts = [_whole(x, high) for x in table["grams"].to_pylist()]
        often = [_whole(x, high) for x in table["often"].to_pylist()]
        times = [np.frombuffer(x, np.uint32) for x in table["times"].to_pylist()]
        grams = np.concatenate([*parts, *often])
        weight = np.concatenate([np.ones(sum(map(len, parts)), np.int64), *(t.astype(np.int64) for t in times)])
        order = np.argsort(grams, kind="stable")
        ordered = grams[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        found = np.empty(len(grams), np.int64)
        found[order] = np.repeat(np.add.reduceat(weight[order], first), np.diff(np.append(first, len(ordered))))
        found = np.minimum(found, 2**32 - 1).astype(np.uint32)
        rows, at = [], 0
        for chunk, doc, part in zip(chunks, docs, parts, strict=True):
            own = found[at : at + len(part)]
            at += len(part)
            keep = own > 1
            if keep.any():
                rows.append((chunk, False, _raw(np.frombuffer(doc, np.uint16)[keep]), _raw(part[keep]), _raw(own[keep]), None))
        for chunk, part in zip(chunks, often, strict=True):
            if len(part):
                rows.append((chunk, False, None, _raw(part), _raw(found[at : at + len(part)]), None))
            at += len(part)
        return pa.Table.from_batches([_rows(rows, _SHARED)])

    return run


def _assemble(percent: int):
    """One chunk of documents: those that share enough, with their shared n-grams by fragment and their prefix."""

    def run(table: pa.Table) -> pa.Table:
        heads = table["heads"].to_pylist()
        columns = [table[n].to_pylist() for n in ("docs", "grams", "found", "times")]
        nodes, sizes = next((np.frombuffer(d, np.int64), np.frombuffer(g, np.int32)) for h, d, g in zip(heads, *columns[:2], strict=True) if h)
        if all(heads):
            return pa.Table.from_batches([_rows([], _NODES)])
        rest = [row for row, h in zip(zip(*columns, strict=True), heads, strict=True) if not h]
        joined = lambda rows, i, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(row[i], kind) for row in rows)])
        shared, told, holders = [r for r in rest if r[0] is not None and r[2] is not None], [r for r in rest if r[0] is None], [r for r in rest if r[2] is None]
        docs, grams, found = joined(shared, 0, np.uint16), joined(shared, 1, np.uint64), joined(shared, 2, np.uint32)
        if holders:
            known, totals = joined(told, 1, np.uint64), joined(told, 2, np.uint32)
            own = np.repeat(joined(holders, 1, np.uint64), joined(holders, 3, np.uint32))
            order = np.argsort(known)
            docs, grams = np.concatenate([docs, joined(holders, 0, np.uint16)]), np.concatenate([grams, own])
            found = np.concatenate([found, totals[order][np.searchsorted(known[order], own)]])
        if not len(docs):
            return pa.Table.from_batches([_rows([], _NODES)])
        order = np.lexsort((grams, found, docs))
        docs, grams, weight = docs[order], grams[order], np.log(found[order])
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(docs)) + 1, [len(docs)]))
        bounds = np.arange(1, 1 << VERIFY_BITS, dtype=np.uint64) << _U(64 - VERIFY_BITS)
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n = int(sizes[docs[a]])
            if 100 * (b - a) >= percent * n:
                need = -(-percent * n // 100)
                ordered = np.sort(grams[a:b])
                parts = [_raw(x) for x in np.split(ordered, np.searchsorted(ordered, bounds))]
                rows.append((int(nodes[docs[a]]), n, float(weight[a:b].sum()) / n, int(b - a), parts, grams[a : a + (b - a) - need + 1].view(np.int64)))
        return pa.Table.from_batches([_rows(rows, _NODES)])

    return run


def _paired(table: pa.Table) -> Iterator[tuple]:
    """(a, na, b, nb, part of a, part of b) of the pairs of one block and fragment."""
    a, na, b, nb, grams = (table[n].to_pylist() for n in ("a", "na", "b", "nb", "grams"))
    parts = {x: np.frombuffer(g, np.uint64) for x, y, g in zip(a, b, grams, strict=True) if y is None}
    for x, nx, y, ny in zip(a, na, b, nb, strict=True):
        if y is not None:
            yield x, nx, y, ny, parts[x], parts[y]


def _inside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of ``x`` whether it is in ``y`` (both ascending)."""
    if not len(x) or not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _common(table: pa.Table) -> pa.Table:
    rows = []
    for a, na, b, nb, x, y in _paired(table):
        if len(x) > len(y):
            x, y = y, x
        if n := int(np.count_nonzero(_inside(x, y))):
            rows.append((a, na, b, nb, n))
    return pa.Table.from_batches([_rows(rows, pa.schema([(n, pa.int64()) for n in ("a", "na", "b", "nb", "common")]))])


def _lacking(table: pa.Table) -> pa.Table:
    rows = [(a, b, x[~_inside(x, y)].view(np.int64)) for a, _, b, _, x, y in _paired(table)]
    return pa.Table.from_batches([_rows(rows, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("lacks", pa.list_(pa.int64()))]))])


def _by_fragment(pairs: DataFrame, nodes: DataFrame):
    """The pairs (a, na, b, nb), a stored table, with the parts of their sets: grouped by block of pairs and fragment."""
    blocks = max(1, -(-pairs.count() // PAIRS))
    asked = pairs.select(F.pmod(F.xxhash64("a", "b"), F.lit(blocks)).alias("block"), "a", "na", "b", "nb")
    who = asked.select("block", F.col("a").alias("node")).unionByName(asked.select("block", F.col("b").alias("node"))).distinct()
    none = F.lit(None).cast("long")
    parts = who.join(nodes.select("node", "parts"), "node").select("block", F.col("node").alias("a"), none.alias("na"), none.alias("b"), none.alias("nb"), F.posexplode("parts").alias("fragment", "grams"))
    links = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << VERIFY_BITS) - 1))).alias("fragment"), F.lit(None).cast("binary").alias("grams"))
    return parts.unionByName(links).groupBy("block", "fragment")


def _overlaps(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs with the size of their common set: overlaps counted in each fragment, summed per pair; none for 0."""
    partial = _by_fragment(pairs, nodes).applyInArrow(_common, "a long, na long, b long, nb long, common long")
    return partial.groupBy("a", "na", "b", "nb").agg(F.sum("common").alias("common"))


def _looked_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table`` (unique ``key``, and ``held``: how many rows have it), null where it has no row.

    Keys of ``total / HOT`` rows or more, at most HOT of them, are broadcast, so that none is one task's work.
    """
    least = max(1000, -(-total // HOT))
    hot = F.broadcast(table.where(F.col("held") >= least).drop("held"))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col("held") < least).drop("held").hint("merge"), key, "left")
    return rows.join(hot, key).unionByName(rest)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    A document's set holds its distinct ``k``-word shingles (A-Z lower-cased, words split at ASCII white space); with
    fewer words the whole sequence. Two documents link when ``100 * |intersection| >= percent * |union|``;
    component_id is the smallest id reachable by links, the document's own included.

    Null or blank texts have an empty set and link with nothing. Every row is a document of its own, also where rows repeat
    an id (equal or not) or have none: a row's component_id is the smallest id of all rows that it reaches, null if none
    has one. Other columns are ignored, an empty table gives no rows. ``docs`` should be a plan that returns the same rows
    in the same order when a task is repeated, such as a table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    summary = stored(rows.mapInArrow(_summary(k), "doc_id long, n_shingles long, node long"), "sets")
    total, n_grams = summary.agg(F.count("*"), F.sum("n_shingles")).first()
    classes = stored(summary.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("held")), "classes")

    bits = max(8, ((n_grams or 0) // FRAGMENT).bit_length())
    packed = rows.select("text").mapInArrow(_deal(k, bits, FLUSH, CHUNK, OFTEN), _ddl(_PACKED))
    shared = packed.groupBy("fragment").applyInArrow(_count(bits), _ddl(_SHARED))
    able = shared.groupBy("chunk").applyInArrow(_assemble(percent), _ddl(_NODES))
    nodes = stored(able.dropDuplicates(["node"]), "nodes")

    prefixes = nodes.select("node", "n", "centre", F.explode("prefix").alias("gram"))
    lists = prefixes.groupBy("gram").agg(F.count("*").alias("held"), F.max(F.struct("centre", F.bitwise_not("node").alias("order"), "node", "n")).alias("lead")).where("held > 1")
    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    linked = f"100 * common >= {percent} * (na + nb - common)"
    leaders = lists.select("gram", F.col("lead.node").alias("b"), F.col("lead.n").alias("nb"), F.col("lead.centre").alias("centre_b"))
    led = (
        prefixes.join(leaders, "gram")
        .where("node <> b")
        .groupBy(F.col("node").alias("a"), F.col("n").alias("na"), "b", "nb", "centre_b")
        .agg(F.count("*").alias("lists"))
        .groupBy("a", "na")
        .agg(
            F.max_by(F.struct("b", "nb"), F.when(F.expr(fits), F.struct("lists", F.bitwise_not("b")))).alias("best"),
            F.max_by(F.struct("b", "nb"), F.struct("centre_b", F.bitwise_not("b"))).alias("pivot"),
        )
    )
    led = stored(led, "led")
    # a leader is more central than what it leads, so following leaders ends; three joins follow eight
    pivot = led.select("a", "na", "pivot.b", "pivot.nb")
    for _ in range(3):
        after = pivot.select(F.col("a").alias("b"), F.struct("b", "nb").alias("next"))
        pivot = pivot.join(after, "b", "left").select("a", "na", F.coalesce("next.b", "b").alias("b"), F.coalesce("next.nb", "nb").alias("nb"))
    pivot = stored(pivot, "pivots")
    asked = stored(led.where("best is not null").select("a", "na", "best.b", "best.nb").unionByName(pivot).distinct(), "asked")
    held = stored(_overlaps(asked, nodes), "leaders", asked)
    first = held.where(linked).select("a", "b")
    merged = components(first)

    # how far a node reaches into its pivot (a node that nothing leads: itself)
    pivots = (
        nodes.select("node", "shared")
        .join(pivot.select(F.col("a").alias("node"), "b"), "node", "left")
        .join(held.select(F.col("a").alias("node"), "b", "common"), ["node", "b"], "left")
        .join(merged, "node", "left")
        .select(
            "node",
            F.coalesce("b", "node").alias("pivot"),
            F.expr("if(b is null, shared, coalesce(common, 0))").alias("inside"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    placed = stored(prefixes.select("gram", "node", "n").join(lists.select("gram"), "gram").join(pivots, "node"), "placed")
    by_part = placed.groupBy("gram", "component").agg(F.count("*").alias("held"))
    mixed = by_part.groupBy("gram").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("held", "component")).alias("main"), F.sum("held").alias("held")).where("parts > 1").select("gram", "main", "held")
    member = F.struct("node", "n", "component", "pivot", "inside")
    blocks = F.ceil(F.col("held") / LIST).cast("int")
    open_lists = stored(placed.join(mixed, "gram").select("gram", "main", blocks.alias("blocks"), member.alias("node")), "open", placed)
    # a list's members lie in blocks, and each member asks all blocks of its list
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    own = F.pmod(F.xxhash64("node.node"), F.col("blocks")).cast("int").alias("block")
    x = open_lists.where("node.component <> main").select("gram", every, F.col("node").alias("x"))
    y = open_lists.select("gram", own, "main", F.col("node").alias("y"))
    apart = f"x.component <> y.component and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    # x and y with one pivot: what they have in common is at most what either has in it, plus what they share outside
    listed = x.join(y, ["gram", "block"]).where(
        f"{apart} and (y.component = main or x.node < y.node) and (x.pivot <> y.pivot"
        f" or 100 * least(x.inside, y.inside) >= {percent} * (x.n + y.n - least(x.inside, y.inside)))"
    )
    reaching = stored(open_lists.select("node").distinct().where("node.pivot <> node.node"), "reaching")
    to_pivot = reaching.select(F.col("node.node").alias("a"), F.col("node.n").alias("na"), F.col("node.pivot").alias("b"), F.col("node.n").alias("nb"))
    lacks = _by_fragment(to_pivot, nodes).applyInArrow(_lacking, "a long, b long, lacks array<long>").select("a", F.col("b").alias("pivot"), F.explode("lacks").alias("gram"))
    outside = stored(lacks, "lacking")
    often = outside.groupBy("pivot", "gram").agg(F.count("*").alias("held")).where("held > 1").select("pivot", "gram", blocks.alias("blocks"))
    outside = stored(outside.join(often, ["pivot", "gram"]).join(reaching, F.col("a") == F.col("node.node")).select("pivot", "gram", "blocks", "node"), "outside", outside)
    beside = (
        outside.select("pivot", "gram", every, F.col("node").alias("x"))
        .join(outside.select("pivot", "gram", own, F.col("node").alias("y")), ["pivot", "gram", "block"])
        .where(f"{apart} and x.node < y.node")
        .groupBy("x", "y")
        .agg(F.count("*").alias("more"))
        .where(f"100 * (least(x.inside, y.inside) + more) >= {percent} * (x.n + y.n - least(x.inside, y.inside) - more)")
    )
    rest = (
        listed.select("x", "y").unionByName(beside.select("x", "y"))
        .select(F.least("x.node", "y.node").alias("a"), F.expr("if(x.node < y.node, x.n, y.n)").alias("na"), F.greatest("x.node", "y.node").alias("b"), F.expr("if(x.node < y.node, y.n, x.n)").alias("nb"))
        .distinct()
    )
    rest = stored(rest, "rest", outside)
    second = _overlaps(rest, nodes).where(linked).select("a", "b")
    merged = components(first.unionByName(second))
    for table in (open_lists, reaching, rest, led, pivot):
        removed(table)

    joined = merged.join(classes, "node")
    least = joined.groupBy("component").agg(F.min("least").alias("reached"), F.count("*").alias("held"))
    reached = _looked_up(merged, least, "component", total).select("node", "reached")
    named = stored(classes.join(reached, "node", "left").select("node", F.coalesce("reached", "least").alias("component_id"), "held"), "named")
    found = _looked_up(summary.where("node is not null"), named, "node", total)
    return found.select("doc_id", "n_shingles", "component_id").unionByName(summary.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))

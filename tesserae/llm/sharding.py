"""Operator 2: sharding by balanced label propagation. DataFrame functions only.

Documents of one group (here: equal texts) are neighbours. They start dealt out by hash and move, round by round, to the
shard where most of their neighbours are, as far as that shard's quota allows:

* the members of a group that share a bucket of the id hash move together (a cell), so a group of any size is a bounded
  number of rows and its joins are salted by the bucket;
* each round joins the cells with their group's counts by shard. A cell prefers the shard with most neighbours (of equals, by
  an order that depends on the group), and moves only upwards in that order, so neighbours never swap places;
* what may move is a flow between shards: demands are summed to (from, to, gain class), a table of fixed size, and are
  admitted, greatest gain first, along closed ways between shards or ways that end in free room. Full shards so exchange
  documents freely. Where a class is admitted in part, a hash lets the fitting share go;
* a shard that lets nothing in is passed over for the next best; rounds go on until all are, or no cell has a wish left
  (less than one document in ``STILL`` counts as nothing);
* documents without neighbours cut no edge wherever they are. They, and what hash rounding put above a capacity, fill the
  shards up in the end, exactly: the law is ``rows``, shards differ by one document at most.

Places come from counts by (shard, bucket) and a rank within each, so no shard passes through one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.sources.stored import removed, stored

#: Parts of a group that move on their own.
CELLS = 256
#: A guard only; propagation ends when it is still.
ROUNDS = 40
STILL = 2_000
#: Classes of gain: its binary logarithm.
CLASSES = 48


def _count(array: Column, shard: Column) -> Column:
    return F.element_at(array, shard + 1)


def admitted_flow(demand: np.ndarray, room: np.ndarray) -> np.ndarray:
    """A part of ``demand`` (from, to, gain class) after which no shard holds more than its room allows, and to which
    nothing can be added.

    Documents move along closed ways between shards, which need no room, or along ways that end in free room. The wish of
    greatest gain goes first, each time along the shortest way that lets it in, until no way is left. What moves into room
    leaves as much room where it came from. Each step uses up a demand between two shards in one class, or a shard's room.
    """
    n, _, classes = demand.shape
    rest, free = demand.astype(np.float64), np.maximum(room, 0).astype(np.float64)

    def way(begin: int, end: int) -> list[int] | None:
        """Shards from ``begin`` to ``end``, or to -1 where the way ends in free room."""
        reached, queue = {begin: None}, [begin]
        for here in queue:
            if here == end or free[here] > 0:
                out = [] if here == end else [-1]
                while here is not None:
                    out.append(here)
                    here = reached[here]
                return out[::-1]
            for there in range(n):
                if there not in reached and rest[here, there].any():
                    reached[there] = here
                    queue.append(there)
        return None

    for c in reversed(range(classes)):
        for source, to in np.argwhere(rest[:, :, c] > 0):
            while rest[source, to, c] > 0 and (steps := way(int(to), int(source))) is not None:
                arcs = [(source, to, c)]
                arcs += [(x, y, int(np.flatnonzero(rest[x, y])[-1])) for x, y in zip(steps, steps[1:], strict=False) if y >= 0]
                most = min(rest[arc] for arc in arcs)
                if steps[-1] < 0:
                    most = min(most, free[steps[-2]])
                    free[steps[-2]] -= most
                    free[source] += most
                for arc in arcs:
                    rest[arc] -= most
    return demand - rest


def propagate(cells: DataFrame, n_shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """(group, cell, n, shard) of ``cells`` (group, cell, n) when propagation is still.

    ``capacity`` is the number of documents a shard may hold. Flows (``n_shards`` squared times ``CLASSES`` rows) are all that
    reaches the driver.
    """
    state = stored(cells.withColumn("shard", F.pmod(F.xxhash64("group", "cell"), F.lit(n_shards)).cast("int")), "cells")
    load = np.zeros(n_shards, np.int64)
    for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        load[r["shard"]] = r["n"]
    total, enterable = int(load.sum()), np.ones(n_shards, bool)
    for turn in range(rounds):
        around = state.groupBy("group").agg(F.array(*(F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)) for s in range(n_shards))).alias("held"))
        rank = lambda s: F.struct(_count(F.col("held"), F.lit(s)).alias("held"), F.pmod(F.crc32("group") + s, F.lit(n_shards)).alias("order"), F.lit(s).alias("shard"))
        inside = F.array(*(F.lit(bool(x)) for x in enterable))
        wishes = (
            state.join(around, "group")
            .withColumn("ranks", F.array(*(rank(s) for s in range(n_shards))))
            .withColumn("own", F.element_at("ranks", F.col("shard") + 1))
            .withColumn("best", F.array_max(F.filter("ranks", lambda r: F.element_at(inside, r["shard"] + 1))))
            .withColumn("moves", F.coalesce(F.col("best") > F.col("own"), F.lit(False)))
            .withColumn("gain", F.when(F.col("moves"), F.least(F.lit(CLASSES - 1), F.floor(F.log2(F.col("best.held") - F.col("own.held") + F.col("n") + 1)).cast("int"))))
            .select("group", "cell", "n", "shard", F.when(F.col("moves"), F.col("best.shard")).alias("to"), "gain")
        )
        wishes = stored(wishes, "wishes")
        demand = np.zeros((n_shards, n_shards, CLASSES))
        for r in wishes.where("to is not null").groupBy("shard", "to", "gain").agg(F.sum("n").alias("n")).collect():
            demand[r["shard"], r["to"], r["gain"]] = r["n"]
        flow = admitted_flow(demand, capacity - load)
        wanted, moved = demand.sum((0, 2)), flow.sum((0, 2))
        if moved.sum() * STILL <= total:
            removed(wishes)
            if not (wanted > 0).any():
                break
            enterable &= wanted == 0  # nothing gets in there: look for the next best
            continue
        share = np.divide(flow, demand, out=np.zeros_like(flow), where=demand > 0)
        shares = F.array(*(F.lit(float(x)) for x in share.reshape(-1)))
        place = (F.col("shard") * n_shards + F.col("to")) * CLASSES + F.col("gain") + 1
        drawn = F.pmod(F.xxhash64("group", "cell", F.lit(turn)), F.lit(1_000_003)) / 1_000_003
        state = stored(wishes.select("group", "cell", "n", F.when(drawn < F.element_at(shares, place), F.coalesce("to", "shard")).otherwise(F.col("shard")).alias("shard")), "cells", state)
        removed(wishes)
        load[:] = 0
        for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            load[r["shard"]] = r["n"]
        # a shard that took under half of what wanted in is closed for a round, so that its suitors look elsewhere
        enterable = moved * 2 >= wanted
    return state


def cut_share(sharded: DataFrame, group: str = "text_crc32", shard: str = "shard") -> float:
    """The share of neighbouring pairs (documents of one group) that lie in different shards."""
    held = sharded.groupBy(group, shard).agg(F.count("*").alias("n")).groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("inside"))
    pairs, inside = held.agg(F.sum(F.col("n") * (F.col("n") - 1)), F.sum("inside")).first()
    return 1 - inside / pairs if pairs else 0.0


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus one, ``slot`` is gapless from 0 in each shard, ``law`` is ``rows`` and
    grown_shard null (that law promises nothing about one more shard). Null texts count as empty; repeated rows and rows
    with a null id take places of their own; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = buckets or max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    # rows without an id are spread by their place in the table, which is read once
    salt = F.coalesce("doc_id", F.monotonically_increasing_id())
    rows = stored(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
            "doc_id",
            (F.octet_length("text") + 1).cast("long").alias("size"),
            F.crc32("text").alias("text_crc32"),
            F.unhex(F.md5("text")).alias("group"),
            F.pmod(F.xxhash64(salt), F.lit(CELLS)).cast("int").alias("cell"),
            F.pmod(F.xxhash64(salt, F.lit(1)), F.lit(buckets)).cast("int").alias("bucket"),
        ),
        "documents",
    )
    total = rows.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    cells = rows.groupBy("group", "cell").agg(F.count("*").alias("n"))
    linked = cells.groupBy("group").agg(F.sum("n").alias("members")).where("members > 1").select("group")
    placed = propagate(cells.join(linked, "group"), n_shards, total // n_shards)

    # n_shards stands for documents without a shard so far
    dealt = rows.join(placed.select("group", "cell", "shard"), ["group", "cell"], "left").withColumn("shard", F.coalesce("shard", F.lit(n_shards)))
    dealt = stored(dealt.drop("cell"), "dealt")
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    within = W.partitionBy("shard", "bucket").orderBy("doc_id", "group")
    numbered = dealt.withColumn("place", F.row_number().over(within) - 1).join(before, ["shard", "bucket"]).withColumn("place", F.col("place") + F.col("before"))

    held = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    # whatever is beyond a quota is numbered behind the documents without a shard
    surplus, offset = {}, held.get(n_shards, 0)
    for s in range(n_shards):
        surplus[s] = offset - quota[s]
        offset += max(0, held.get(s, 0) - quota[s])
    pool = F.when(F.col("shard") == n_shards, F.col("place"))
    for s in range(n_shards):
        pool = F.when((F.col("shard") == s) & (F.col("place") >= quota[s]), F.col("place") + surplus[s]).otherwise(pool)
    to, slot, begin = F.col("shard"), F.col("place"), 0
    for s in range(n_shards):
        kept = min(held.get(s, 0), quota[s])
        end = begin + quota[s] - kept
        here = (F.col("pool") >= begin) & (F.col("pool") < end)
        to, slot = F.when(here, s).otherwise(to), F.when(here, F.col("pool") - begin + kept).otherwise(slot)
        begin = end
    return numbered.withColumn("pool", pool).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), to.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

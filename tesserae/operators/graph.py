"""Graph operators as iterations of Spark joins; every round is a table in the shared folder."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tesserae.sources.stored import removed, stored

#: So many tables of single rounds are kept before they are merged.
MERGE = 8
#: So many names a list of names that share aliases with one.
LIST = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable by links, for each node that has a link.

    Each round takes the smallest label among a node and its neighbours, then replaces a label by the label of that
    label (pointer jumping), so that long chains close in about as many rounds as their length has bits. Labels are
    rows of a table in the shared folder; only a count of changes reaches the driver (no join is a broadcast: a small file may
    hold many labels, and each round would send them again). An empty table gives no rows.
    """
    both = stored(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v").distinct(),
        "links",
    )
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("component")), "labels")
    while True:
        around = both.join(labels.hint("merge"), both.v == labels.node).groupBy("u").agg(F.min("component").alias("near"))
        nearer = labels.join(around.hint("merge"), labels.node == around.u).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        of = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        changes = Observation()
        following = nearer.join(of.hint("merge"), "component", "left").select("node", "old", F.least("component", F.coalesce("jump", "component")).alias("component"))
        labels = stored(following.observe(changes, F.count_if(F.col("component") != F.col("old")).alias("n")).select("node", "component"), "labels", labels)
        if not changes.get["n"]:
            removed(both)
            return labels


def key_groups(rows: DataFrame, id_col: str, keys_col: str) -> DataFrame:
    """(node, component) of ids that share any of their keys, directly or over others; every id has a row."""
    keyed = rows.select(F.col(id_col).alias("node"), F.explode(keys_col).alias("key")).where("key is not null")
    anchor = keyed.groupBy("key").agg(F.min("node").alias("anchor"))
    linked = components(keyed.join(anchor.hint("merge"), "key").select("anchor", "node"), "anchor", "node")
    return rows.select(F.col(id_col).alias("node")).distinct().join(linked.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def closure(edges: DataFrame, source: str, target: str, rounds: int = 64) -> DataFrame:
    """(ancestor, node, depth): everything reachable along edges, with the fewest steps; paths double each round.

    Stops when a round adds nothing; ``rounds`` guards against a defect, not against depth (2**rounds steps).
    """
    reach = stored(edges.select(F.col(source).alias("ancestor"), F.col(target).alias("node"), F.lit(1).cast("long").alias("depth")).distinct(), "reach")
    count = reach.count()
    for _ in range(rounds):
        more = reach.alias("x").join(reach.alias("y"), F.col("x.node") == F.col("y.ancestor")).select(F.col("x.ancestor").alias("ancestor"), F.col("y.node").alias("node"), (F.col("x.depth") + F.col("y.depth")).alias("depth"))
        reach = stored(reach.unionByName(more).groupBy("ancestor", "node").agg(F.min("depth").alias("depth")), "reach", reach)
        if (now := reach.count()) == count:
            break
        count = now
    return reach


def reached(edges: DataFrame, starts: DataFrame, source: str, target: str) -> DataFrame:
    """(node, steps): the nodes of ``starts`` (node) and all that edges lead to from there, with the fewest steps.

    A round follows the edges of the nodes that the round before has found, and no others; rounds are as many as the longest
    of these ways has steps. Each round is one job; tables of earlier rounds are merged now and then, so that plans stay short.
    """
    links = stored(edges.select(F.col(source).alias("node"), F.col(target).alias("next")).where("node is not null and next is not null").distinct(), "links")
    front = stored(starts.select("node").where("node is not null").distinct().withColumn("steps", F.lit(0).cast("long")), "reached")
    parts, step = [front], 0
    while True:
        step += 1
        seen = functools.reduce(DataFrame.unionByName, parts)
        found = Observation()
        fresh = links.join(front.select("node"), "node", "left_semi").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("steps", F.lit(step).cast("long"))
        front = stored(fresh.observe(found, F.count("*").alias("n")), "reached")
        if not found.get["n"]:
            removed(links)
            return seen
        parts.append(front)
        if len(parts) > MERGE:
            # the last part is the front of the next round
            whole = stored(functools.reduce(DataFrame.unionByName, parts[:-1]), "reached")
            for part in parts[:-1]:
                removed(part)
            parts = [whole, front]


def waves(nodes: DataFrame, edges: DataFrame, node: str, needs: str, needed: str) -> DataFrame:
    """(node, wave): 0 for nodes that need nothing, else one more than the latest wave they need; nodes on or behind a cycle
    have a null wave, as have nodes that need one that is not listed.

    Each node carries the number of needs that are still open. A wave is one job: it closes needs of the nodes that the last wave
    has met and writes the nodes anew, replacing the table before.
    """
    listed = nodes.select(F.col(node).alias("node")).distinct()
    links = stored(edges.select(F.col(needs).alias("node"), F.col(needed).alias("needed")).where("node is not null").distinct(), "needs")
    open_ = links.groupBy("node").agg(F.count("*").alias("open"))
    wave, ready = 0, Observation()
    first = listed.join(open_, "node", "left").select("node", F.coalesce("open", F.lit(0).cast("long")).alias("open"))
    first = first.withColumn("wave", F.when(F.col("open") == 0, F.lit(0).cast("long"))).observe(ready, F.count_if(F.col("wave") == 0).alias("n"))
    state = stored(first, "waves")
    while ready.get["n"]:
        wave, before = wave + 1, wave
        met = state.where(F.col("wave") == before).select(F.col("node").alias("needed"))
        closed = links.join(met, "needed", "left_semi").groupBy("node").agg(F.count("*").alias("closed"))
        ready = Observation()
        left = F.col("open") - F.coalesce("closed", F.lit(0))
        now = F.when(F.col("wave").isNull() & (left == 0), F.lit(wave).cast("long")).otherwise(F.col("wave"))
        state = stored(state.join(closed, "node", "left").select("node", left.alias("open"), now.alias("wave")).observe(ready, F.count_if(F.col("wave") == wave).alias("n")), "waves", state)
    removed(links)
    return state.select("node", "wave")


def leaks(rows: DataFrame, key: str, split: str) -> DataFrame:
    """(key, splits, rows) of grouping keys that stand in more than one split."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("rows")).where("splits > 1")


def bridged(aliases: DataFrame, name: str, alias: str) -> DataFrame:
    """(left, right): names that share an alias (two hops), each unordered pair once.

    The names of an alias are lists, so that a pair is one number in the list of its left name and no row before the result. Lists are parted by
    the hash of the right name, so that none has many more than ``LIST`` names, whatever an alias or a name holds.
    """
    links = stored(aliases.select(F.col(name).alias("left"), F.col(alias).alias("via")).where("left is not null and via is not null").distinct(), "aliases")
    sizes = links.groupBy("via").agg(F.count("*").alias("n"))
    most = links.join(sizes, "via").groupBy("left").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    part = F.pmod(F.xxhash64("left"), F.lit(1 + most // LIST)).alias("part")
    lists = links.groupBy("via", part).agg(F.collect_list("left").alias("names"))
    ahead = links.join(lists, "via").select("left", "part", F.filter("names", lambda n: n > F.col("left")).alias("names")).where(F.size("names") > 0)
    return ahead.groupBy("left", "part").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names")).select("left", F.explode("names").alias("right"))

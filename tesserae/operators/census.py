"""Census work: versions of positions, canonical rows, ladders, plans of selections, accounting and audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.ordering import beside, numbered


def reusable(acquisitions: DataFrame, key: str, mime: str, least_bytes: int) -> DataFrame:
    """The newest verified acquisition of each key with the wanted type and size."""
    fine = acquisitions.where("verified").where((F.col("mime") == mime) & (F.col("bytes") >= least_bytes))
    rest = [c for c in acquisitions.columns if c != key]
    return fine.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("retrieved_at", "id")).alias("x")).select(key, "x.*")


def position_versions(rows: DataFrame, position: str, ref: str, parsed: str) -> DataFrame:
    """(position, refs, versions, conflict): sorted references of each position; conflict where they parse differently."""
    out = rows.groupBy(position).agg(F.array_join(F.array_sort(F.collect_set(F.col(ref).cast("string"))), ",").alias("refs"), F.count("*").alias("versions"), F.count_distinct(parsed).alias("n"))
    return out.select(position, "refs", "versions", (F.col("n") > 1).alias("conflict"))


def canonical_rows(rows: DataFrame, keys: list[str], citation: str, row: Column) -> DataFrame:
    """(keys, citation, copies, conflict): one row of each key under its smallest citation."""
    marked = rows.withColumn("__row", F.xxhash64(row))
    return marked.groupBy(*keys).agg(F.min(citation).alias("citation"), F.count("*").alias("copies"), (F.min("__row") != F.max("__row")).alias("conflict"))


def legacy_fields(rows: DataFrame, mapping: dict[str, list[str]], fields: str) -> DataFrame:
    """Columns named by ``mapping`` from a string map, first filled key wins; ``import_status`` complete, partial or empty."""
    named = rows.select(*[c for c in rows.columns if c != fields], *(F.coalesce(*(F.nullif(F.col(fields)[k], F.lit("")) for k in keys)).alias(name) for name, keys in mapping.items()))
    filled = sum((F.col(n).isNotNull().cast("int") for n in mapping), F.lit(0))
    return named.withColumn("import_status", F.when(filled == len(mapping), "complete").when(filled > 0, "partial").otherwise("empty"))


def classified(left: DataFrame, right: DataFrame, keys: list[str], ladder: list[tuple[str, Column]], left_id: str) -> DataFrame:
    """(left_id, class): the best rung of a ladder of predicates over the pairs of a key; ``absent`` without a partner."""
    rung = F.lit(len(ladder))
    for place, (_, predicate) in reversed(list(enumerate(ladder))):
        rung = F.when(predicate, place).otherwise(rung)
    pairs = left.join(right, keys).select(left_id, rung.alias("rung"))
    best = pairs.groupBy(left_id).agg(F.min("rung").alias("rung"))
    names = F.array(*(F.lit(n) for n, _ in ladder), F.lit("different"))
    return left.select(left_id).join(best, left_id, "left").select(left_id, F.when(F.col("rung").isNull(), "absent").otherwise(names[F.col("rung")]).alias("class"))


def edge_problems(edges: DataFrame, nodes: DataFrame, id_col: str, scope: str) -> DataFrame:
    """(left, right, problem): a missing end, a loop, or ends of different scopes."""
    a = nodes.select(F.col(id_col).alias("left"), F.col(scope).alias("a"), F.lit(True).alias("has_left"))
    b = nodes.select(F.col(id_col).alias("right"), F.col(scope).alias("b"), F.lit(True).alias("has_right"))
    both = edges.join(a, "left", "left").join(b, "right", "left")
    problem = F.when(F.col("has_left").isNull() | F.col("has_right").isNull(), "missing-end").when(F.col("left") == F.col("right"), "loop").when(~F.col("a").eqNullSafe(F.col("b")), "scope")
    return both.select("left", "right", problem.alias("problem")).where("problem is not null")


def selection(existing: DataFrame, chosen: DataFrame, event: str, member: str, revision: str) -> DataFrame:
    """(event, retained, added, dropped): how the newest selection of each event differs from the one before it."""
    both = existing.unionByName(chosen)
    last = both.groupBy(event).agg(F.max(revision).alias("last"))
    marked = both.join(last, event)
    now = marked.where(F.col(revision) == F.col("last")).select(event, member, F.lit(1).alias("now"))
    before = marked.where(F.col(revision) == F.col("last") - 1).select(event, member, F.lit(1).alias("before"))
    each = now.join(before, [event, member], "full_outer")
    return each.groupBy(event).agg(F.count_if(F.col("now").isNotNull() & F.col("before").isNotNull()).alias("retained"), F.count_if(F.col("before").isNull()).alias("added"), F.count_if(F.col("now").isNull()).alias("dropped"))


def spanning_edges(people: DataFrame, group: str, id_col: str, blocked: DataFrame, active: DataFrame) -> DataFrame:
    """(left, right): star edges of each group that are not active yet; groups with a blocked pair are frozen."""
    keyed = people.select(F.col(group).alias("g"), F.col(id_col).alias("right"))
    anchor = keyed.groupBy("g").agg(F.min("right").alias("left"))
    frozen = blocked.select("left").unionByName(blocked.select(F.col("right").alias("left"))).join(keyed.select("g", F.col("right").alias("left")), "left").select("g").distinct()
    edges = keyed.join(anchor, "g").where("left <> right").join(frozen, "g", "left_anti").select("left", "right")
    return edges.join(active.select("left", "right"), ["left", "right"], "left_anti")


def accounting(df: DataFrame, *checks: tuple[str, int, Column]) -> DataFrame:
    """(rule, expected, actual, holds) of aggregates that must come to fixed numbers, in one pass."""
    one = df.agg(*(actual.cast("long").alias(f"c{i}") for i, (_, _, actual) in enumerate(checks)))
    rows = F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(expected).cast("long").alias("expected"), F.col(f"c{i}").alias("actual")) for i, (rule, expected, _) in enumerate(checks)))).alias("x")
    return one.select(rows).select("x.*", (F.col("x.expected") == F.col("x.actual")).alias("holds"))


def agreement_sample(agreed: DataFrame, id_col: str, group: str, seed: str) -> DataFrame:
    """A tenth (rounded up) of each group, those of least sha256(seed:id)."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    sizes = agreed.groupBy(group).agg(F.count("*").alias("__n"))
    placed = beside(numbered(agreed.withColumn("__order", order), [group], ["__order", id_col], "__r"), sizes, [group])
    return placed.where(F.col("__r") <= F.ceil(F.col("__n") / 10)).drop("__r", "__n", "__order")


def disagreements(rows: DataFrame, before: list[str], after: list[str], *keys: str) -> DataFrame:
    """(keys, rows, one counter a field): rows and how many of them differ in each field (null and '' are equal)."""
    differs = lambda a, b: ~F.nullif(F.col(a).cast("string"), F.lit("")).eqNullSafe(F.nullif(F.col(b).cast("string"), F.lit("")))
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), *(F.count_if(differs(a, b)).alias(f"{a}_differs") for a, b in zip(before, after, strict=True)))


class Registry:
    """Parsers by name: each with a recogniser (a predicate on documents) and a function from documents to rows.

    ``claims`` says which parsers recognise which document; ``parsed`` runs the first that does, so every document is
    parsed once, and lists nothing for those that none recognises.
    """

    def __init__(self):
        self.parsers: list[tuple[str, Column, Callable[[DataFrame], DataFrame]]] = []

    def add(self, name: str, recognises: Column, parse: Callable[[DataFrame], DataFrame]) -> None:
        self.parsers.append((name, recognises, parse))

    def claims(self, docs: DataFrame, id_col: str) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(n).alias("parser"), F.coalesce(p, F.lit(False)).alias("claimed")) for n, p, _ in self.parsers))).alias("x")
        return docs.select(id_col, each).select(id_col, "x.*")

    def parsed(self, docs: DataFrame) -> DataFrame:
        out, taken = None, F.lit(False)
        for name, recognises, parse in self.parsers:
            mine = F.coalesce(recognises, F.lit(False))
            rows = parse(docs.where(mine & ~taken)).withColumn("parser", F.lit(name))
            out = rows if out is None else out.unionByName(rows)
            taken = taken | mine
        return out

"""Public results and sporting comparisons, projected from several append-only ledgers and kept up to date by key.

A projection is a function of ledgers. It is stored as one table in buckets of its key, in a versioned store, together with a
freshness token: the number of rows and greatest revision of every ledger that it has seen. A refresh looks for keys with rows beyond the
token, computes these keys only, and replaces the buckets that hold one; everything else keeps its files.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators.ranking import scope_match
from tesserae.sources.stored import stored
from tesserae.sources.versions import BUCKET, Pinned, Store

#: Publication policies under which a result may be shown.
POLICIES = ("extraction-publication/1", "extraction-publication/2")
SCOPES = ("national", "continental", "international")


def _newest(rows: DataFrame, keys: list[str], by: str = "revision") -> DataFrame:
    """The row of greatest revision for each key, without a window over a hot key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(by, *(c for c in rest if c != by))).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest))


def freshness(ledgers: dict[str, DataFrame], revision: str = "revision") -> DataFrame:
    """One row: the token, a digest of each ledger's name, number of rows and greatest revision in order of names."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.coalesce(F.max(revision), F.lit(0)).cast("long").alias("last")) for name, df in ledgers.items()]
    whole = functools.reduce(DataFrame.unionByName, parts)
    line = F.concat_ws(":", "name", F.col("n").cast("string"), F.col("last").cast("string"))
    return whole.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("token"))  # a row a ledger


def public_results(cache: DataFrame, decisions: DataFrame, reviews: DataFrame, policies: DataFrame, token: DataFrame) -> DataFrame:
    """(result_id, source_name, identity_id, body, correction_version) that may be shown now.

    A cached result is shown while the decision it was validated by is the newest of its (job_id, ordinal), validates, stands
    under the active policy, which is a supported one, and saw the newest review of it, and while the cache
    was made under the present ``token``. ``cache`` has (result_id, source_name, identity_id, body, validation_id,
    policy_version, token), ``decisions`` (id, job_id, ordinal, revision, action, policy_version, review_revision),
    ``reviews`` (job_id, ordinal, revision), ``policies`` (revision, policy_version).
    """
    place = ["job_id", "ordinal"]
    newest = _newest(decisions, place)
    reviewed = reviews.groupBy(*place).agg(F.max("revision").alias("reviewed"))
    active = policies.agg(F.max_by("policy_version", "revision").alias("active"))
    valid = (
        newest.join(reviewed, place, "left").join(F.broadcast(active))
        .where((F.col("action") == "validate") & (F.col("policy_version") == F.col("active")) & F.col("policy_version").isin(*POLICIES) & (F.col("review_revision") == F.coalesce("reviewed", F.lit(0))))
        .select(F.col("id").alias("validation_id"), "policy_version", *place)
    )
    now = cache.join(F.broadcast(token.withColumnRenamed("token", "__now"))).where(F.col("token") == F.col("__now"))
    shown = now.join(valid, ["validation_id", "policy_version"])
    return shown.select("result_id", "source_name", "identity_id", "body", F.sha2("validation_id", 256).alias("correction_version"), *place)


def sporting_view(events: DataFrame, members: DataFrame, results: DataFrame, sporting_policies: DataFrame, policies: DataFrame, token: DataFrame, policy: str) -> DataFrame:
    """(cohort_id, revision, result_id, body) of the cohorts that may be compared now.

    The newest event of a cohort must publish, under ``policy``, the present revisions of both policy ledgers and the present
    ``token``, and each of its expected members must be a public result whose body is the one that was published.
    ``events`` has (cohort_id, revision, action, policy_version, policy_revision, publication_revision, token,
    expected_members), ``members`` (revision, result_id, source_body).
    """
    last = lambda df, name: F.broadcast(df.agg(F.max("revision").alias(name)))
    current = (
        _newest(events, ["cohort_id"]).join(last(sporting_policies, "__sporting")).join(last(policies, "__publication")).join(F.broadcast(token.withColumnRenamed("token", "__now")))
        .where((F.col("action") == "publish") & (F.col("policy_version") == policy) & (F.col("policy_revision") == F.col("__sporting")) & (F.col("publication_revision") == F.col("__publication")) & (F.col("token") == F.col("__now")))
        .select("cohort_id", "revision", "expected_members")
    )
    bound = current.join(members, "revision").join(results.select("result_id", "body"), "result_id").where(F.col("source_body") == F.col("body"))
    whole = bound.groupBy("cohort_id").agg(F.count("*").alias("__n"))
    complete = current.join(whole, "cohort_id", "left").where(F.coalesce("__n", F.lit(0)) == F.col("expected_members")).select("cohort_id")
    return bound.join(complete, "cohort_id", "left_semi").select("cohort_id", "revision", "result_id", "body")


def sporting_ranks(rows: DataFrame) -> DataFrame:
    """``rows`` (cohort_id, result_id, score, country, continent) with a rank and a denominator in each of the three scopes.

    Ranks are made from counts: distinct scores of a cohort's place are counted, and a score's rank is one more than the number
    of greater ones. Rows without a score have no rank and count nowhere; a row whose place is unknown has neither rank nor
    denominator in that scope. The status is ranked where the international rank is known, else withheld.
    """
    place = {"national": F.col("country"), "continental": F.col("continent"), "international": F.lit("*")}
    known = {s: F.when(scope_match(F.lit(s), F.col("country"), F.col("country"), F.col("continent"), F.col("continent")), p) for s, p in place.items()}
    spread = rows.select("cohort_id", "score", F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), p.alias("place")) for s, p in known.items()))).alias("at")).select("cohort_id", "score", "at.*")
    counts = spread.where("place is not null and score is not null").groupBy("cohort_id", "scope", "place", "score").agg(F.count("*").alias("n"))
    over = W.partitionBy("cohort_id", "scope", "place")
    # distinct scores of each place, read twice for each scope
    steps = stored(counts.withColumns({"rank": F.sum("n").over(over.orderBy(F.desc("score"))) - F.col("n") + 1, "peers": F.sum("n").over(over)}).drop("n"), "steps")
    out = rows
    for s in SCOPES:
        mine = steps.where(F.col("scope") == s).select("cohort_id", F.col("place").alias("__place"), "score", F.col("rank").alias(f"{s}_rank"))
        size = steps.where(F.col("scope") == s).groupBy("cohort_id", F.col("place").alias("__place")).agg(F.max("peers").alias(f"{s}_peers"))
        out = out.withColumn("__place", known[s]).join(mine, ["cohort_id", "__place", "score"], "left").join(size, ["cohort_id", "__place"], "left")
        out = out.withColumn(f"{s}_peers", F.when(F.col("__place").isNotNull(), F.coalesce(f"{s}_peers", F.lit(0).cast("long")))).drop("__place")
    return out.withColumn("status", F.when(F.col("international_rank").isNotNull(), "ranked").otherwise("withheld"))


def authority_token(cohort: Column, revision: Column, filters: dict[str, str]) -> Column:
    """What a link must carry to be answered: a digest of cohort, revision and filters."""
    return F.sha2(F.concat_ws("\x1f", cohort, revision.cast("string"), *(F.lit(f"{k}={v}") for k, v in sorted(filters.items()))), 256)


@dataclass
class Projection:
    """One stored view of ledgers: ``compute(ledgers) -> rows`` must work key by key.

    ``keyed`` ledgers have the key as a column; a new row in another ledger (a policy) may change every key.
    """

    store: Store
    name: str
    key: str
    keyed: tuple[str, ...]
    compute: Callable[[dict[str, DataFrame]], DataFrame]
    buckets: int = 64
    revision: str = "revision"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def changed(self, ledgers: dict[str, DataFrame], marks: dict[str, int]) -> DataFrame | None:
        """Keys of rows beyond the marks; None where all keys may have changed."""
        for name, df in ledgers.items():
            if name not in self.keyed and (name not in marks or not df.where(F.col(self.revision) > marks[name]).isEmpty()):
                return None
        parts = [ledgers[n].where(F.col(self.revision) > marks.get(n, -1)).select(self.key) for n in self.keyed]
        return functools.reduce(DataFrame.union, parts).where(F.col(self.key).isNotNull()).distinct()

    def refresh(self, ledgers: dict[str, DataFrame]) -> Pinned:
        """Bring the view up to the ledgers as they are now, in one commit; its properties say how many buckets were written."""
        here = self.store.pin()
        marks = here.properties.get(f"{self.name}.marks", {}) if self.name in here.tables else {}
        ends = [df.agg(F.lit(n).alias("name"), F.coalesce(F.max(self.revision), F.lit(-1)).cast("long").alias("last")) for n, df in ledgers.items()]
        now = {r["name"]: r["last"] for r in functools.reduce(DataFrame.unionByName, ends).collect()}  # a row a ledger
        # rows that arrive while this runs are beyond the marks, and left to the next refresh
        ledgers = {n: df.where(F.col(self.revision) <= now[n]) for n, df in ledgers.items()}
        keys = self.changed(ledgers, marks)
        if keys is None:
            touched, some = set(range(self.buckets)), ledgers
        else:
            touched = {r[0] for r in keys.select(self._bucket()).distinct().collect()}  # at most ``buckets`` rows
            some = {n: df.join(keys, self.key, "left_semi") if n in self.keyed else df for n, df in ledgers.items()}
        parts = None
        if touched:
            fresh = self.compute(some).withColumn(BUCKET, self._bucket())
            if keys is not None and self.name in here.tables:
                kept = here.table(self.name, touched).join(keys, self.key, "left_anti")
                fresh = kept.withColumn(BUCKET, self._bucket()).unionByName(fresh)
            parts = {self.name: (fresh, touched)}
        return self.store.commit(here, buckets=parts, properties={f"{self.name}.marks": now, f"{self.name}.written": len(touched)})

    def rows(self) -> DataFrame:
        return self.store.pin().table(self.name)

    def fresh(self, ledgers: dict[str, DataFrame]) -> bool:
        """Whether the stored view has seen all of the ledgers."""
        marks = self.store.pin().properties.get(f"{self.name}.marks")
        return marks is not None and all(df.where(F.col(self.revision) > marks.get(n, -1)).isEmpty() for n, df in ledgers.items())

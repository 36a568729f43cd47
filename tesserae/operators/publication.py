"""What keeps an observation from publication, and what is wrong with a provider's answer: all reasons, or the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.reasons import first_reason
from tesserae.operators.sporting import POLICIES

#: Under the second policy only, sources in HTML may be published.
PLAIN_POLICY, HTML_POLICY = POLICIES
#: Uncertainties that do not keep an observation from publication, and those that the HTML policy allows besides.
ALLOWED = (
    "owner-review-required", "reconciliation-unreviewed", "event-date-not-evidenced", "card-not-evidenced", "penalty-unit-not-evidenced", "category-not-evidenced",
    "status-not-evidenced", "source-status-not-explicit", "time-unit-not-explicit", "units-not-explicit",
)
ALLOWED_HTML = ("html-review-not-supported", "coverage-not-established")
#: Statuses that stand for a performance, and the fields that may hold one as a number or as a time.
STATUSES = ("DNS", "DQ", "DSQ", "DNF")
NUMBERS = ("performance", "final_depth", "final_distance", "realized_distance")
TIMES = ("final_time", "realized_time")


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def time_notation(t: Column) -> Column:
    """Whether ``t`` (components array<int>, fraction, fraction_digits, notation) writes a time: minutes and seconds parted by a
    colon or one decimal number, a fraction of digits only, as many as it says."""
    parts = F.size(t["components"])
    form = ((t["notation"] == "colon-separated") & (parts == 2)) | ((t["notation"] == "decimal") & (parts == 1))
    whole = F.forall(t["components"], lambda c: F.coalesce(c >= 0, F.lit(False)))
    fraction = (t["fraction"].isNull() & (t["fraction_digits"] == 0)) | (t["fraction"].rlike("^[0-9]+$") & (F.char_length(t["fraction"]) == t["fraction_digits"]))
    return F.coalesce(form & whole & fraction, F.lit(False))


def http_url(u: Column) -> Column:
    return F.coalesce(u.rlike(r"^https?://[^/?#\s:@]+(:\d*)?([/?#]\S*)?$"), F.lit(False))


def blockers(rows: DataFrame, policy: Column | None = None) -> DataFrame:
    """``rows`` with ``blockers``: every reason that keeps an observation from publication, in a fixed order, each once.

    Columns read: kind, parse_status, discipline, source_name, the NUMBERS (double), the TIMES (see ``time_notation``), status,
    coordinate and known_coordinates (an array), acquisitions (final_url, publisher, sha256), source_sha256, html (boolean),
    context (event_name, event_date, errors) of HTML sources, null where it does not bind, unsupported_tables, flags, uncertainties, and
    fields (name, status, reason). ``policy`` is the active one. Null arrays are empty; what is not known blocks.
    """
    policy = F.lit(None).cast("string") if policy is None else policy
    html = F.coalesce(F.col("html"), F.lit(False))
    texts = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    number = F.lit(False)
    for c in NUMBERS:
        number = number | (F.col(c).isNotNull() & ~F.isnan(c) & ~F.col(c).isin(float("inf"), float("-inf")))
    timed = F.lit(False)
    for c in TIMES:
        timed = timed | time_notation(F.col(c))
    # an HTML observation is in its context if that binds, another one if its line is on the page
    placed = F.when(html, F.col("context").isNotNull()).otherwise(F.coalesce(F.array_contains("known_coordinates", F.col("coordinate")), F.lit(False)))
    cited = F.exists("acquisitions", lambda a: http_url(a["final_url"]) & ~_blank(a["publisher"]) & (a["sha256"] == F.col("source_sha256")))
    under = F.coalesce(policy == HTML_POLICY, F.lit(False))
    allowed = F.when(html & under, F.array(*map(F.lit, ALLOWED + ALLOWED_HTML))).otherwise(F.array(*map(F.lit, ALLOWED)))
    fixed = [
        ("not-result-row", ~F.coalesce(F.col("kind") == "result-row", F.lit(False))),
        ("unparsed", ~F.coalesce(F.col("parse_status") == "parsed", F.lit(False))),
        ("missing-discipline-context", _blank(F.col("discipline"))),
        ("missing-source-name", _blank(F.col("source_name"))),
        ("missing-performance-or-status", ~(F.coalesce(number, F.lit(False)) | timed | F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))),
        ("missing-source-context", ~placed),
        ("missing-source-citation", ~F.coalesce(cited, F.lit(False))),
        ("html-policy-required", html & ~under),
        ("missing-event-heading", html & _blank(F.col("context.event_name"))),
        ("missing-event-date", html & _blank(F.col("context.event_date"))),
        ("unsupported-html-layout", html & (F.coalesce(F.col("unsupported_tables"), F.lit(0)) > 0)),
    ]
    said = lambda array, kind: F.transform(array, lambda x: F.concat(F.lit(f"{kind}: "), x))
    none = F.array().cast("array<string>")
    invalid = F.filter(
        F.coalesce("fields", F.array().cast(rows.schema["fields"].dataType)),
        lambda f: f["status"].isin("invalid", "ambiguous") & ~((f["name"] == "unit") & F.coalesce(f["reason"] == "time-unit-not-explicit", F.lit(False))),
    )
    found = F.concat(
        F.array_compact(F.array(*(F.when(rule, name) for name, rule in fixed))),
        F.when(html, F.coalesce("context.errors", none)).otherwise(none),
        F.when(html, said(texts("flags"), "substantive-source-flag")).otherwise(none),
        said(F.array_except(texts("uncertainties"), allowed), "unresolved-extraction-error"),
        said(F.transform(invalid, lambda f: f["name"]), "invalid-field"),
    )
    return rows.withColumn("blockers", F.array_distinct(found))


def diagnosis(rows: DataFrame, decisions: DataFrame, reviews: DataFrame, policies: DataFrame) -> DataFrame:
    """(job_id, ordinal, ready, eligible, reasons) of observations (job_id, ordinal and the columns of ``blockers``).

    Ready: nothing blocks and the active policy (the newest of ``policies``: revision, policy_version) is a supported one. Eligible: ready,
    and the newest decision (job_id, ordinal, revision, action, policy_version, review_revision) validates under that policy
    and has seen the newest review (job_id, ordinal, revision). Else the reasons say what is missing.
    """
    place = ["job_id", "ordinal"]
    active = policies.agg(F.max_by("policy_version", "revision").alias("__active"))
    last = decisions.groupBy(*place).agg(F.max(F.struct("revision", "action", "policy_version", "review_revision")).alias("__last"))
    seen = reviews.groupBy(*place).agg(F.max("revision").alias("__seen"))
    joined = rows.join(F.broadcast(active)).join(last, place, "left").join(seen, place, "left")  # active is one row
    judged = blockers(joined, F.col("__active"))
    supported = F.coalesce(F.col("__active").isin(*POLICIES), F.lit(False))
    policy = F.when(supported, F.col("__active")).otherwise(PLAIN_POLICY)
    reviewed = F.coalesce("__seen", F.lit(0))
    missing = first_reason(
        ("validation-required", F.col("__last").isNull()),
        ("validation-revoked", F.col("__last.action") == "revoke"),
        ("policy-version-changed", ~F.col("__last.policy_version").eqNullSafe(policy)),
        ("review-revision-changed", ~F.col("__last.review_revision").eqNullSafe(reviewed.cast("long"))),
    )
    ready = supported & (F.size("blockers") == 0)
    reasons = F.concat("blockers", F.array_compact(F.array(F.when(~supported, "policy-inactive"), missing)))
    return judged.select(*place, ready.alias("ready"), (ready & missing.isNull() & F.coalesce(F.col("__last.action") == "validate", F.lit(False))).alias("eligible"), reasons.alias("reasons"))


def choice_reason(answers: Column, question: str, allowed: tuple[str, ...], rounded: bool = False) -> Column:
    """The first of 13 checks that the answer to ``question`` fails in a variant of answers by question; null if it is sound.

    An answer is an object with type ``choice``, a choice among ``allowed``, a confidence and a probability for each allowed choice;
    these are numbers from 0 to 1 that sum to 1 (to a hundred-thousandth; with ``rounded`` to 0.02, in decimals), and none is
    greater than that of the choice.
    """
    no = F.lit(False)
    mapped = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    is_object = lambda v: kind(v).startswith("OBJECT")
    is_number = lambda v: kind(v).rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL.*)$")
    real = lambda v: F.try_variant_get(v, "$", "double")
    is_share = lambda v: is_number(v) & F.coalesce(real(v).between(0, 1), no)
    has = lambda v, key: F.coalesce(F.map_contains_key(mapped(v), key), no)
    at = lambda v, key: F.try_element_at(mapped(v), F.lit(key))

    answer = at(answers, question)
    choice = F.try_variant_get(answer, "$.choice", "string")
    shares = at(answer, "probabilities")
    values = F.map_values(mapped(shares))
    if rounded:
        exact = F.aggregate(F.transform(values, lambda v: F.try_variant_get(v, "$", "decimal(28,18)")), F.lit(0).cast("decimal(38,18)"), lambda a, x: (a + x).cast("decimal(38,18)"))
        sums = exact.between(F.lit("0.98").cast("decimal(38,18)"), F.lit("1.02").cast("decimal(38,18)"))
    else:
        sums = F.abs(1 - F.aggregate(F.transform(values, real), F.lit(0.0), lambda a, x: a + x)) < 0.00001
    return first_reason(
        ("missing-answer", ~(is_object(answers) & has(answers, question))),
        ("invalid-answer-type", ~is_object(answer)),
        ("invalid-choice-type", ~F.coalesce((kind(at(answer, "type")) == "STRING") & (F.try_variant_get(answer, "$.type", "string") == "choice"), no)),
        ("unsupported-choice", ~F.coalesce((kind(at(answer, "choice")) == "STRING") & choice.isin(*allowed), no)),
        ("missing-confidence", ~has(answer, "confidence")),
        ("invalid-confidence", ~is_share(at(answer, "confidence"))),
        ("missing-probabilities", ~has(answer, "probabilities")),
        ("invalid-probabilities-type", ~is_object(shares)),
        ("invalid-probability-keys", ~F.array_sort(F.map_keys(mapped(shares))).eqNullSafe(F.array(*map(F.lit, sorted(allowed))))),
        ("invalid-probability-type", F.exists(values, lambda v: ~is_number(v))),
        ("invalid-probability-range", F.exists(values, lambda v: ~is_share(v))),
        ("invalid-probability-sum", ~F.coalesce(sums, no)),
        ("choice-probability-inconsistency", F.exists(values, lambda v: real(v) > real(F.try_element_at(mapped(shares), choice)))),
    )

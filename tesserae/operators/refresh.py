"""When a publisher is asked again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.reasons import first_reason


@dataclass(frozen=True)
class Policy:
    """Days between checks of provisional, recent (or undated) and stable results, and for how many days a result is recent."""

    provisional: int = 1
    recent: int = 7
    stable: int = 90
    window: int = 30

    def __post_init__(self):
        if min(self.provisional, self.recent, self.stable) < 1 or self.window < 0 or not self.provisional <= self.recent <= self.stable:
            raise ValueError("intervals are positive and ordered: provisional, recent, stable")


def _day(text: Column) -> Column:
    """The date of an ISO date, or of an instant with its time zone, as it is written; null for anything else."""
    date = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"), F.substring(text, 1, 10))
    return F.try_to_date(date)


def planned(rows: DataFrame, as_of: str, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """``rows`` (kind, publication_date, provisional, last_check: texts, but for the flag) with due, reason and interval_days.

    An index is due in every run. A result that was never checked is due, another one once its interval has passed since the last check; the
    publication date must be a cited one, undated results count as recent. Where a date cannot be read or lies in the future, due is null
    and the reason says which.
    """
    today = F.to_date(F.lit(as_of))
    published, checked = _day(F.col("publication_date")), _day(F.col("last_check"))
    provisional = F.coalesce("provisional", F.lit(False))
    fresh = published.isNull() | (F.datediff(today, published) <= policy.window)
    category = F.when(provisional, "provisional").when(fresh, "recent_or_undated").otherwise("stable")
    interval = F.when(provisional, policy.provisional).when(fresh, policy.recent).otherwise(policy.stable)
    passed = F.datediff(today, checked) >= interval
    wrong = first_reason(
        ("unknown-kind", ~F.coalesce(F.col("kind").isin("index", "result"), F.lit(False))),
        ("invalid-publication-date", (F.col("kind") == "result") & F.col("publication_date").isNotNull() & published.isNull()),
        ("publication-in-the-future", (F.col("kind") == "result") & (published > today)),
        ("invalid-check", (F.col("kind") == "result") & F.col("last_check").isNotNull() & checked.isNull()),
        ("check-in-the-future", (F.col("kind") == "result") & (checked > today)),
    )
    index, never = F.col("kind") == "index", F.col("last_check").isNull()
    due = F.when(wrong.isNull(), F.when(index | never, True).otherwise(passed))
    reason = F.coalesce(wrong, F.when(index, "index_each_run").when(never, "never_checked").otherwise(F.concat(category, F.when(passed, "_due").otherwise("_not_due"))))
    return rows.withColumns({"due": due, "reason": reason, "interval_days": F.when(wrong.isNull(), F.when(index, 0).otherwise(interval))})

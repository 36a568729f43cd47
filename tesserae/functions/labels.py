"""Labels to values by dictionaries that a reviewer has given, and codes that are compared across sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How sources name disciplines and genders, lower case.
DISCIPLINES = {c: c for c in ("all", "sta", "dyn", "dynb", "dnf", "cwt", "cwtb", "cnf", "fim")}
GENDERS = {"all": "all", "male": "men", "men": "men", "female": "women", "women": "women"}
KINDS = ("country", "federation", "neutral", "organization")


def coded(label: Column, codes: dict[str, str]) -> Column:
    """The code of a label, whatever its case and the blanks around it; null if there is none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in codes.items() for x in pair)), F.lower(F.trim(label)))


def context_errors(selected: dict[str, Column], acquired: Column) -> Column:
    """What acquisitions (selected_date, discipline, gender) contradict in the selected context (event_date, discipline, gender): each
    conflict once; what either side does not say contradicts nothing."""
    discipline, gender = coded(selected["discipline"], DISCIPLINES), coded(selected["gender"], GENDERS)
    checks = (("acquisition-date-conflict", "selected_date", selected["event_date"]), ("acquisition-discipline-conflict", "discipline", discipline), ("acquisition-gender-conflict", "gender", gender))
    clash = lambda field, own: F.exists(acquired, lambda a: F.coalesce(a[field] != own, F.lit(False)))
    return F.array_compact(F.array(*(F.when(F.coalesce(clash(field, own), F.lit(False)), name) for name, field, own in checks)))


def mapped_label(row_label: Column, heading_label: Column, dictionary: Column, sound: Column | None = None, semantic: Column | None = None) -> Column:
    """(status, value, rule) of a field whose label stands in a row or its heading.

    ``dictionary`` maps labels to values. The row's label counts before the heading's; two different ones are a conflict. ``sound``
    says whether a value may be used, ``semantic`` whether the column means what the field means. The rule names the first of row-heading-conflict,
    unsupported-column-semantics, missing-label, unmapped-label that holds, else explicit-dictionary-map.
    """
    conflict = F.coalesce(row_label != heading_label, F.lit(False))
    label = F.coalesce(row_label, heading_label)
    value = F.try_element_at(dictionary, label)
    valid = value.isNotNull() if sound is None else F.coalesce(sound, F.lit(False)) & value.isNotNull()
    bound = F.lit(True) if semantic is None else F.coalesce(semantic, F.lit(False))
    rule = F.when(conflict, "row-heading-conflict").when(~bound, "unsupported-column-semantics").when(label.isNull(), "missing-label").when(~valid, "unmapped-label").otherwise("explicit-dictionary-map")
    accepted = ~conflict & valid & bound
    return F.struct(F.when(accepted, "accepted").otherwise("unresolved").alias("status"), F.when(accepted, value).alias("value"), rule.alias("rule"))

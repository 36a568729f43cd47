"""Order, pages, samples and bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.ordering import numbered

MOST_ROWS, MOST_OFFSET = 100, 100_000


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows from ``offset`` in a total order; the bounds are part of the contract."""
    if not 1 <= limit <= MOST_ROWS or not 0 <= offset <= MOST_OFFSET:
        raise ValueError(f"limit is 1 to {MOST_ROWS}, offset 0 to {MOST_OFFSET}")
    return df.orderBy(*order).offset(offset).limit(limit)


def numbered_page(df: DataFrame, order: list, number: int, size: int) -> tuple[DataFrame, int, int]:
    """(rows, total, pages) of page ``number`` (from 1)."""
    total = df.count()
    return page(df, order, size, (number - 1) * size), total, -(-total // size)


def page_of_groups(df: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """All rows of ``limit`` keys from ``offset``: a page never ends inside a group."""
    return df.join(df.select(key).distinct().orderBy(key).offset(offset).limit(limit), key, "left_semi")


def hash_sample(df: DataFrame, id_col: str, seed: str, n: int) -> DataFrame:
    """The ``n`` rows of least sha256(seed:id), ties by id."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), id_col).limit(n)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df``, or an error if it has more than ``most`` rows; reads most + 1 rows at most."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def queue(df: DataFrame, score: str, *order: str) -> DataFrame:
    """queue_position within ``order[0]``: scored rows ascending, then scoreless ones, ties by the other columns."""
    return numbered(df, [order[0]], [F.asc_nulls_last(score), *order[1:]], "queue_position")


def newest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is last by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x")).select(*keys, "__x.*")

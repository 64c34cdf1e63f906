"""Normal forms under which ids, relations, hashes, types, states and sources are compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAD = " \t\r\n"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_id(c: Column | str) -> Column:
    """Trimmed and in lower case; null stays null."""
    return F.lower(F.btrim(_col(c), F.lit(_PAD)))


def norm_upper(c: Column | str) -> Column:
    """Trimmed and in upper case, for relations."""
    return F.upper(F.btrim(_col(c), F.lit(_PAD)))


def filled(c: Column | str) -> Column:
    """Neither null nor blank."""
    return F.length(F.btrim(_col(c), F.lit(_PAD))) > 0


def latest(df: DataFrame, key: Column, order: Sequence[Column], payload: Sequence[Column], name: str = "key") -> DataFrame:
    """One row for each key: the payload of the row with the greatest ``order``.

    An aggregation, not a window: rows are reduced before the shuffle, so a key
    that holds a third of the table costs one task no more than another key.
    Nulls in ``order`` sort first; rows without a key are dropped.
    """
    chosen = F.max_by(F.struct(*payload), F.struct(*order))
    return df.where(key.isNotNull()).groupBy(key.alias(name)).agg(chosen.alias("_p")).select(name, "_p.*")

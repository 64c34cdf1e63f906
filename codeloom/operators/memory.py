"""Session memory: (id, project, summary, tags, created_at, embedding)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.vectors import dot, usable
from codeloom.operators.store import upsert


def newest(sessions: DataFrame, n: int) -> DataFrame:
    """The n newest sessions of each project, then by id."""
    w = W.partitionBy("project").orderBy(F.desc_nulls_last("created_at"), "id")
    return sessions.withColumn("age_rank", F.row_number().over(w)).where(F.col("age_rank") <= n)


def save(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, "id", "created_at")


def by_prefix(sessions: DataFrame, prefix: str, n: int = 100) -> DataFrame:
    """Sessions among the n newest of their project whose id starts with ``prefix``."""
    return newest(sessions, n).where(F.col("id").cast("string").startswith(prefix))


def recall(sessions: DataFrame, queries: DataFrame, k: int = 3, recent: int = 50, dim: int = 64) -> DataFrame:
    """(project, id, score, recall_rank): of each project's ``recent`` newest sessions the k most similar to its query (project, query), newest first.

    A project without any usable vector gives its newest k.
    """
    last = newest(sessions, recent).join(queries.select("project", "query"), "project")
    s = last.withColumn("score", F.when(usable("embedding", dim), F.round(dot("embedding", "query"), 9)))
    some = F.max(F.col("score").isNotNull()).over(W.partitionBy("project"))
    s = s.withColumn("some", some).where(F.col("score").isNotNull() | ~F.col("some"))
    best = F.row_number().over(W.partitionBy("project").orderBy(F.desc_nulls_last("score"), "age_rank"))
    top = s.withColumn("best", best).where(F.col("best") <= k)
    order = F.row_number().over(W.partitionBy("project").orderBy("age_rank"))
    return top.select("project", "id", F.round("score", 4).alias("score"), order.alias("recall_rank"))


def for_injection(sessions: DataFrame) -> DataFrame:
    """(project, text): sessions as context, in order of age_rank."""
    part = F.concat(F.lit("\n## Session "), F.substring(F.col("id").cast("string"), 1, 8), F.lit(" ("), F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("?")), F.lit(")\n"), F.coalesce("summary", F.lit("")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("age_rank", part.alias("t")))), lambda x: x["t"])
    return sessions.groupBy("project").agg(F.concat(F.lit("# Prior session memory\n"), F.array_join(parts, "\n")).alias("text"))

"""Roll-ups for overviews: folders, files, edges between them, token totals, query logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.scalar import file_name, folder, token_estimate


def folders(nodes: DataFrame, root: str = "") -> DataFrame:
    """(folder, files, symbols)."""
    return nodes.where("file is not null").groupBy(folder("file", root).alias("folder")).agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("symbols"))


def files(nodes: DataFrame, root: str = "") -> DataFrame:
    """(file, name, folder, symbols): symbols without the file rows themselves."""
    n = nodes.where("file is not null")
    return n.groupBy("file").agg(F.sum((F.col("type") != "file").cast("long")).alias("symbols")).select("file", file_name("file").alias("name"), folder("file", root).alias("folder"), "symbols")


def edge_weights(nodes: DataFrame, edges: DataFrame, by: str, root: str = "") -> DataFrame:
    """(src, dst, weight): edges between different folders (by ``folder``) or files (by ``file``)."""
    key = folder("file", root) if by == "folder" else F.col("file")
    k = nodes.where("file is not null").select("id", key.alias("k"))
    both = edges.join(k.select(F.col("id").alias("src"), F.col("k").alias("a")), "src").join(k.select(F.col("id").alias("dst"), F.col("k").alias("b")), "dst")
    return both.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def naive_tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    """(tokens, texts): what reading every text whole would cost; null counts as empty."""
    return texts.agg(F.sum(token_estimate(text).cast("long")).alias("tokens"), F.count(F.lit(1)).alias("texts"))


def reduction(naive: Column | str, used: Column | str) -> Column:
    """Share of tokens saved, in per cent, to one place."""
    n, u = (F.col(x) if isinstance(x, str) else x for x in (naive, used))
    return F.round((1 - u / F.greatest(n, F.lit(1))) * 100, 1)


def saved(naive: Column | str, used: Column | str, per_million: float = 3.0) -> Column:
    n, u = (F.col(x) if isinstance(x, str) else x for x in (naive, used))
    return F.round((n - u) / 1e6 * per_million, 6)


def query_totals(log: DataFrame) -> DataFrame:
    """(queries, naive_tokens, used_tokens, reduction_pct, cost_saved) of a query log (naive_tokens, used_tokens)."""
    t = log.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("naive_tokens"), F.lit(0)).alias("naive_tokens"), F.coalesce(F.sum("used_tokens"), F.lit(0)).alias("used_tokens"))
    return t.withColumn("reduction_pct", reduction("naive_tokens", "used_tokens")).withColumn("cost_saved", saved("naive_tokens", "used_tokens"))


def recent(rows: DataFrame, key: str | None, order: str, tie: str, n: int) -> DataFrame:
    """The n last rows of each key by ``order``, then ``tie``: a ring buffer as a query."""
    if key is None:
        return rows.orderBy(F.desc_nulls_last(order), tie).limit(n)
    w = W.partitionBy(key).orderBy(F.desc_nulls_last(order), tie)
    return rows.withColumn("recent_rank", F.row_number().over(w)).where(F.col("recent_rank") <= n)

"""Task to context: similar symbols, their surroundings in the call graph, text within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.scalar import serialize_symbol, token_estimate
from codeloom.functions.vectors import top_k
from codeloom.operators.graph import pagerank, symmetrize
from codeloom.session import materialize


def search_symbols(nodes: DataFrame, queries: DataFrame, k: int = 10, dim: int = 64) -> DataFrame:
    """(query, name, type, file, line, signature, score, rank): the k symbols nearest to each of ``queries`` (id, embedding)."""
    found = top_k(queries, nodes.select("id", "embedding"), k, dim, cosine=True)
    short = nodes.select("id", "name", "type", "file", F.col("line_start").alias("line"), "signature")
    return found.join(short, "id").select("query", "id", "name", "type", "file", "line", "signature", F.round("score", 4).alias("score"), "rank")


_RANGES = 4_096  # ranges whose sums one task adds up


def within_budget(rows: DataFrame, budget: int, by: str | None, order: list[Column], tokens: str = "tokens", range_of: Column | None = None) -> DataFrame:
    """The longest prefix of rows, in ``order``, whose tokens fit the budget, with the running ``total``.

    With ``by``, each group has the budget.  ``range_of`` - a column by which
    ``order`` starts - cuts a large group into numbered ranges: their sums come
    first, so no task sorts more than one range.
    """
    keys = [by] if by else []
    if range_of is None:
        w = W.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return rows.withColumn("total", F.sum(tokens).over(w)).where(F.col("total") <= budget)
    # two levels of sums: ranges of ranges first, so that no task sees all ranges
    cut = rows.withColumn("_r", range_of)
    sums = cut.groupBy(*keys, "_r").agg(F.sum(tokens).alias("_s")).withColumn("_upper", F.floor(F.col("_r") / _RANGES))
    upper = sums.groupBy(*keys, "_upper").agg(F.sum("_s").alias("_whole"))
    by_keys = W.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])
    upper = upper.select(*keys, "_upper", F.coalesce(F.sum("_whole").over(by_keys.orderBy("_upper").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_begin")).where(F.col("_begin") <= budget)
    w = W.partitionBy(*keys, "_upper").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.join(upper, [*keys, "_upper"]).select(*keys, "_r", (F.col("_begin") + F.coalesce(F.sum("_s").over(w), F.lit(0))).alias("_b")).where(F.col("_b") <= budget)
    inner = W.partitionBy(*keys, "_r").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return cut.join(starts, [*keys, "_r"]).withColumn("total", F.col("_b") + F.sum(tokens).over(inner)).where(F.col("total") <= budget).drop("_r", "_b")


def merge_ranked(seeds: DataFrame, ranked: DataFrame) -> DataFrame:
    """(id, score, place): seeds (id, score, rank) first, then ``ranked`` (id, score, rank) at 0.8 of the score, each id once."""
    both = seeds.select("id", "score", F.col("rank").alias("place"), F.lit(0).alias("part")).unionByName(ranked.select("id", (0.8 * F.col("score")).alias("score"), F.col("rank").alias("place"), F.lit(1).alias("part")))
    first = both.groupBy("id").agg(F.min(F.struct("part", "place", "score")).alias("x"))
    return first.select("id", "x.score", F.row_number().over(W.orderBy("x.part", "x.place")).alias("place"))  # k + k rows


def get_context(nodes: DataFrame, edges: DataFrame, query: DataFrame, max_tokens: int = 4000, semantic_k: int = 5, pagerank_k: int = 25, iterations: int | None = None, dim: int = 64, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, report) for one ``query`` (id, embedding).

    rows are the chosen symbols (place, id, name, score, tokens, total, text);
    file rows are skipped before the budget is counted, and the first symbol that
    doesn't fit ends it.  ``links`` is the symmetrised call graph, if the caller has it.  report has context, tokens, nodes (merged), included.
    """
    seeds = materialize(top_k(query, nodes.select("id", "embedding"), semantic_k, dim, cosine=True).select("id", "score", "rank"), "seeds")
    links = symmetrize(nodes, edges.where("relation = 'CALLS'")) if links is None else links
    ppr = pagerank(nodes, links, seeds.select("id", F.lit(1.0).alias("p")), iterations=iterations)
    top = ppr.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(pagerank_k)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))
    merged = materialize(merge_ranked(seeds, ranked), "merged")
    text = serialize_symbol("type", "name", "file", "line_start", "line_end", "signature", "docstring")
    shown = merged.join(nodes.drop("embedding"), "id").where("type <> 'file'").withColumn("text", text).withColumn("tokens", token_estimate("text"))
    rows = within_budget(shown, max_tokens, None, [F.col("place")]).select("place", "id", "name", F.round("score", 6).alias("score"), "tokens", "total", "text")
    whole = rows.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("included"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias("body"),
    )
    head = F.format_string("# context - %d symbols, ~%d tokens\n", "included", "tokens")
    report = whole.crossJoin(merged.agg(F.count(F.lit(1)).alias("nodes"))).select(F.concat(head, "body").alias("context"), "tokens", "nodes", "included")
    return rows, report

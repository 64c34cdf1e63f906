"""Graph operators: the symmetrised call graph, breadth-first search, PageRank.

Loops run on the driver and hold no data there; each step is a join and an
aggregation whose result is written to the shared folder, in buckets of the ids
that the next step joins on.  Sums into a vertex with very many edges are reduced
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize, observed, passing, release


def existing_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): edges of which both ends are vertices (id)."""
    v = vertices.select("id")
    return edges.select("src", "dst").distinct().join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def symmetrize(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): each existing edge in both directions, once."""
    e = existing_edges(vertices, edges)
    return e.union(e.select("dst", "src")).distinct()


def bucketed(links: DataFrame) -> DataFrame:
    """``links`` (src, dst), written once in buckets by src; a table that is so already stays."""
    return links if getattr(links, "_codeloom_by", None) == "src" else _marked(materialize(links.select("src", "dst"), "links", "src"))


def _marked(df: DataFrame) -> DataFrame:
    df._codeloom_by = "src"
    return df


def bfs(links: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(id, hop): ids reached from ``start`` (id) over links (src, dst), each with its least number of hops.

    Links and the ids of each level lie in buckets, so a hop shuffles what its
    frontier reaches and nothing else: neither the links nor what was visited.
    """
    links = bucketed(links)
    count = F.count(F.lit(1))
    first, n = observed(start.select("id").distinct().withColumn("hop", F.lit(0)), "bfs", "id", n=count)
    steps = [first]
    for hop in range(1, max_depth + 1):
        if not n["n"]:
            break
        front = steps[-1].select(F.col("id").alias("src")).hint("shuffle_hash")
        new = links.join(front, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        for seen in steps:
            new = new.join(seen.select("id").hint("shuffle_hash"), "id", "left_anti")
        new, n = observed(new.withColumn("hop", F.lit(hop)), "bfs", "id", aligned=True, n=count)
        steps.append(new)
    out = steps[0]
    for s in steps[1:]:
        out = out.union(s)
    return out


def weights(links: DataFrame) -> DataFrame:
    """(src, dst, w): links weighted by one over the number of links of their source."""
    degree = links.groupBy("src").agg((1.0 / F.count(F.lit(1))).alias("w"))
    return links.join(degree, "src")


def pagerank(
    vertices: DataFrame, links: DataFrame, personal: DataFrame | None = None, alpha: float = 0.85,
    iterations: int | None = None, max_iter: int = 100, tol: float = 1e-6, scaled_tol: bool = True, retry: tuple[int, float] | None = (200, 1e-4),
) -> DataFrame:
    """(id, score) of each vertex (id) after power iteration over links (src, dst).

    ``personal`` (id, p) is where a walk restarts and where the rank of vertices
    without links goes; uniform without it.  Ids that aren't vertices are left
    out and the rest is scaled to 1; if none is left the result is empty.  With
    ``iterations``, so many are made; else until the summed change is below
    ``tol`` (times the number of vertices, if ``scaled_tol``).  If ``max_iter``
    rounds don't reach that, ``retry`` (rounds, tol) starts anew; without it, or if
    that fails too, the result is empty.

    Links and ranks lie in buckets of the same ids, so a round is one job that
    shuffles partial sums by target only.  The change and the rank that vertices
    without links hold are summed while the ranks are written.
    """
    with passing() as keep:
        links = bucketed(links)
        ids, seen = observed(vertices.select("id").distinct(), "vertices", "id", n=F.count(F.lit(1)))
        n = seen["n"]
        empty = vertices.limit(0).select("id", F.lit(0.0).alias("score"))
        if not n:
            return empty
        base = ids.withColumn("p", F.lit(1.0 / n))
        if personal is not None:
            p, seen = observed(personal.join(ids, "id", "left_semi").groupBy("id").agg(F.sum("p").alias("p")), "personal", "id", total=F.sum("p"))
            if not seen["total"]:
                return empty
            base = ids.join(p.withColumn("p", F.col("p") / F.lit(seen["total"])), "id", "left").na.fill(0.0, ["p"])
        w = materialize(weights(links), "weights", "src")
        has = links.select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(True))
        base = base.join(has, "id", "left").select("id", "p", F.coalesce("out", F.lit(False)).alias("out"), F.lit(1.0 / n).alias("score"))
        lost = F.coalesce(F.sum(F.when(~F.col("out"), F.col("score"))), F.lit(0.0))
        start, seen = observed(base, "rank", "id", lost=lost)
        for rounds, close in [(max_iter, tol)] + ([retry] if retry else []):
            rank, held = start, seen
            for i in range(1, (iterations if iterations is not None else rounds) + 1):
                flow = w.join(rank.select(F.col("id").alias("src"), "score").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("w")).alias("got"))
                score = F.lit(alpha) * (F.coalesce("got", F.lit(0.0)) + F.lit(held["lost"]) * F.col("p")) + F.lit(1 - alpha) * F.col("p")
                new = rank.join(flow.hint("shuffle_hash"), "id", "left").select("id", "p", "out", score.alias("score"), F.abs(score - F.col("score")).alias("moved"))
                new, held = observed(new, "rank", "id", aligned=True, lost=lost, moved=F.sum("moved"))
                if rank is not start:
                    release(rank)
                rank = new
                if iterations is None and held["moved"] < close * (n if scaled_tol else 1):
                    return keep(rank).select("id", "score")
            if iterations is not None:
                return keep(rank).select("id", "score")
        return empty


def ego(links: DataFrame, changed: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(vertices, links) within ``radius`` hops of ``changed`` (id)."""
    links = bucketed(links)
    near = materialize(bfs(links, changed, radius).select("id"), "ego", "id")
    return near, existing_edges(near, links)


def local_pagerank(links: DataFrame, changed: DataFrame, radius: int = 2, iterations: int | None = None, **kw) -> DataFrame:
    """PageRank of the surroundings of changed vertices; empty for fewer than two vertices, or if it doesn't converge."""
    near, inner = ego(links, changed, radius)
    if near.limit(2).count() < 2:
        return near.limit(0).select("id", F.lit(0.0).alias("score"))
    return pagerank(near, inner, iterations=iterations, retry=None, **kw)

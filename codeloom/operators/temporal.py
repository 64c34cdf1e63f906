"""The history of symbols over commits, as set operations instead of a replay.

``seen`` has one row for each symbol that a commit's version of a file holds:
(node_id, name, file, type, seq, ts, sha); ``touches`` one for each file that a
commit changed or deleted: (file, seq, ts, sha).  seq numbers commits in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def timeline(seen: DataFrame, touches: DataFrame, commits: int | None = None) -> DataFrame:
    """Lifetimes: (node_id, name, file, type, first_seen_ts, last_seen_ts, first_commit, last_commit, change_count, volatility).

    change_count is the number of commits that touched the file while the symbol
    was in it.  A symbol that its file's next touch no longer holds was last seen
    at that touch.  volatility is change_count over all commits, to four places.
    """
    once = seen.groupBy("node_id", "seq").agg(F.first(F.struct("name", "file", "type", "ts", "sha")).alias("x")).select("node_id", "seq", "x.*")
    life = once.groupBy("node_id").agg(
        F.max_by(F.struct("name", "file", "type"), "seq").alias("who"), F.min_by("ts", "seq").alias("first_seen_ts"), F.max_by("ts", "seq").alias("t"),
        F.min_by("sha", "seq").alias("first_commit"), F.max_by("sha", "seq").alias("c"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("change_count"),
    ).select("node_id", "who.*", "first_seen_ts", "t", "first_commit", "c", "seq", "change_count")
    steps = touches.select("file", "seq", "ts", "sha").distinct()
    after = W.partitionBy("file").orderBy("seq")  # one file's commits
    nxt = steps.select("file", "seq", F.lead("ts").over(after).alias("nts"), F.lead("sha").over(after).alias("nsha"))
    total = F.lit(commits).cast("long").alias("total") if commits is not None else F.countDistinct("seq").alias("total")
    both = life.join(nxt, ["file", "seq"], "left").crossJoin(F.broadcast(touches.agg(total)))  # one row
    return both.select(
        "node_id", "name", "file", "type", "first_seen_ts", F.coalesce("nts", "t").alias("last_seen_ts"), "first_commit", F.coalesce("nsha", "c").alias("last_commit"),
        "change_count", F.round(F.col("change_count") / F.greatest(F.col("total"), F.lit(1)), 4).alias("volatility"),
    )


def edge_lifetimes(seen_edges: DataFrame) -> DataFrame:
    """(src, dst, relation, first_seen_ts, last_seen_ts) of edges seen (src, dst, relation, ts)."""
    return seen_edges.groupBy("src", "dst", "relation").agg(F.min("ts").alias("first_seen_ts"), F.max("ts").alias("last_seen_ts"))


def snapshot_changes(seen: DataFrame, touches: DataFrame) -> DataFrame:
    """(file, seq, appeared, kept, gone): what each touch of a file changed against the touch before."""
    steps = touches.select("file", "seq").distinct()
    order = W.partitionBy("file").orderBy("seq")
    steps = steps.withColumn("next", F.lead("seq").over(order))
    here = seen.select("node_id", "file", "seq").distinct()
    moved = here.join(steps, ["file", "seq"]).where("next is not null").select("node_id", "file", F.col("next").alias("seq"), F.lit(True).alias("before"))
    both = here.withColumn("now", F.lit(True)).join(moved, ["node_id", "file", "seq"], "full")
    n = lambda c: F.sum(c.cast("long"))
    now, before = F.col("now").isNotNull(), F.col("before").isNotNull()
    return both.groupBy("file", "seq").agg(n(now & ~before).alias("appeared"), n(now & before).alias("kept"), n(~now & before).alias("gone"))


def coupling_pairs(nodes: DataFrame, within: int = 86_400, at_least: int = 3, limit: int | None = 20) -> DataFrame:
    """(file_a, file_b, cochange_count): files whose symbols (file, last_seen_ts) were last seen less than ``within`` seconds apart.

    A band join without a cross join: symbols are counted by file and time,
    binned by time, and each bin meets its neighbours.  Counts pairs of symbols;
    ties in the limit go by name.
    """
    span = within * 1_000_000
    t = F.unix_micros(F.col("last_seen_ts").cast("timestamp"))
    n = nodes.where("file is not null and last_seen_ts is not null").groupBy("file", t.alias("t")).agg(F.count(F.lit(1)).alias("n")).withColumn("bin", F.floor(F.col("t") / span))
    near = n.select(F.col("file").alias("file_b"), F.col("t").alias("tb"), F.col("n").alias("nb"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    hit = n.join(near, "bin").where((F.col("file") < F.col("file_b")) & (F.abs(F.col("t") - F.col("tb")) < span))
    out = hit.groupBy(F.col("file").alias("file_a"), "file_b").agg(F.sum(F.col("n") * F.col("nb")).alias("cochange_count")).where(F.col("cochange_count") >= at_least)
    return out if limit is None else out.orderBy(F.desc("cochange_count"), "file_a", "file_b").limit(limit)


def cochange_pairs(touches: DataFrame, at_least: int = 2, most_files: int | None = None) -> DataFrame:
    """(file_a, file_b, commits): files that were touched by the same commits.

    ``most_files`` leaves out sweeping commits; none are left out without it.
    """
    t = touches.select("file", "seq").distinct()
    if most_files is not None:
        t = t.join(t.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_files).select("seq"), "seq", "left_semi")
    b = t.select(F.col("file").alias("file_b"), "seq")
    return t.join(b, "seq").where("file < file_b").groupBy(F.col("file").alias("file_a"), "file_b").agg(F.count(F.lit(1)).alias("commits")).where(F.col("commits") >= at_least)


def summary(life: DataFrame, edges: DataFrame, touches: DataFrame) -> DataFrame:
    """(commits_processed, nodes_tracked, edges_tracked): one row."""
    return (
        touches.agg(F.countDistinct("seq").alias("commits_processed"))
        .crossJoin(life.agg(F.count(F.lit(1)).alias("nodes_tracked")))
        .crossJoin(edges.agg(F.count(F.lit(1)).alias("edges_tracked")))
    )

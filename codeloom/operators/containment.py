"""Parent-child links to full hierarchies, by pointer doubling.

Every child starts with a pointer to its parent.  In each round a pointer is
replaced by the pointer of its target, so its reach doubles: a tree of depth d
is resolved after about log2(d) rounds, each one join.  Depths in a forest have
no gaps, so the first round that resolves nothing proves that what is left runs
into a circle.  Each round writes its pointers to the shared folder.

Defined results: links with a null or blank end are dropped; repeated links
count once; should a child have several parents, the smallest counts; a node
that is its own parent is a circle; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.normal import filled, norm_id, norm_upper
from codeloom.session import materialize, release


def parent_links(edges: DataFrame, relation: str = "DEFINES") -> DataFrame:
    """(id, parent) of each child; repeated deliveries are reduced before the shuffle."""
    return (
        edges.where((norm_upper("relation") == relation.upper()) & filled("src") & filled("dst"))
        .groupBy(norm_id("dst").alias("id"))
        .agg(F.min(norm_id("src")).alias("parent"))
    )


def several_parents(edges: DataFrame) -> DataFrame:
    """(id, parents): ids that more than one parent defines; of those ``parent_links`` keeps the smallest."""
    used = edges.where((norm_upper("relation") == "DEFINES") & filled("src") & filled("dst")).select(norm_id("dst").alias("id"), norm_id("src").alias("parent"))
    return used.groupBy("id").agg(F.countDistinct("parent").alias("parents")).where("parents > 1")


def _double(links: DataFrame, trail: bool) -> tuple[DataFrame, DataFrame | None]:
    """Pointers of all children (id, anc, hop, done[, up]) and those that never end.

    ``up`` is the list of ancestors from ``anc`` down to the parent.
    """
    state = links.select("id", F.col("parent").alias("anc"), F.lit(1).alias("hop"), F.lit(False).alias("done"), *([F.array("parent").alias("up")] if trail else []))
    state = materialize(state, "pointers")
    left = None
    while True:
        goal = state.select(F.col("id").alias("anc"), F.col("anc").alias("a2"), F.col("hop").alias("h2"), F.col("done").alias("d2"), *([F.col("up").alias("u2")] if trail else []))
        open_ = state.where(~F.col("done")).join(goal, "anc", "left")
        known = F.col("h2").isNotNull()
        moved = open_.select(
            "id",
            F.when(known, F.col("a2")).otherwise(F.col("anc")).alias("anc"),
            F.when(known, F.col("hop") + F.col("h2")).otherwise(F.col("hop")).alias("hop"),
            F.when(known, F.col("d2")).otherwise(F.lit(True)).alias("done"),
            *([F.when(known, F.concat("u2", "up")).otherwise(F.col("up")).alias("up")] if trail else []),
        )
        new = materialize(state.where("done").unionByName(moved), "pointers")
        now = new.where(~F.col("done")).count()
        release(state)
        state = new
        if now == 0:
            return state, None
        if now == left:
            return state, state.where(~F.col("done")).select("id")
        left = now


def _landed(links: DataFrame, caught: DataFrame) -> DataFrame:
    """(id, anc, low) for ids on a circle or below one: a far ancestor and the smallest id on the way.

    Every parent of a caught id is caught too.  After R rounds with 2**R >= n,
    each pointer ends on a circle, each id of a circle is the end of one, and the
    minimum over the stretch that starts there covers the circle.
    """
    state = materialize(links.join(caught, "id", "left_semi").select("id", F.col("parent").alias("anc"), F.col("id").alias("low")), "circles")
    reach, n = 1, state.count()
    while reach < n:
        goal = state.select(F.col("id").alias("anc"), F.col("anc").alias("a2"), F.col("low").alias("l2"))
        new = materialize(state.join(goal, "anc").select("id", F.col("a2").alias("anc"), F.least("low", "l2").alias("low")), "circles")
        release(state)
        state, reach = new, reach * 2
    return state


def _circles(landed: DataFrame) -> DataFrame:
    """(id, root) for ids on a circle or below one; root is the smallest id on the circle."""
    return landed.select("id", "anc").join(landed.select(F.col("id").alias("anc"), F.col("low").alias("root")), "anc").select("id", "root")


def hierarchy(edges: DataFrame, relation: str = "DEFINES", trail: bool = False) -> DataFrame:
    """(id, root, depth[, up]): one row for each id at either end of a link.

    depth is 0 at a root, whose root is itself, and -1 for ids on a circle or
    below one.  With ``trail``, ``up`` lists the ancestors from the root down
    (empty for a root, null where there is none).
    """
    links = materialize(parent_links(edges, relation), "links")
    state, caught = _double(links, trail)
    more = ["up"] if trail else []
    nested = state.where("done").select("id", F.col("anc").alias("root"), F.col("hop").cast("int").alias("depth"), *more)
    none: list[Column] = [F.array().cast("array<string>").alias("up")] if trail else []
    heads = (
        links.select(F.col("parent").alias("id"))
        .distinct()
        .join(links.select("id"), "id", "left_anti")
        .select("id", F.col("id").alias("root"), F.lit(0).alias("depth"), *none)
    )
    out = nested.unionByName(heads)
    if caught is not None:
        lost = [F.lit(None).cast("array<string>").alias("up")] if trail else []
        out = out.unionByName(_circles(_landed(links, caught)).select("id", "root", F.lit(-1).alias("depth"), *lost))
    return out


def paths(edges: DataFrame, relation: str = "DEFINES", sep: str = "/") -> DataFrame:
    """(id, root, depth, path): path from the root to the id; null on circles and below."""
    whole = F.when(F.col("up").isNotNull(), F.concat_ws(sep, F.concat("up", F.array("id"))))
    return hierarchy(edges, relation, trail=True).select("id", "root", "depth", whole.alias("path"))


def _pairs(nested: DataFrame) -> DataFrame:
    """(id, descendant, distance) from ids with their ``depth`` and ancestors ``up``."""
    return nested.select(F.col("id").alias("descendant"), "depth", F.posexplode("up").alias("at", "id")).select(
        "id", "descendant", (F.col("depth") - F.col("at")).alias("distance")
    )


def descendants(edges: DataFrame, relation: str = "DEFINES") -> DataFrame:
    """(id, descendant, distance): each node of a tree with each node below it.

    Pairs on circles and below are those of ``circle_descendants``.
    """
    return _pairs(hierarchy(edges, relation, trail=True).where("depth > 0"))


def circle_descendants(edges: DataFrame, relation: str = "DEFINES") -> DataFrame:
    """(id, descendant, distance) where id is on a circle or below one.

    The ids of a circle are cut from their parents, so what is below them are
    trees.  An id of a circle has all others of its circle and all that is below
    any of them as descendants; the distance is that of the shortest way.
    """
    links = materialize(parent_links(edges, relation), "links")
    state, caught = _double(links, False)
    if caught is None:
        return state.limit(0).select("id", F.col("anc").alias("descendant"), F.lit(0).alias("distance"))
    landed = _landed(links, caught)
    ring = materialize(_circles(landed).join(landed.select(F.col("anc").alias("id")).distinct(), "id", "left_semi"), "ring")
    below = links.join(caught, "id", "left_semi").join(ring, "id", "left_anti")
    nested = materialize(_double(below, True)[0].select("id", F.col("hop").cast("int").alias("depth"), "up"), "below")
    # a circle, cut above its smallest id, is a chain; its hops tell the order
    chain = _double(links.join(ring.where("id <> root"), "id", "left_semi"), False)[0].select("id", "hop")
    place = ring.join(chain, "id", "left").select("id", "root", F.coalesce("hop", F.lit(0)).cast("int").alias("place"))
    place = materialize(place.join(ring.groupBy("root").agg(F.count(F.lit(1)).cast("int").alias("size")), "root"), "ring")
    other = place.select("root", F.col("id").alias("descendant"), F.col("place").alias("there"))
    around = place.join(other, "root").where("id <> descendant").select("id", "descendant", F.pmod(F.col("there") - F.col("place"), "size").alias("distance"))
    around = materialize(around, "around")
    far = around.select("id", F.col("descendant").alias("top"), "distance").join(nested.select(F.col("up")[0].alias("top"), F.col("id").alias("descendant"), "depth"), "top")
    return _pairs(nested).unionByName(around).unionByName(far.select("id", "descendant", (F.col("distance") + F.col("depth")).alias("distance")))


def all_descendants(edges: DataFrame, relation: str = "DEFINES") -> DataFrame:
    """(id, descendant, distance): each node with each node below it, in trees, on circles and below circles."""
    edges = materialize(edges.select("src", "dst", "relation"), "edges")
    return descendants(edges, relation).unionByName(circle_descendants(edges, relation))

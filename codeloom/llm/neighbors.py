"""The most similar vectors of every vector, from balanced posting lists.

1. *Centroids.*  Balanced k-means trees are fitted to all vectors: a cluster is
   split until it holds no more than its share, so dense regions get many small
   lists.  Beyond ``sample_rows`` vectors a sample gives cells, and each cell
   fits centroids to all its vectors in a task.
2. *Centroid graph.*  Centroids and their nearest centroids form a graph that
   fits in memory; a best-first search, which enters it by groups of centroids
   around hubs, finds the lists near a vector.
3. *Replication.*  A vector is a member of its nearest list and of each further
   list whose centroid is at most (1 + ``slack``) times as far, up to ``copies``:
   as a rule of all that it asks, which costs no further row.
4. *Pruning.*  A vector asks the lists whose centroids are at most
   (1 + ``reach``) times as far as the nearest, up to ``probes``.  Both choices
   come from one search, so a vector is sent to a list once, as member and query.
5. *Lists.*  Each list compares its members with its queries in blocks of a
   matrix product and keeps the best ``k`` for each query at or above the
   threshold; the best of all lists follow by a rank over each query.  A list of
   very many rows is cut into shares of members and of queries, each pair of
   shares in a task, and there into lists of its own.

Vectors that are the same up to length form one class, compared once; a class
keeps its ``k + 1`` smallest ids, which is all that any ranking by similarity,
then id, can name.  Only centroids and their graph (bounded by ``max_lists``)
leave the executors.

Defined results: null, short, long, infinite and zero vectors are unusable and
give no rows; ties in similarity go to the smaller id; empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.session import materialize, ship


@dataclass(frozen=True)
class Params:
    """sample_rows bounds the vectors that the driver holds (256 bytes each), max_lists the centroids; cell_rows is the size of a cell.

    list_size is the number of vectors for which there is one list.  Beyond
    max_lists * list_size vectors a list holds more, and is divided again where it
    lies: a part of it with more than ``divide`` members has lists of list_size of
    its own.  part_rows bounds the members and the questions of a part.
    """

    dim: int = 64
    k: int = 5
    least: float = 0.88
    list_size: int = 64
    sample_rows: int = 262_144
    cell_rows: int = 65_536
    max_lists: int = 262_144
    divide: int = 2_048
    part_rows: int = 32_768
    degree: int = 32
    copies: int = 8
    slack: float = 0.2
    probes: int = 8
    reach: float = 0.2
    block: int = 2_048
    seed: int = 11


# ---------------------------------------------------------------- vectors


def pack_unit(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """(id, embedding) to (id, vec): unit vectors as bytes of float32; unusable ones are dropped."""
    for b in batches:
        vecs = b.column("embedding")
        starts = np.asarray(vecs.offsets)[: len(vecs)] if len(vecs) else np.zeros(0, np.int64)
        sizes = np.diff(np.asarray(vecs.offsets)) if len(vecs) else np.zeros(0, np.int64)
        flat = np.asarray(vecs.values.to_numpy(zero_copy_only=False), dtype=np.float64)
        ok = (sizes == dim) & np.asarray(vecs.is_valid())
        rows = np.flatnonzero(ok)
        m = flat[starts[rows][:, None] + np.arange(dim)[None, :]] if len(rows) else np.zeros((0, dim))
        good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
        rows, m = rows[good], m[good]
        m = m / np.abs(m).max(axis=1, keepdims=True) if len(rows) else m
        m = m / np.sqrt((m * m).sum(axis=1, keepdims=True)) if len(rows) else m
        raw = np.ascontiguousarray(m.astype(np.float32)).view(np.uint8).tobytes()
        step = 4 * dim
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary())], names=["id", "vec"])


def unpack(col: pa.Array, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.float32).reshape(-1, dim)


# ---------------------------------------------------------------- centroids


def _split(x: np.ndarray, ways: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Labels of a spherical k-means with a penalty on full clusters."""
    c = x[rng.choice(len(x), ways, replace=False)].copy()
    fair, bias = len(x) / ways, np.zeros(ways, np.float32)
    for _ in range(rounds):
        label = np.argmax(x @ c.T - bias, axis=1)
        n = np.bincount(label, minlength=ways)
        for j in np.flatnonzero(n):
            c[j] = x[label == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        bias = np.clip(bias + 0.02 * (n / fair - 1), 0, 0.3).astype(np.float32)
    return label


def fit_centroids(x: np.ndarray, lists: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """At most about ``lists`` unit centroids and how much of ``x`` each stands for; no cluster of vectors that differ holds more than twice its share."""
    rng = np.random.default_rng(seed)
    if len(x) == 0:
        return np.zeros((0, x.shape[1]), np.float32), np.zeros(0, np.int64)
    share = max(1.0, len(x) / max(1, lists))
    todo, out, sizes = [np.arange(len(x))], [], []
    while todo:
        rows = todo.pop()
        if len(rows) <= 1.5 * share or len(rows) < 2:
            out.append(x[rows].mean(axis=0))
            sizes.append(len(rows))
            continue
        ways = int(min(32, max(2, round(len(rows) / share)), len(rows)))
        label = _split(x[rows], ways, rng)
        parts = [rows[label == j] for j in range(ways)]
        parts = [q for q in parts if len(q)]
        if len(parts) == 1:  # alike up to rounding
            out.append(x[rows].mean(axis=0))
            sizes.append(len(rows))
        else:
            todo += parts
    c = np.array(out, dtype=np.float32)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9), np.array(sizes)


@dataclass(frozen=True)
class Graph:
    """Centroids, the neighbours of each, and groups of them around hubs, through which a search enters."""

    at: np.ndarray
    near: np.ndarray
    hubs: np.ndarray
    group: np.ndarray
    start: np.ndarray


def entries(g: Graph, q: np.ndarray, want: int, look: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the ``want`` nearest centroids in the groups of the ``look`` hubs nearest to each row of ``q``, in no order; -1 where there are fewer."""
    look = min(look, len(g.hubs))
    s = q @ g.hubs.T
    hub = np.argpartition(-s, look - 1, axis=1)[:, :look].ravel()
    order = np.argsort(hub, kind="stable")
    ends = np.searchsorted(hub[order], np.arange(len(g.hubs) + 1))
    ids, sim = np.full((len(hub), want), -1, np.int32), np.full((len(hub), want), -9.0, np.float32)
    for h in np.flatnonzero(np.diff(ends)):
        slots, mine = order[ends[h] : ends[h + 1]], g.group[g.start[h] : g.start[h + 1]]
        x = q[slots // look] @ g.at[mine].T
        w = min(want, len(mine))
        top = np.argpartition(-x, w - 1, axis=1)[:, :w] if w else np.zeros((len(slots), 0), np.int64)
        ids[slots, :w], sim[slots, :w] = mine[top], np.take_along_axis(x, top, 1)
    ids, sim = ids.reshape(len(q), -1), sim.reshape(len(q), -1)
    best = np.argpartition(-sim, want - 1, axis=1)[:, :want]
    return np.take_along_axis(ids, best, 1), np.take_along_axis(sim, best, 1)


def looks(g: Graph) -> int:
    """The number of groups that a search enters, which grows with the root of their number."""
    return 4 + 2 * int(np.sqrt(len(g.hubs)))


def build_graph(c: np.ndarray, degree: int, seed: int, group: int = 128) -> Graph:
    n = len(c)
    d = min(degree, max(1, n - 1))
    hubs = fit_centroids(c, max(1, n // group), seed)[0] if n > group else c.mean(axis=0, keepdims=True) if n else c
    of = np.concatenate([np.argmax(c[i : i + 4096] @ hubs.T, axis=1) for i in range(0, n, 4096)]) if n else np.zeros(0, np.int64)
    order = np.argsort(of, kind="stable").astype(np.int32)
    g = Graph(c, np.zeros((n, d), np.int32), hubs, order, np.searchsorted(of[order], np.arange(len(hubs) + 1)))
    for i in range(0, n, 4096) if n > 1 else ():
        ids, sim = entries(g, c[i : i + 4096], d + 1, looks(g))
        sim[ids == np.arange(i, i + len(ids))[:, None]] = -8.0  # itself comes last
        top = np.take_along_axis(ids, np.argsort(-sim, axis=1, kind="stable")[:, :d], 1)
        g.near[i : i + 4096] = np.where(top < 0, top[:, :1], top)
    # seven of eight links go to the nearest, the rest to any: the graph stays connected
    if n > 4 * d:
        g.near[:, -max(1, d // 8) :] = np.random.default_rng(seed).integers(0, n, (n, max(1, d // 8)))
    return g


def search(g: Graph, q: np.ndarray, want: int, beam: int = 48, rounds: int = 20, far: float = 1.6) -> tuple[np.ndarray, np.ndarray]:
    """(lists, similarities) of the ``want`` nearest centroids of each row of ``q``, best first.

    A row starts at the best of the groups nearest to it; then all rows walk the
    graph together: each round expands the three best candidates that a row hasn't
    expanded yet and keeps its ``beam`` best.  A candidate ``far`` times as far as
    the best isn't expanded; a row without candidates is done.
    """
    n = len(g.at)
    beam = min(max(beam, want), n)
    ids, sim = entries(g, q, beam, looks(g))
    done = ids < 0
    live = np.arange(len(q) if looks(g) < len(g.hubs) else 0)  # else all have been seen
    for _ in range(rounds):
        i, x, d = ids[live], sim[live], done[live]
        open_ = np.where(d | (x < 1 - far * far * (1 - x.max(axis=1, keepdims=True))), -9.0, x)
        go = open_.max(axis=1) > -9.0
        if not go.all():
            live, i, x, d, open_ = live[go], i[go], x[go], d[go], open_[go]
        if not len(live):
            break
        rows = np.arange(len(live))[:, None]
        pick = np.argpartition(-open_, min(3, beam) - 1, axis=1)[:, :3]
        np.put_along_axis(d, pick, True, 1)
        cand = g.near[np.maximum(np.take_along_axis(i, pick, 1), 0)].reshape(len(live), -1)
        cs = np.einsum("ncd,nd->nc", g.at[cand], q[live])
        all_ids, all_sim, all_done = np.concatenate([i, cand], 1), np.concatenate([x, cs], 1), np.concatenate([d, np.zeros_like(cand, bool)], 1)
        # one place for each id: after sorting by id, what was expanded comes first
        order = np.argsort(all_ids * 2 + ~all_done, axis=1)
        all_ids, all_sim, all_done = all_ids[rows, order], all_sim[rows, order], all_done[rows, order]
        again = np.zeros_like(all_done)
        again[:, 1:] = all_ids[:, 1:] == all_ids[:, :-1]
        all_sim = np.where(again | (all_ids < 0), -9.0, all_sim)
        keep = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        i, x, d = all_ids[rows, keep], all_sim[rows, keep], all_done[rows, keep]
        ids[live], sim[live], done[live] = np.where(x <= -9.0, -1, i), x, d | (x <= -9.0)
    best = np.argsort(-sim, axis=1, kind="stable")[:, :want]
    return np.take_along_axis(ids, best, 1), np.take_along_axis(sim, best, 1)


def route(g: Graph, q: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, member): where each vector is sent, and whether it is a member there."""
    if not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
    lists, sim = search(g, q, max(p.probes, p.copies))
    far = np.sqrt(np.maximum(2 - 2 * sim, 1e-12))
    rank = np.arange(lists.shape[1])[None, :]
    member = (far <= far[:, :1] * (1 + p.slack)) & (rank < p.copies)
    sent = member | ((far <= far[:, :1] * (1 + p.reach)) & (rank < p.probes))
    sent &= lists >= 0
    r, j = np.nonzero(sent)
    return r, lists[r, j], member[r, j]


# ---------------------------------------------------------------- lists


def best_in_list(q: np.ndarray, qid: np.ndarray, m: np.ndarray, mid: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, similarity): the k best members at or above the threshold for each query, itself left out."""
    qs, ms, ss = [], [], []
    for i in range(0, len(q), p.block):
        best_s = np.full((min(p.block, len(q) - i), 0), -9.0, np.float64)
        best_m = np.zeros(best_s.shape, np.int64)
        for j in range(0, len(m), p.block):
            s = q[i : i + p.block] @ m[j : j + p.block].T
            r, c = np.nonzero(s >= p.least - 1e-5)
            if not len(r):
                continue
            other = qid[i + r] != mid[j + c]
            r, c = r[other], c[other]
            exact = np.einsum("nd,nd->n", q[i + r].astype(np.float64), m[j + c].astype(np.float64))
            ok = exact >= p.least
            r, c, exact = r[ok], c[ok], exact[ok]
            order = np.lexsort((c, -exact, r))
            r, c, exact = r[order], c[order], exact[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            keep = place < p.k + 1
            r, c, exact, place = r[keep], c[keep], exact[keep], place[keep]
            now_s, now_m = np.full((best_s.shape[0], p.k + 1), -9.0), np.zeros((best_s.shape[0], p.k + 1), np.int64)
            now_s[r, place], now_m[r, place] = exact, j + c
            best_s, best_m = np.concatenate([best_s, now_s], 1), np.concatenate([best_m, now_m], 1)
            if best_s.shape[1] > p.k + 1:
                top = np.argsort(-best_s, axis=1, kind="stable")[:, : p.k + 1]
                best_s, best_m = np.take_along_axis(best_s, top, 1), np.take_along_axis(best_m, top, 1)
        r, c = np.nonzero(best_s > -9.0)
        qs.append(i + r)
        ms.append(best_m[r, c])
        ss.append(best_s[r, c])
    return np.concatenate(qs), np.concatenate(ms), np.concatenate(ss)


def best_in_part(q: np.ndarray, qid: np.ndarray, m: np.ndarray, mid: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_in_list``, by lists of its own if there are many members."""
    if len(m) <= p.divide:
        return best_in_list(q, qid, m, mid, p)
    g = build_graph(fit_centroids(m, -(-len(m) // p.list_size), p.seed)[0], p.degree, p.seed)
    routed = []
    for x, only in ((m, True), (q, False)):
        got = [(r + at, to) for at in range(0, len(x), 2_000) for r, to, member in [route(g, x[at : at + 2_000], p)] for r, to in [(r[member], to[member]) if only else (r, to)]]
        rows, to = (np.concatenate(v) for v in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        order = np.argsort(to, kind="stable")
        routed.append((rows[order], np.searchsorted(to[order], np.arange(len(g.at) + 1))))
    (mr, mc), (qr, qc) = routed
    out = []
    for k in range(len(g.at)):
        mine, asks = mr[mc[k] : mc[k + 1]], qr[qc[k] : qc[k + 1]]
        if len(mine) and len(asks):
            a, b, s = best_in_list(q[asks], qid[asks], m[mine], mid[mine], p)
            out.append((asks[a], mine[b], s))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(v) for v in zip(*out))  # type: ignore[return-value]


def _list_group(table: pa.Table, p: Params) -> pa.Table:
    vec, ids = unpack(table.column("vec"), p.dim), table.column("id").combine_chunks()
    member = np.flatnonzero(table.column("member").to_numpy(zero_copy_only=False))
    asks = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
    if not len(member) or not len(asks):
        return pa.table({"id": pa.array([], pa.string()), "other": pa.array([], pa.string()), "sim": pa.array([], pa.float64())})
    q, m, s = best_in_part(vec[asks], asks, vec[member], member, p)
    return pa.table({"id": ids.take(pa.array(asks[q])), "other": ids.take(pa.array(member[m])), "sim": pa.array(s)})


def cells(to: np.ndarray, member: np.ndarray, r: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, part, member, asks): the parts of its list to which each entry goes.

    A list has parts[0] shares of members by parts[1] shares of questions, each
    pair of shares in one part: all its members meet all its questions.
    """
    pm, pq = parts[0][to].astype(np.int64), parts[1][to].astype(np.int64)
    one = pm * pq == 1
    at = [np.flatnonzero(one)]
    part, mine, asks = [np.zeros(int(one.sum()), np.int64)], [member[one]], [np.ones(int(one.sum()), bool)]
    for i in np.flatnonzero(~one):  # lists of more than a part
        a, b = r[i] % pm[i], (r[i] // pm[i]) % pq[i]
        grid = np.arange(pm[i] * pq[i])
        is_m, is_q = (grid // pq[i] == a) & member[i], grid % pq[i] == b
        go = np.flatnonzero(is_m | is_q)
        at.append(np.full(len(go), i)), part.append(grid[go]), mine.append(is_m[go]), asks.append(is_q[go])
    return np.concatenate(at), np.concatenate(part), np.concatenate(mine), np.concatenate(asks)


# ---------------------------------------------------------------- the whole


def fit_lists(units: DataFrame, n: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the lists for all ``n`` vectors, and how many each stands for."""
    lists = min(p.max_lists, max(1, -(-n // p.list_size)))
    share = min(1.0, p.sample_rows / max(1, n))
    chosen = units if share >= 1.0 else units.where(F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = unpack(chosen.select("vec").toArrow().column("vec"), p.dim)
    if share >= 1.0 or not len(sample):
        return fit_centroids(sample, lists, p.seed)
    sample = sample[np.lexsort(sample.T[:3])]  # the same lists in whatever order the rows come
    cells = build_graph(fit_centroids(sample, -(-n // p.cell_rows), p.seed)[0], p.degree, p.seed)
    of = np.concatenate([search(cells, sample[i : i + 2_000], 1)[0][:, 0] for i in range(0, len(sample), 2_000)])
    # a cell of more than twice its rows is dealt out at random
    hands = np.maximum(1, np.ceil(np.bincount(of, minlength=len(cells.at)) / len(sample) * n / (2 * p.cell_rows))).astype(np.int64)
    shared = units.sparkSession.sparkContext.broadcast(cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 2_000) for whole in batches for at in range(0, whole.num_rows, 2_000)):
            cell = search(shared.value, unpack(b.column("vec"), p.dim), 1)[0][:, 0]
            hand = b.column("deal").to_numpy(zero_copy_only=False) % hands[cell]
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(hand, pa.int32()), b.column("vec")], names=["cell", "hand", "vec"])

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        x = unpack(table.column("vec"), p.dim)
        x = x[np.lexsort(x.T[:3])]
        c, sizes = fit_centroids(x, -(-len(x) * lists // n), p.seed)
        raw, step = c.tobytes(), 4 * p.dim
        at = [pa.array([k.as_py()] * len(c), pa.int32()) for k in key]
        return pa.table([*at, pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary()), pa.array(sizes, pa.int64())], names=["cell", "hand", "vec", "size"])

    dealt = units.select("vec", F.pmod(F.xxhash64("id", F.lit(p.seed + 1)), F.lit(1 << 30)).alias("deal")).mapInArrow(deal, "cell int, hand int, vec binary")
    fitted = dealt.groupBy("cell", "hand").applyInArrow(fit, "cell int, hand int, vec binary, size long").toArrow()
    fitted = fitted.take(pa.array(np.lexsort((fitted.column("hand").to_numpy(), fitted.column("cell").to_numpy()))))
    return unpack(fitted.column("vec"), p.dim), fitted.column("size").to_numpy()


def nearest(units: DataFrame, p: Params) -> DataFrame:
    """(id, other, sim): for each distinct vector its best k + 1 others at or above the threshold.

    ``units`` is a written table (id, vec), each vector once.
    """
    spark = units.sparkSession
    n = units.count()
    centroids, sizes = fit_lists(units, n, p)
    shared = spark.sparkContext.broadcast(build_graph(centroids, p.degree, p.seed))
    # what each list may hold: the vectors that it stands for, at the most copies and probes
    most = np.minimum([[p.copies], [p.probes]], max(1, len(centroids))) * sizes
    parts = np.maximum(1, np.ceil(most / p.part_rows)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(p.seed)
        for b in (whole.slice(at, 2_000) for whole in batches for at in range(0, whole.num_rows, 2_000)):
            q = unpack(b.column("vec"), p.dim)
            r, to, member = route(shared.value, q, p)
            entry, part, member, asks = cells(to, member, rng.integers(0, 1 << 30, len(q))[r], parts)
            rows = pa.array(r[entry])
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[entry], pa.int32()), pa.array(part, pa.int32()), pa.array(member), pa.array(asks), b.column("id").take(rows), b.column("vec").take(rows)],
                names=["list", "part", "member", "asks", "id", "vec"],
            )

    sent = units.mapInArrow(send, "list int, part int, member boolean, asks boolean, id string, vec binary")
    pairs = sent.groupBy("list", "part").applyInArrow(lambda t: _list_group(t, p), "id string, other string, sim double")
    once = pairs.groupBy("id", "other").agg(F.max("sim").alias("sim"))
    best = W.partitionBy("id").orderBy(F.desc("sim"), "other")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k + 1).drop("rank")


def similar_pairs(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """(id_a, id_b, sim): pairs at or above the threshold of which one is among the k most similar of the other.

    ``vectors`` has id (distinct) and embedding.  Each pair once, id_a < id_b.
    """
    ship(vectors.sparkSession)
    units = materialize(
        vectors.select("id", "embedding").where(F.size("embedding") == p.dim).mapInArrow(lambda it: pack_unit(it, p.dim), "id string, vec binary").withColumn("h", F.xxhash64("vec")).withColumn("g", F.hash("vec")),
        "units",
    )
    twins = materialize(units.groupBy("h", "g").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "twins")
    if twins.isEmpty():
        found = nearest(units.select("id", "vec"), p)
        ranked = W.partitionBy("id").orderBy(F.desc("sim"), "other")
        top = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= p.k)
    else:
        of = units.select("id", "h", "g").join(twins, ["h", "g"]).select("id", "head")
        heads = materialize(units.join(of.where("id <> head").select("id"), "id", "left_anti").select("id", "vec"), "heads")
        first = of.withColumn("rank", F.row_number().over(W.partitionBy("head").orderBy("id"))).where(F.col("rank") <= p.k + 1).select("head", F.col("id").alias("other"))
        between = materialize(nearest(heads, p), "between")
        spread = (
            between.select(F.col("id").alias("head"), F.col("other").alias("to"), "sim")
            .join(first.withColumnRenamed("head", "to"), "to", "left")
            .select("head", F.coalesce("other", "to").alias("other"), "sim")
            .unionByName(first.withColumn("sim", F.lit(1.0)))
        )
        ranked = W.partitionBy("head").orderBy(F.desc("sim"), "other")
        kept = spread.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= p.k + 1)
        lists = kept.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "sim"))).alias("near"))  # k + 1 each
        whole = heads.select("id", F.col("id").alias("head")).unionByName(of.where("id <> head"))
        mine = F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, p.k)
        top = whole.join(lists, "head").select("id", F.explode(mine).alias("x")).select("id", "x.other", "x.sim")
    return top.groupBy(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).agg(F.max("sim").alias("sim"))

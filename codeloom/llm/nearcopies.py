"""Near-duplicate records with small edits, by PartEnum signatures.

A text is the set of its distinct runs of ``run`` words.  Two sets of sizes
l <= L with similarity at least g differ in at most (1-g)/(1+g) * (l+L) members.

*Bands.*  Sizes are cut into bands [a, a/g]; similar sets lie in the same band or
in neighbouring ones, so a set takes part in the instance of its own band and of
the next.  k is the greatest difference in an instance.

*Signatures.*  An instance hashes the domain into n1 = k//2 + 3 partitions of
three parts each.  Of n1 partitions at least three hold at most one difference,
and of the three parts of such a partition at least two hold none.  So for each
partition each two of its parts give a signature, and similar sets share at
least n1 - k'//2 signatures of an instance, k' being the greatest difference for
their own sizes.  Pairs that share less than half of that are no candidates.

*Tiers.*  A signature may be shared by a third of all records if it consists of
runs that everyone uses.  Leaving members out of the domain can only reduce a
difference, so the first tier leaves out runs in more than ``common`` sets,
which are counted exactly, however the rows lie; then no signature is in more sets
than that, at any size.  Parts that are left empty sign nothing, so sets that keep
less than ``kept`` of their members go on to the next tier, which counts again
among them with ``widen`` times the bound, until none is left or nothing is left
out.

*Small sets.*  Few members leave most parts empty, so less is shared than that.
Pairs of which one set has at most ``exact`` members are candidates if they share
a run of their prefixes: with all runs in one order, the rarest first, similar
sets of size n share one of the first n - ceil(g * n) + 1.  That misses none.

Candidates are verified exactly.  Texts with the same set form one class, which
is compared once; members are joined to the result at the end.

Postings travel as packed blocks of many signatures, one row for each bucket of
signatures and batch of texts, and are matched with array operations.

Defined results: null, empty and short texts (fewer than ``least_words`` words)
are left out; repeated rows of an id are one record; texts are read whole;
empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.session import materialize, release, ship


@dataclass(frozen=True)
class Params:
    """least: similarity; run: words in a run; expand: copies up to which classes are spelt out as pairs, null for all.
    exact: members up to which a set is compared with all that share a rare run of it.

    frequent_rows and sent_rows bound the frequent runs and the rows of numbers (8 bytes each)
    that are sent to every executor; more of them are joined by a shuffle instead.
    """

    least: float = 0.8
    run: int = 5
    least_words: int = 0
    common: int = 32
    kept: float = 0.6
    widen: int = 8
    frequent_rows: int = 262_144
    exact: int = 24
    expand: int | None = 64
    sent_rows: int = 1_000_000


_WORD = re.compile(r"[a-z0-9_]+")
_U = np.uint64
_PARTS, _SHARED, _MOST = 3, 3, 1 << 24
_TEXTS = "id string, h long, g long, n int, runs binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters its input."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def runs_of(text: str, run: int, least_words: int) -> np.ndarray | None:
    """Sorted 64-bit values of the distinct runs of ``run`` words; null for a text without any."""
    words = _WORD.findall(text.lower())
    if len(words) < max(run, least_words):
        return None
    one = {w: zlib.crc32(w.encode()) | (zlib.adler32(w.encode()) ^ len(w)) << 32 for w in set(words)}
    h = np.fromiter((one[w] for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - run + 1, np.uint64)
        for i in range(run):
            out = _mix(out + h[i : i + len(out)] + _U(0x9E3779B97F4A7C15))
    return np.unique(out)


def _read(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, h, g, n, raw = [], [], [], [], []
        for i, t in enumerate(b.column("text").to_pylist()):
            if t and (r := runs_of(t, p.run, p.least_words)) is not None:
                with np.errstate(over="ignore"):
                    a, c = _mix(r).sum(dtype=np.uint64), _mix(r ^ _U(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
                rows.append(i), n.append(len(r)), raw.append(r.tobytes())
                h.append(int(a.astype(np.int64))), g.append(int(c.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(n, pa.int32()), pa.array(raw, pa.binary())], names=["id", "h", "g", "n", "runs"])


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Members of all sets of a batch and the row of each."""
    raw = col.to_pylist()
    sizes = np.array([len(x) // 8 for x in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint64), np.repeat(np.arange(len(raw)), sizes)


# ---------------------------------------------------------------- common runs


def frequent_runs(sets: DataFrame, bound: int, ranges: int) -> DataFrame:
    """(run): exactly the runs in more than ``bound`` sets, written.

    Each task counts its runs and hands on sorted blocks, one for each range of
    values, as differences that compress; the blocks of a range are summed in one
    task.  ``ranges`` is a power of two that grows with the number of runs.
    """
    bits = ranges.bit_length() - 1

    def block(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        where = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        cut = np.searchsorted(where, np.arange(ranges + 1))
        rows = [(k, keys[cut[k] : cut[k + 1]], sums[cut[k] : cut[k + 1]]) for k in range(ranges) if cut[k + 1] > cut[k]]
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in rows], pa.int32()), pa.array([_planes(np.diff(x, prepend=_U(0))) for _, x, _ in rows], pa.binary()), pa.array([_planes(n.astype(np.uint32)) for _, _, n in rows], pa.binary())],
            names=["range", "runs", "n"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for b in batches:
            x, _ = _flat(b.column("runs"))
            got.append(x)
            held += len(x)
            if held > 8_000_000:
                yield block(*np.unique(np.concatenate(got), return_counts=True))
                got, held = [], 0
        if held:
            yield block(*np.unique(np.concatenate(got), return_counts=True))

    def add(t: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            keys = np.concatenate([np.cumsum(_unplanes(x, np.uint64), dtype=np.uint64) for x in t.column("runs").to_pylist()])
        sums = np.concatenate([_unplanes(x, np.uint32) for x in t.column("n").to_pylist()])
        u, at = np.unique(keys, return_inverse=True)
        return pa.table({"run": pa.array(u[np.bincount(at, sums, len(u)) > bound].view(np.int64))})

    counted = sets.select("runs").mapInArrow(count, "range int, runs binary, n binary")
    return materialize(counted.groupBy("range").applyInArrow(add, "run long"), "frequent")


def rare_only(sets: DataFrame, frequent: DataFrame) -> DataFrame:
    """(num, n, runs): ``sets`` without the frequent runs, by a join; sets of which nothing is left are missing."""
    members = sets.select("num", "n", "runs").mapInArrow(_members, "num long, n int, run long")
    left = members.join(frequent, "run", "left_anti").groupBy("num", "n").agg(F.collect_list("run").alias("some"))  # one text's runs

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.sort(np.array(x, np.int64).view(np.uint64)).tobytes() for x in b.column("some").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("num"), b.column("n"), pa.array(raw, pa.binary())], names=["num", "n", "runs"])

    return left.mapInArrow(pack, "num long, n int, runs binary")


# ---------------------------------------------------------------- signatures


def bands(least: float, top: int = 1 << 30) -> np.ndarray:
    """Last size of each band."""
    ends, a = [], 1
    while a <= top:
        ends.append(int(a / least + 1e-9))
        a = ends[-1] + 1
    return np.array(ends)


def signatures(x: np.ndarray, row: np.ndarray, band: np.ndarray, parts_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row, instance) of the sets that hold ``x`` in the instances of their own and the next band."""
    out = []
    n = len(band)
    for step in (0, 1):
        inst = band + step
        n1 = parts_of[inst]
        with np.errstate(over="ignore"):
            salt = _mix((inst.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
            m = _mix(x ^ salt[row])
        cell = (m % (n1[row] * _PARTS).astype(np.uint64)).astype(np.int64)
        width = int((n1.max() if n else 1) * _PARTS)
        place, at = np.unique(row * width + cell, return_inverse=True)
        with np.errstate(over="ignore"):
            total = np.zeros(len(place), np.uint64)
            np.add.at(total, at, _mix(m))
        grid = np.zeros(n * width, np.uint64)
        grid[place] = total  # 0: the part holds nothing
        grid = grid.reshape(n, width // _PARTS, _PARTS)
        for a, b in ((0, 1), (0, 2), (1, 2)):
            left, right = grid[:, :, a], grid[:, :, b]
            r, f = np.nonzero((left != 0) | (right != 0))
            with np.errstate(over="ignore"):
                which = (inst[r] * 1_000_003 + f * 3 + (a + b)).astype(np.uint64)
                out.append((_mix(_mix(left[r, f] + which) + right[r, f]), r, inst[r]))
    return tuple(np.concatenate(v) for v in zip(*out))  # type: ignore[return-value]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes first, which compresses what is alike."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def _unplanes(raw: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def needed(na: np.ndarray, nb: np.ndarray, n1: np.ndarray, least: float) -> np.ndarray:
    """Shared signatures below which two sets of these sizes are no candidates.

    Similar sets differ in at most k members for their own sizes, which leaves
    n1 - k//2 partitions with at most one difference.  Half of that is asked for,
    and at least three, since parts may hold none of the runs that are counted.
    """
    k = ((1 - least) / (1 + least) * (na + nb) + 1e-9).astype(np.int64)
    return np.maximum(_SHARED, (n1 - k // 2 + 1) // 2)


def pairs_of(sig: np.ndarray, num: np.ndarray, n: np.ndarray, inst: np.ndarray, least: float, parts_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, what, signatures shared) of the sets that share signatures, where sizes allow it; in blocks.

    ``what`` holds the instance and the number of signatures needed in it.
    """
    order = np.argsort(sig, kind="stable")
    sig, num, n, inst = sig[order], num[order], n[order].astype(np.int64), inst[order].astype(np.int64)
    at = np.flatnonzero(sig[1:] == sig[:-1])
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, step = 0, 1
    while len(at):
        i, j = at, at + step
        ok = (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9) & (num[i] != num[j])
        a, b = num[i[ok]], num[j[ok]]
        v = inst[i[ok]]
        what = v * _MOST + np.minimum(needed(n[i[ok]], n[j[ok]], parts_of[v], least), _MOST - 1)
        held.append((np.minimum(a, b), np.maximum(a, b), what))
        size += len(a)
        if size > 4_000_000:
            yield _counted(held)
            held, size = [], 0
        step += 1
        at = at[at + step < len(sig)]
        at = at[sig[at] == sig[at + step]]
    if held:
        yield _counted(held)


def _counted(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, b, i = (np.concatenate(v) for v in zip(*held))
    order = np.lexsort((i, b, a))
    a, b, i = a[order], b[order], i[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (i[1:] != i[:-1])
    first = np.flatnonzero(new)
    return a[first], b[first], i[first], np.diff(np.append(first, len(a)))


def candidates(sets: DataFrame, frequent: np.ndarray, p: Params, buckets: int) -> DataFrame:
    """(a, b): numbers of the sets that share enough signatures over the runs that aren't frequent."""
    ends = bands(p.least)
    far = (1 - p.least) / (1 + p.least)
    parts_of = np.array([int(2 * e * far + 1e-9) // 2 + _SHARED for e in ends] + [1])
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2_000):
                b = whole.slice(start, 2_000)
                x, row = _flat(b.column("runs"))
                n = b.column("n").to_numpy().astype(np.int64)
                if len(shared.value):
                    hit = np.minimum(np.searchsorted(shared.value, x), len(shared.value) - 1)
                    rare = shared.value[hit] != x
                    x, row = x[rare], row[rare]
                sig, r, inst = _by_band(x, row, np.searchsorted(ends, n), parts_of)
                num = b.column("num").to_numpy()[r]
                to = (sig % _U(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(buckets + 1))
                rows = [(k, order[cut[k] : cut[k + 1]]) for k in range(buckets) if cut[k + 1] > cut[k]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in rows], pa.int32()),
                        pa.array([_planes(sig[o]) for _, o in rows], pa.binary()),
                        pa.array([_planes(num[o]) for _, o in rows], pa.binary()),
                        pa.array([_planes(n[r[o]].astype(np.uint32)) for _, o in rows], pa.binary()),
                        pa.array([inst[o].astype(np.uint8).tobytes() for _, o in rows], pa.binary()),
                    ],
                    names=["bucket", "sig", "num", "n", "inst"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [b for b in batches if b.num_rows]  # one bucket
        if not blocks:
            return
        cols = []
        for name, dtype in (("sig", np.uint64), ("num", np.int64), ("n", np.uint32), ("inst", np.uint8)):
            cols.append(np.concatenate([_unplanes(x, dtype) for b in blocks for x in b.column(name).to_pylist()]))
        for a, b, i, c in pairs_of(*cols, least=p.least, parts_of=parts_of):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(i, pa.int64()), pa.array(c.astype(np.int32))], names=["a", "b", "what", "c"])

    posted = sets.select("num", "n", "runs").mapInArrow(post, "bucket int, sig binary, num binary, n binary, inst binary")
    met = posted.repartitionById(buckets, "bucket").mapInArrow(meet, "a long, b long, what long, c int")
    counted = met.groupBy("a", "b", "what").agg(F.sum("c").alias("c")).where(F.col("c") >= F.col("what") % _MOST)
    return counted.select("a", "b").distinct()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, row = _flat(b.column("runs"))
        yield pa.RecordBatch.from_arrays([b.column("num").take(pa.array(row)), b.column("n").take(pa.array(row)), pa.array(x.view(np.int64))], names=["num", "n", "run"])


def small_candidates(sets: DataFrame, p: Params) -> DataFrame | None:
    """(a, b): every two sets, one of at most ``exact`` members, that share a run of their prefixes; null if there are none so small."""
    near = materialize(sets.where(F.col("n") <= int(p.exact / p.least + 1e-9)), "small")
    if near.where(F.col("n") <= p.exact).isEmpty():
        return None
    runs = materialize(near.select("num", "n", "runs").mapInArrow(_members, "num long, n int, run long"), "members")
    often = runs.groupBy("run").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    order = W.partitionBy("num").orderBy("often", "run")  # at most exact / least rows
    # runs of one set only come first in the order but meet nothing
    alone = F.col("n") - F.count(F.lit(1)).over(W.partitionBy("num"))
    ranked = runs.join(often, "run").select("num", "n", "run", (F.row_number().over(order) + alone).alias("at"))
    first = materialize(ranked.where(F.col("at") <= F.col("n") - F.ceil(p.least * F.col("n") - 1e-9) + 1).select("num", "n", "run"), "prefixes")
    a, b = first.select("run", F.col("num").alias("a"), F.col("n").alias("na")), first.select("run", F.col("num").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") <= p.exact) & (F.least("na", "nb") >= p.least * F.greatest("na", "nb") - 1e-9)
    return materialize(a.join(b, "run").where(fits).select("a", "b").distinct(), "candidates")


def _by_band(x: np.ndarray, row: np.ndarray, band: np.ndarray, parts_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``signatures`` band by band, so that a few long texts don't widen the grid of all."""
    got = []
    for v in np.unique(band):
        rows = np.flatnonzero(band == v)
        new = np.full(len(band), -1)
        new[rows] = np.arange(len(rows))
        mine = new[row] >= 0
        for at in range(0, len(rows), max(1, 3_000_000 // int(parts_of[v + 1] * _PARTS))):
            to = at + max(1, 3_000_000 // int(parts_of[v + 1] * _PARTS))
            part = mine & (new[row] >= at) & (new[row] < to)
            s, r, i = signatures(x[part], new[row[part]] - at, band[rows[at:to]], parts_of)
            got.append((s, rows[at:to][r], i))
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(v) for v in zip(*got))  # type: ignore[return-value]


# ---------------------------------------------------------------- the whole


@dataclass
class Result:
    """texts (num, id, class): every record; links (a, b, sim): pairs of class numbers."""

    texts: DataFrame
    classes: DataFrame
    links: DataFrame


def _small(rows: DataFrame, p: Params) -> DataFrame:
    """A written table, sent to all executors if it has few rows; else joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= p.sent_rows else rows


def _kept(sets: DataFrame, frequent: np.ndarray, kept: float) -> DataFrame:
    """Sets of which less than ``kept`` is left without the frequent runs."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, row = _flat(b.column("runs"))
            hit = np.minimum(np.searchsorted(shared.value, x), len(shared.value) - 1)
            gone = np.bincount(row[shared.value[hit] == x], minlength=b.num_rows)
            n = b.column("n").to_numpy()
            yield b.filter(pa.array(n - gone < kept * n))

    return sets.mapInArrow(weigh, "num long, n int, runs binary")


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sim = []
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(u) + len(v) - len(np.union1d(u, v))
            sim.append(both / (len(u) + len(v) - both))
        s = np.array(sim)
        ok = pa.array(s >= least - 1e-12) if len(s) else pa.array([], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(s, pa.float64())], names=["a", "b", "sim"]).filter(ok)


def near_copies(records: DataFrame, p: Params = Params()) -> Result:
    """Classes of ``records`` (id, text) with the same set, and all similar pairs of classes."""
    spark = records.sparkSession
    ship(spark)
    read = records.select("id", F.col("text")).mapInArrow(lambda it: _read(it, p), _TEXTS)
    texts = materialize(read.withColumn("num", F.monotonically_increasing_id()), "texts")
    twins = materialize(texts.groupBy("h", "g").agg(F.min("num").alias("class"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "twins")
    if twins.isEmpty():
        named = texts.select("num", "id", F.col("num").alias("class"))
        sets = texts.select("num", "n", "runs")
    else:
        named = texts.select("num", "id", "h", "g").join(_small(twins, p), ["h", "g"], "left").select("num", "id", F.coalesce("class", "num").alias("class"))
        named = materialize(named, "named")
        more = _small(materialize(named.where("num <> class").select("num"), "more"), p)
        sets = materialize(texts.select("num", "n", "runs").join(more, "num", "left_anti"), "sets")
    found = small_candidates(sets, p)
    pool, bound = sets, p.common
    while True:
        size = pool.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("runs")).first()
        if not size.n:
            break
        often = frequent_runs(pool, bound, 1 << max(3, (size.runs // 2_000_000).bit_length())) if bound < size.n else None
        many = often.count() if often is not None else 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size.runs * 2 // 500_000))
        none = np.zeros(0, np.uint64)
        if many <= p.frequent_rows:
            frequent = np.sort(np.array([r.run for r in often.collect()], np.int64).view(np.uint64)) if many else none
            got = materialize(candidates(pool, frequent, p, buckets), "candidates")
            left = _kept(pool, frequent, p.kept) if many else None
        else:
            rare = materialize(rare_only(pool, often), "rare")
            got = materialize(candidates(rare, none, p, buckets), "candidates")
            left = pool.join(rare.where(F.length("runs") >= 8 * p.kept * F.col("n")).select("num"), "num", "left_anti")
        found = got if found is None else found.unionByName(got)
        if left is None:
            break
        left = materialize(left.select("num", "n", "runs"), "tier")
        if pool is not sets:
            release(pool)
        pool, bound = left, bound * p.widen
    if found is None:
        links = spark.createDataFrame([], "a long, b long, sim double")
    else:
        pairs = materialize(found.distinct(), "pairs")

        def side(num: str, runs: str) -> DataFrame:
            needed = _small(materialize(pairs.select(num).distinct(), "needed"), p)
            return sets.select(F.col("num").alias(num), F.col("runs").alias(runs)).join(needed, num, "left_semi")

        both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
        links = materialize(both.mapInArrow(lambda it: _verify(it, p.least), "a long, b long, sim double"), "links")
    return Result(named, sets, links)


def _spread(r: Result, expand: int | None) -> DataFrame:
    """Pairs of ids for classes of up to ``expand`` copies; larger classes are tied by their first copy."""
    if expand is None:
        one, two = (r.texts.select(F.col("class").alias(c), F.col("id").alias(i)) for c, i in (("a", "ia"), ("b", "ib")))
        same = one.join(two.withColumnRenamed("b", "a"), "a").where("ia < ib").select("ia", "ib")
        other = r.links.select("a", "b").join(one, "a").join(two, "b").select("ia", "ib")
        return same.unionByName(other).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()
    counts = r.texts.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("head"))
    member = r.texts.select("class", "id").join(counts, "class")
    shown = member.where((F.col("copies") <= expand) | (F.col("id") == F.col("head")))
    # inside a class
    many = member.where("copies > 1")
    m2 = shown.where("copies > 1").select("class", F.col("id").alias("other"))
    inside = many.join(m2, "class").where("id <> other").select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))
    # between classes: all copies of one with what the other shows, and the other way round
    links = r.links.select("a", "b")
    left, right = member.select(F.col("class").alias("a"), F.col("id").alias("ia"), (F.col("copies") > expand).alias("la")), member.select(F.col("class").alias("b"), F.col("id").alias("ib"), (F.col("copies") > expand).alias("lb"))
    sa, sb = shown.select(F.col("class").alias("a"), F.col("id").alias("ia")), shown.select(F.col("class").alias("b"), F.col("id").alias("ib"))
    one = links.join(left, "a").join(sb, "b").select("ia", "ib")
    two = links.join(right.where("lb"), "b").join(sa, "a").select("ia", "ib")
    between = one.unionByName(two).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    return inside.unionByName(between).distinct()


def similar_pairs(records: DataFrame, p: Params = Params()) -> DataFrame:
    """(id_a, id_b): each pair of records at or above the similarity, id_a < id_b.

    Copies beyond ``p.expand``, if given, are paired with their class's smallest id only;
    ``groups`` names the class of every record.
    """
    return _spread(near_copies(records, p), p.expand)


def groups(records: DataFrame, p: Params = Params()) -> DataFrame:
    """(id, class_id, copies, links): for every record its class, the size of that, and the number of similar classes."""
    r = near_copies(records, p)
    ends = r.links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    sizes = r.texts.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("class_id"))
    return r.texts.join(sizes, "class").join(ends, "class", "left").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))

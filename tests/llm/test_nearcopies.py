"""Near copies against all pairs: edits, copies, common phrases, big clusters, nulls and short texts."""

import random
import re

import numpy as np
from codeloom.llm import nearcopies as nc

SCHEMA = "id string, text string, num string, runs string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


def brute(rows, p):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[a-z0-9_]+", (t or "").lower())
        if len(w) >= max(p.run, p.least_words):
            sets[i] = frozenset(tuple(w[k : k + p.run]) for k in range(len(w) - p.run + 1))
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= p.least * len(sets[a] | sets[b]) - 1e-9}


def corpus(n, seed, phrases=True):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3_000)]
    common = [[rng.choice(vocab) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 9)):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + [rng.choice(vocab)] + w[k:], w[k:] + w[:k]])
        else:
            w = [rng.choice(vocab) for _ in range(rng.randrange(20, 160))]
            if phrases:
                for c in rng.sample(common, 3):
                    k = rng.randrange(len(w))
                    w[k:k] = c
        rows.append((f"d{i:05d}", " ".join(w)))
    return rows


def found(spark, rows, p):
    return {tuple(r) for r in nc.similar_pairs(table(spark, rows), p).select("id_a", "id_b").collect()}


def test_against_all_pairs(spark):
    for p in (nc.Params(least=0.6, run=3, least_words=25), nc.Params(least=0.8, run=5)):
        rows = corpus(700, 4)
        want = brute(rows, p)
        assert len(want) > 80 and found(spark, rows, p) == want


def test_big_cluster_goes_through_the_tiers(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):  # each run is in most of the texts, more than the bound of the first tier
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((f"t{i:03d}", " ".join(w)))
    rows += corpus(100, 2)
    p = nc.Params(least=0.6, run=3, common=16)
    assert found(spark, rows, p) == brute(rows, p)


def test_frequent_runs_do_not_depend_on_the_layout(spark):
    """A run in 64 sets, one to a partition, is found as if they lay together."""
    sets = spark.createDataFrame([(i, 2, bytes(np.array([7, 100 + i], np.uint64))) for i in range(64)], "num long, n int, runs binary")
    for parts in (64, 4, 1):
        got = lambda bound: [r.run for r in nc.frequent_runs(sets.repartition(parts, "num"), bound, 8).collect()]  # noqa: B023, E731
        assert got(63) == [7] and got(64) == [] and sorted(got(0)) == [7, *range(100, 164)]
    high = spark.createDataFrame([(i, 1, bytes(np.array([2**64 - 1], np.uint64))) for i in range(5)], "num long, n int, runs binary")
    assert [r.run for r in nc.frequent_runs(high, 4, 8).collect()] == [-1]


def test_frequent_runs_too_many_to_send_are_joined(spark):
    rows = corpus(300, 6)
    p = nc.Params(least=0.6, run=3, least_words=25, common=6, frequent_rows=0, sent_rows=0)
    want = brute(rows, p)
    assert len(want) > 40 and found(spark, rows, p) == want


def test_recall_just_above_the_threshold(spark):
    """Pairs of texts that share barely six tenths of their runs, many of them frequent ones."""
    rng, rows = random.Random(12), []
    stock = [[rng.choice([f"s{i}" for i in range(50)]) for _ in range(8)] for _ in range(12)]
    for i in range(250):
        w = [f"p{i}x{k}" for k in range(rng.randrange(30, 90))]
        for c in rng.sample(stock, 3):
            w += c
        n, v = len(w) - 2, list(w)
        k = 0
        while True:  # replace words from the front as long as the similarity stays above
            k += 1
            new = [f"q{i}y{j}" for j in range(k)] + w[k:]
            both = {tuple(w[j : j + 3]) for j in range(n)} & {tuple(new[j : j + 3]) for j in range(n)}
            if len(both) < 0.6 * (len({tuple(w[j : j + 3]) for j in range(n)}) + len({tuple(new[j : j + 3]) for j in range(n)}) - len(both)):
                break
            v = new
        rows += [(f"a{i:03d}", " ".join(w)), (f"b{i:03d}", " ".join(v))]
    p = nc.Params(least=0.6, run=3, least_words=25)
    want = brute(rows, p)
    got = found(spark, rows, p)
    assert len(want) >= 250 and got <= want and len(got) / len(want) >= 0.98


def test_copies_nulls_and_short_texts(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [("k1", text), ("k2", text.upper().replace(" ", "\r\n")), ("k3", text), ("n", None), ("e", ""), ("b", "  \n"), ("s", "one two"), ("z", text + " more words here")]
    p = nc.Params(least=0.6, run=3, least_words=25)
    assert found(spark, rows, p) == brute(rows, p) == {(a, b) for a in ("k1", "k2", "k3") for b in ("k2", "k3", "z") if a < b}
    g = {r.id: (r.class_id, r.copies, r.links) for r in nc.groups(table(spark, rows), p).collect()}
    assert g == {"k1": ("k1", 3, 1), "k2": ("k1", 3, 1), "k3": ("k1", 3, 1), "z": ("z", 1, 1)}


def test_many_copies_are_tied_to_the_first(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(f"k{i:03d}", text) for i in range(200)] + [("other", text + " tail")]
    p = nc.Params(least=0.6, run=3, expand=10)
    got = found(spark, rows, p)
    assert got == {("k000", f"k{i:03d}") for i in range(1, 200)} | {(f"k{i:03d}", "other") for i in range(200)}


def test_query_gives_every_pair_of_large_classes(spark):
    from codeloom.llm.queries import CODE

    text = " ".join(f"a{i}" for i in range(40))
    rows = [(f"k{i:03d}", text) for i in range(70)] + [(f"l{i:03d}", text + " tail") for i in range(66)]
    assert found(spark, rows, CODE) == brute(rows, CODE) and len(brute(rows, CODE)) == 136 * 135 // 2


def test_few_distinct_runs(spark):
    rng, rows = random.Random(8), []
    for i in range(150):  # cycles of two or three words and a tail: 2 to 6 distinct runs in 25 words and more
        loop = [f"c{i}x{k}" for k in range(rng.choice([2, 3]))]
        for tail in range(3):
            rows.append((f"r{i:03d}{tail}", " ".join((loop * 20)[:30] + [f"t{i}y{k}" for k in range(tail)])))
    rows += [(f"h{i:03d}", " ".join(["hot"] * 30 + [f"u{i}"])) for i in range(60)]  # all share one run
    p = nc.Params(least=0.6, run=3, least_words=25)
    want = brute(rows, p)
    assert len(want) > 200 and found(spark, rows, p) == want


def test_empty(spark):
    assert nc.similar_pairs(table(spark, []), nc.Params()).count() == 0
    assert nc.groups(table(spark, [("a", None)]), nc.Params()).count() == 0


def test_long_text(spark):
    long = " ".join(f"w{i % 5003}x{i}" for i in range(60_000))
    p = nc.Params()
    assert found(spark, [("a", long), ("b", long + " end"), ("c", "short text of a few words only")], p) == {("a", "b")}


def test_partitions_hold_the_differences():
    """At least n1 - k//2 partitions hold at most one of any k differences."""
    rng = np.random.default_rng(1)
    least, ends = 0.6, nc.bands(0.6)
    far = (1 - least) / (1 + least)
    parts_of = np.array([int(2 * e * far + 1e-9) // 2 + nc._SHARED for e in ends] + [1])
    for _ in range(60):
        size = int(rng.integers(8, 200))
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        k = int(len(a) * 0.24)
        b = np.unique(np.concatenate([a[k:], rng.integers(0, 1 << 62, k).astype(np.uint64)]))
        x, row = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        band = np.searchsorted(ends, np.array([len(a), len(b)]))
        sig, r, inst = nc.signatures(x, row, band, parts_of)
        n = np.array([len(a), len(b)])
        got = list(nc.pairs_of(sig, r.astype(np.int64), n[r], inst, least, parts_of))
        best = max((c / (w % nc._MOST) for _, _, what, count in got for w, c in zip(what, count)), default=0)
        assert best >= 1

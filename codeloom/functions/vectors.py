"""Expressions over array<float> vectors and exact top-k in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.session import materialize, observed, ship


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def usable(a: Column | str, dim: int = 64) -> Column:
    """Of the right length, all finite, not all zero."""
    v = _c(a)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, mean): element-wise mean of each key's vectors.

    By position, so that a key with very many vectors is summed before the
    shuffle and no task gathers them.
    """
    per = rows.select(key, F.posexplode(vector).alias("pos", "v")).groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))  # as many as dimensions
    return per.groupBy(key).agg(F.transform(ordered, lambda x: x["v"]).alias("mean"))


def pack(rows: DataFrame, key: str, vector: str, dim: int, block: int, name: str) -> DataFrame:
    """Vectors in blocks: (``name``_ids, ``name``_raw), one row for up to ``block`` vectors."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                b = whole.slice(at, block)
                v = b.column(1)
                lo, hi = np.asarray(v.offsets)[[0, -1]] if len(v) else (0, 0)
                flat = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float32)[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_pylist()], pa.list_(b.column(0).type)), pa.array([flat.tobytes()], pa.binary())], names=[f"{name}_ids", f"{name}_raw"])

    return rows.where(usable(vector, dim)).select(key, vector).mapInArrow(run, f"{name}_ids array<{kind}>, {name}_raw binary")


_SENT = 64 << 20  # bytes of query vectors that are sent to every executor


def top_k(queries: DataFrame, corpus: DataFrame, k: int, dim: int = 64, block: int = 4_096, cosine: bool = False) -> DataFrame:
    """(query, id, score, rank): for each query (id, embedding) the k vectors of ``corpus`` (id, embedding) by dot product, then id.

    Exact.  Both sides are packed into blocks; each pair of blocks is a matrix
    product that keeps k candidates for each query, so what is shuffled is k rows
    for each query and block of the corpus.  Unusable vectors take no part;
    scores are rounded to nine places before they are ranked.
    """
    spark = queries.sparkSession
    ship(spark)
    kind = queries.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q_type, c_type = (b.column(c).type.value_type for c in ("q_ids", "c_ids"))
            for qi, qr, ci, cr in zip(*(b.column(c).to_pylist() for c in ("q_ids", "q_raw", "c_ids", "c_raw"))):
                q, c = (np.frombuffer(x, np.float32).reshape(-1, dim).astype(np.float64) for x in (qr, cr))
                if cosine:
                    q, c = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, c))
                s = np.round(q @ c.T, 9)
                rank = np.argsort(np.array(ci, dtype=object), kind="stable")  # ties go to the smaller id
                s, names = s[:, rank], [ci[i] for i in rank]
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                n, m = top.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qi[i] for i in range(n) for _ in range(m)], q_type), pa.array([names[j] for j in top.ravel()], c_type), pa.array(np.take_along_axis(s, top, 1).ravel())],
                    names=["query", "id", "score"],
                )

    c = materialize(pack(corpus, "id", "embedding", dim, block, "c"), "blocks")
    q, seen = observed(pack(queries, "id", "embedding", dim, block, "q"), "blocks", size=F.sum(F.length("q_raw")))
    # a stated set of queries against all rows, block by block
    pairs = c.crossJoin(F.broadcast(q) if (seen["size"] or 0) <= _SENT else q)
    best = W.partitionBy("query").orderBy(F.desc("score"), "id")
    found = pairs.mapInArrow(score, f"query {kind}, id {corpus.schema['id'].dataType.simpleString()}, score double")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

"""From source files to the graph: parsing, embedding, call resolution, incremental indexing.

Parsing and embedding run in Arrow batches; everything else is relational.  An
incremental run gives the same tables as a full one: calls are resolved by joins
over all symbols, so links into a changed file survive its change.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.scalar import embed_text, symbol_id
from codeloom.operators.resolve import resolve_cross, resolve_intra
from codeloom.operators.store import unchanged
from codeloom.session import materialize, ship
from codeloom.sources.jscode import js_symbols
from codeloom.sources.pycode import python_symbols
from codeloom.sources.scan import source_files

PARSED = "file string, ordinal int, type string, name string, signature string, docstring string, line_start int, line_end int, calls array<string>"
_LIST = pa.list_(pa.string())


def parse_text(file: str, text: str) -> list[dict]:
    """Symbols of one file, the file itself first."""
    name = file.rstrip("/").rsplit("/", 1)[-1]
    found = python_symbols(text) if name.lower().endswith(".py") else js_symbols(text)
    whole = dict(type="file", name=name, signature=file, docstring="", line_start=1, line_end=text.count("\n") + 1, calls=[])
    return [whole, *found]


def parse_files(files: DataFrame) -> DataFrame:
    """Symbols of files (file, content: bytes or text); null content gives none; bytes that aren't UTF-8 are replaced."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, raw in zip(b.column("file").to_pylist(), b.column("content").to_pylist()):
                if file is None or raw is None:
                    continue
                for i, s in enumerate(parse_text(file, raw.decode("utf-8", "replace"))):
                    rows.append((file, i, s["type"], s["name"], s["signature"], s["docstring"], s["line_start"], s["line_end"], s["calls"]))
            cols = list(zip(*rows)) or [()] * 9
            types = [pa.string(), pa.int32(), *[pa.string()] * 4, pa.int32(), pa.int32(), _LIST]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["file", "ordinal", "type", "name", "signature", "docstring", "line_start", "line_end", "calls"])

    parsed = files.select("file", F.col("content").cast("binary").alias("content")).mapInArrow(run, PARSED)
    return parsed.withColumn("id", symbol_id("file", "type", "name", "line_start"))


def hashed_vector(text: str, dim: int) -> np.ndarray:
    """A unit vector of signed, hashed words and word pairs: the same text gives the same vector everywhere."""
    words = [w.lower() for x in re.findall(r"[A-Za-z]+|\d+", text) for w in re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+", x)]
    v = np.zeros(dim, np.float32)
    for w in (*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))):
        h = zlib.crc32(w.encode())
        v[h % dim] += 1.0 if h >> 31 else -1.0
    n = float(np.linalg.norm(v))
    return v / n if n else v


def embed(rows: DataFrame, text: str, dim: int = 384, name: str = "embedding", model=None) -> DataFrame:
    """``rows`` with a vector for the column ``text``; ``model`` maps a list of texts to an array (n, dim) and is called once for each batch."""
    ship(rows.sparkSession)
    plain = [f for f in rows.schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            m = np.asarray(model(texts), np.float32) if model else np.array([hashed_vector(t, dim) for t in texts], np.float32).reshape(-1, dim)
            ends = np.arange(0, m.size + 1, m.shape[1] if m.size else 1, dtype=np.int32)[: len(texts) + 1]
            vec = pa.ListArray.from_arrays(pa.array(ends), pa.array(m.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in plain), vec], names=[*(f.name for f in plain), name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain)
    return rows.select(*[f.name for f in plain]).mapInArrow(run, f"{schema}, `{name}` array<float>")


@dataclass
class Index:
    """nodes (symbols with vectors), edges (src, dst, relation), hashes (file, hash), and a one-row report."""

    nodes: DataFrame
    edges: DataFrame
    hashes: DataFrame
    report: DataFrame


def call_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst, relation): calls inside and across files."""
    return resolve_intra(nodes).union(resolve_cross(nodes)).distinct().withColumn("relation", F.lit("CALLS"))


def index_files(files: DataFrame, old: Index | None = None, dim: int = 384, purge: bool = True, whole: bool = True) -> Index:
    """Index files (file, content, hash).

    Files whose hash is stored are skipped.  ``whole`` says that ``files`` is the
    complete tree, so that with ``purge`` symbols of files that are gone go too;
    for a part of a tree, null content marks a file that is gone.
    """
    todo = files if old is None else unchanged(files, old.hashes)
    todo = materialize(todo.select("file", "content", "hash"), "todo")
    parsed = parse_files(todo)
    parsed = parsed.withColumn("text", embed_text("type", "name", "signature", "docstring"))
    fresh = embed(parsed, "text", dim).drop("text").withColumn("indexed_at", F.current_timestamp())
    if old is None:
        nodes, hashes = fresh, todo.where("content is not null").select("file", "hash")
    else:
        touched = todo.select("file")
        kept, kept_hashes = old.nodes.join(touched, "file", "left_anti"), old.hashes.join(touched, "file", "left_anti")
        if whole and purge:
            kept, kept_hashes = kept.join(files.select("file"), "file", "left_semi"), kept_hashes.join(files.select("file"), "file", "left_semi")
        nodes = kept.select(*fresh.columns).unionByName(fresh)
        hashes = kept_hashes.select("file", "hash").unionByName(todo.where("content is not null").select("file", "hash"))
    nodes, hashes = materialize(nodes, "nodes"), materialize(hashes, "hashes")
    edges = materialize(call_edges(nodes), "edges")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    report = one(files, "files_total").crossJoin(one(todo, "files_indexed")).crossJoin(one(nodes, "symbols")).crossJoin(one(edges, "edges"))
    return Index(nodes, edges, hashes, report.withColumn("skipped", F.col("files_total") - F.col("files_indexed")))


def index_tree(spark: SparkSession, root: str, old: Index | None = None, **kw) -> Index:
    """Index the source tree below ``root``."""
    return index_files(source_files(spark, root), old, **kw)

"""Scalar functions over symbols, as native column expressions.

``register`` offers them to SQL as temporary SQL functions, which the optimizer
inlines; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def symbol_id(file: Column | str, kind: Column | str, name: Column | str, line_start: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of file::type::name::line; null if a part is null."""
    parts = [_c(file), _c(kind), _c(name), _c(line_start).cast("string")]
    whole = F.concat(parts[0], F.lit("::"), parts[1], F.lit("::"), parts[2], F.lit("::"), parts[3])
    return F.substring(F.sha2(whole, 256), 1, 16)


def token_estimate(text: Column | str) -> Column:
    """A quarter of the characters, rounded down; null counts as empty."""
    return F.floor(F.length(F.coalesce(_c(text), F.lit(""))) / 4).cast("int")


def embed_text(kind: Column | str, name: Column | str, signature: Column | str, docstring: Column | str) -> Column:
    """Signature and docstring joined by a space, as far as there are any; else type and name."""
    sig, doc = F.nullif(_c(signature), F.lit("")), F.nullif(_c(docstring), F.lit(""))
    return F.when(sig.isNull() & doc.isNull(), F.concat_ws(" ", _c(kind), _c(name))).otherwise(F.concat_ws(" ", sig, doc))


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)/*$", 1)


def stem(path: Column | str) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def parent(path: Column | str) -> Column:
    """Path without its last part; ``.`` where there is none."""
    p = _c(path)
    return F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit("."))


def folder(path: Column | str, root: str = "") -> Column:
    """First part below ``root``; ``(root)`` for files in it; outside, the parent's name or ``(unknown)``."""
    p = _c(path)
    base = root.rstrip("/") + "/" if root else ""
    rel = F.substring(p, len(base) + 1, 1 << 30) if base else p
    inside = F.when(rel.contains("/"), F.substring_index(rel, "/", 1)).otherwise(F.lit("(root)"))
    up = F.coalesce(F.nullif(file_name(parent(p)), F.lit("")), F.lit("(unknown)"))
    return F.when(p.startswith(base), inside).otherwise(up) if base else inside


def has_test(file: Column | str, name: Column | str) -> Column:
    """Whether the file's stem or folder mentions ``test``, or the name starts with test_ or Test."""
    f, n = F.coalesce(_c(file), F.lit("")), F.coalesce(_c(name), F.lit(""))
    return F.lower(stem(f)).contains("test") | F.lower(parent(f)).contains("test") | n.startswith("test_") | n.startswith("Test")


#: Words in a file's stem that mark an entry point of a service.
ENTRY_WORDS = ("route", "view", "endpoint", "api", "handler")


def link_types(kind: Column | str, name: Column | str, file: Column | str, signature: Column | str) -> Column:
    """array<struct<link_type, link_key>>: ways in which a symbol can be named from outside, weakest last."""
    n, s = F.coalesce(_c(name), F.lit("")), F.coalesce(_c(signature), F.lit(""))
    low = F.lower(stem(file))
    entry = low.contains(ENTRY_WORDS[0])
    for w in ENTRY_WORDS[1:]:
        entry = entry | low.contains(w)

    def one(when: Column, link: str, key: Column) -> Column:
        return F.when(when, F.struct(F.lit(link).alias("link_type"), key.alias("link_key")))

    all_ = F.array(
        one(entry, "ENDPOINT", F.concat(F.lit("endpoint:"), F.lower(n))),
        one(file_name(file) == "__init__.py", "EXPORT", F.concat(F.lit("export:"), n)),
        one(s.contains("Servicer") | s.contains("grpc"), "GRPC", F.concat(F.lit("grpc:"), n)),
        one(_c(kind).isin("function", "method") & ~n.startswith("_"), "NAME_MATCH", F.concat(F.lit("fn:"), n)),
    )
    return F.filter(all_, lambda x: x.isNotNull())


def link_confidence(link_type: Column | str, src_file: Column | str, dst_file: Column | str) -> Column:
    t = _c(link_type)
    return (
        F.when(t.isin("ENDPOINT", "GRPC", "EXPORT"), F.lit(0.9))
        .when((t == "NAME_MATCH") & (stem(src_file) == stem(dst_file)), F.lit(0.75))
        .when(t == "NAME_MATCH", F.lit(0.6))
        .otherwise(F.lit(0.5))
    )


def serialize_symbol(kind: Column | str, name: Column | str, file: Column | str, line_start: Column | str, line_end: Column | str, signature: Column | str, docstring: Column | str) -> Column:
    """A symbol as context: its place, its signature, and up to 200 characters of its docstring."""
    doc = F.nullif(_c(docstring), F.lit(""))
    cut = F.when(F.length(doc) > 200, F.concat(F.substring(doc, 1, 200), F.lit("..."))).otherwise(doc)
    head = F.concat(F.lit("# "), F.coalesce(_c(file), F.lit("")), F.lit(":"), F.coalesce(_c(line_start).cast("string"), F.lit("")), F.lit("-"), F.coalesce(_c(line_end).cast("string"), F.lit("")))
    sig = F.coalesce(F.nullif(_c(signature), F.lit("")), F.concat_ws(" ", _c(kind), _c(name)))
    return F.concat_ws("\n", head, sig, F.concat(F.lit('  """'), cut, F.lit('"""')))


def map_line(kind: Column | str, name: Column | str, line_start: Column | str, signature: Column | str, docstring: Column | str) -> Column:
    """A symbol's lines in the map of its file."""
    sig = F.coalesce(F.nullif(_c(signature), F.lit("")), F.concat_ws(" ", _c(kind), _c(name)))
    doc = F.substring(F.nullif(_c(docstring), F.lit("")), 1, 100)
    return F.concat_ws("\n", F.concat(F.lit("L"), F.coalesce(_c(line_start).cast("string"), F.lit("?")), F.lit("  "), sig), F.concat(F.lit("      # "), doc))


def risk_level(score: Column | str) -> Column:
    return F.when(_c(score) < 30, "LOW").when(_c(score) < 60, "MEDIUM").otherwise("HIGH")


def drift_severity(score: Column | str) -> Column:
    return F.when(_c(score) < 0.5, "mild").when(_c(score) < 0.7, "moderate").otherwise("severe")


def safe_name(task: Column | str) -> Column:
    """The first 40 characters of a task as a file name; ``query`` if nothing is left."""
    t = F.trim(F.regexp_replace(F.substring(_c(task), 1, 40), r"[^\p{L}\p{N}_\- ]", "_"))
    return F.coalesce(F.nullif(F.replace(t, F.lit(" "), F.lit("_")), F.lit("")), F.lit("query"))


_SQL_FUNCTIONS = """
symbol_id(file STRING, kind STRING, name STRING, line_start INT) RETURNS STRING RETURN substring(sha2(concat(file, '::', kind, '::', name, '::', cast(line_start AS STRING)), 256), 1, 16)
token_estimate(t STRING) RETURNS INT RETURN cast(floor(length(coalesce(t, '')) / 4) AS INT)
file_stem(p STRING) RETURNS STRING RETURN regexp_replace(regexp_extract(p, '([^/]*)/*$', 1), '^(.+)[.][^.]+$', '$1')
vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
vector_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x))
link_confidence(t STRING, a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN t IN ('ENDPOINT', 'GRPC', 'EXPORT') THEN 0.9D WHEN t = 'NAME_MATCH' AND file_stem(a) = file_stem(b) THEN 0.75D WHEN t = 'NAME_MATCH' THEN 0.6D ELSE 0.5D END
has_test(file STRING, name STRING) RETURNS BOOLEAN RETURN contains(lower(file_stem(file)), 'test') OR contains(lower(regexp_replace(file, '[^/]*$', '')), 'test') OR startswith(name, 'test_') OR startswith(name, 'Test')
risk_level(score INT) RETURNS STRING RETURN CASE WHEN score < 30 THEN 'LOW' WHEN score < 60 THEN 'MEDIUM' ELSE 'HIGH' END
"""


def register(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions; returns their names."""
    names = []
    for line in filter(None, _SQL_FUNCTIONS.strip().split("\n")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {line}")
        names.append(line.split("(")[0])
    return names

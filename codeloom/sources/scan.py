"""Source trees as DataFrames of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.scalar import file_name, suffix

#: Suffixes that are read, folders and files that are skipped.
SUFFIXES = (".py", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs")
SKIP_FOLDERS = (".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", ".nuxt", "coverage")
SKIP_FILES = ("d3.min.js", "d3.js")


def wanted(path: Column | str) -> Column:
    """Whether a path is source code outside the skipped folders."""
    p = F.col(path) if isinstance(path, str) else path
    inside = F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(x) for x in SKIP_FOLDERS]))
    return suffix(p).isin(*SUFFIXES) & ~inside & ~file_name(p).isin(*SKIP_FILES)


def relative(path: Column, root: str) -> Column:
    """Path below ``root`` without the scheme of its file system."""
    plain = F.regexp_replace(path, r"^[a-z0-9]+:/*(?=/)", "")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 1 << 30)).otherwise(plain)


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, content, hash): source files below ``root``; hash is the MD5 of the bytes, file the relative path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    f = raw.select(relative(F.col("path"), root).alias("file"), "content")
    return f.where(wanted("file")).select("file", "content", F.md5("content").alias("hash"))

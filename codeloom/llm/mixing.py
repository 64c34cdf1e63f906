"""Mixing sources to target shares of the total size in tokens.

Each document gets a random key from a hash of its id.  Within a source the keys
order the documents; the order is cut into ranges of keys, the ranges' token
counts are summed first, and running sums within a range start from the sum of
the ranges before it.  So no task sees more than one range of a source, however
large the source.  A source's budget is met by whole epochs over all of its
documents and then by the documents before the budget's cut in that order.

The document at the cut is taken if that comes closer to the budget.

Defined results: sources are compared trimmed and without regard to case, and
those without a target give nothing; null and empty texts have no tokens and are
not chosen; a target that is null or not above 0 is none; a source that is named
twice has the sum of its shares and the smaller cap; a source with no tokens
can't reach its share and doesn't bound the total; a null cap counts as 1; if
the total asked for is too large, a source stops at its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.normal import filled, norm_id
from codeloom.llm.tokens import BYTE_BPE_50K, token_counts
from codeloom.session import materialize, observed

_IN_RANGE = 16_384  # documents for which a source has one range of keys


def targets_of(mix_targets: DataFrame) -> DataFrame:
    """(source, share, cap): shares sum to 1."""
    t = (
        mix_targets.where(filled("source") & (F.col("target_share") > 0) & ~F.isnan("target_share"))
        .groupBy(norm_id("source").alias("source"))
        .agg(F.sum("target_share").alias("share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("cap"))
    )
    total = F.sum("share").over(W.partitionBy(F.lit(0)))  # one row a source: a control table
    return t.select("source", (F.col("share") / total).alias("share"), "cap")


def sized(documents: DataFrame, targets: DataFrame, vocabulary: str = BYTE_BPE_50K, size: Column | None = None) -> DataFrame:
    """(doc_id, source, tokens, key, part) of the documents that can be chosen, written once.

    ``size`` counts a text in place of tokens.  The key is the first 60 bits of the
    MD5 of the id; ranges of it, as many as the number of documents asks for, are
    the parts.
    """
    wanted = documents.select("doc_id", norm_id("source").alias("source"), "text").join(targets.select("source"), "source", "left_semi")
    if size is None:
        counted = token_counts(wanted, keep=("source",), vocabulary=vocabulary, check=False).drop("exact")
    else:
        counted = wanted.select("doc_id", "source", F.coalesce(size, F.lit(0)).cast("long").alias("tokens"))
    key = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long")
    docs, seen = observed(counted.where("tokens > 0").withColumn("key", key), "sized", n=F.count(F.lit(1)))
    bits = max(4, (seen["n"] // _IN_RANGE).bit_length())
    return docs.withColumn("part", F.shiftright("key", 60 - bits))


def budgets(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, share, cap, size, budget, epochs, rest) of each target; without a total, the largest that every source can bear."""
    size = docs.groupBy("source").agg(F.sum("tokens").alias("size"))
    t = targets.join(size, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    bear = F.when((F.col("size") > 0) & (F.col("cap") > 0), F.col("size") * F.col("cap") / F.col("share"))
    total = F.lit(total_tokens).cast("double") if total_tokens is not None else F.min(bear).over(W.partitionBy(F.lit(0)))
    most = F.col("size") * F.col("cap")
    t = t.withColumn("budget", F.coalesce(F.least(F.round(total * F.col("share")).cast("long"), most), F.lit(0)))
    epochs = F.when(F.col("size") > 0, F.expr("budget div size")).otherwise(F.lit(0))
    return t.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size"))


def choose(docs: DataFrame, budget: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, times): how often each chosen document is used."""
    sums = docs.groupBy("source", "part").agg(F.sum("tokens").alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("source", "part", before.alias("before"))  # one row for _IN_RANGE documents
    plan = starts.join(budget.select("source", "epochs", "rest"), "source")
    ordered = W.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    run = docs.withColumn("run", F.sum("tokens").over(ordered)).join(plan, ["source", "part"])
    end = F.col("before") + F.col("run")
    start = end - F.col("tokens")
    more = (start < F.col("rest")) & ((end <= F.col("rest")) | (end - F.col("rest") < F.col("rest") - start))
    times = (F.col("epochs") + more.cast("long")).cast("int")
    return run.select("doc_id", "source", "tokens", times.alias("times")).where("times > 0")


def mix(documents: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, vocabulary: str = BYTE_BPE_50K, size: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, report): the documents of the mix and the shares they reach; ``size`` measures texts in place of tokens."""
    t = materialize(targets_of(mix_targets), "targets")
    docs = sized(documents, t, vocabulary, size)
    b = materialize(budgets(docs, t, total_tokens), "budgets")
    chosen = choose(docs, b)
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("times").alias("most_times"))
    report = b.join(got, "source", "left").na.fill(0, ["tokens", "documents", "most_times"])
    share = F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(W.partitionBy(F.lit(0)))), F.lit(0.0))
    return chosen, report.select("source", F.round("share", 6).alias("target_share"), F.round(share, 6).alias("actual_share"), F.col("cap").alias("max_repeats"), "size", "budget", "tokens", "documents", "most_times")

"""Mixing sources to target weights by hash thresholds (problem 7).

Tokens are summed per source and hash bucket. A source's budget is some whole copies of all its documents plus the
documents whose hash lies under a threshold; the threshold's bits are found bucket by bucket, each level reading only the
documents of one boundary bucket. The mix itself is a filter: nothing is sorted.

Defined cases: NULL or blank text has no tokens and is in no mix; a NULL source takes part in no target; source names are
compared without case and outer blanks; a target whose source has no documents is reported with 0; equal target rows are
one target; a NULL cap counts as 1, a NULL share or budget as 0; documents with the same id share their fate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veclore.llm.sampling import random_key
from veclore.runtime import broadcast_if_small, written

LEVEL_BITS = 12
LEVELS = 3
TARGET = ["plan_id", "source"]


def source_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def space_tokens(text: Column) -> Column:
    """Number of runs of non-white-space characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0)).cast("bigint")


#: The pattern that splits a text before the merges of the public rank files; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a rank file at most: it goes to every executor.
MAX_VOCABULARY = 32 << 20


def public_tokens(spark: SparkSession, vocabulary: str, pattern: str = PATTERN):
    """A column function: tokens of a public byte-level BPE whose ranks lie in the file ``vocabulary`` (base64 bytes and rank a
    line). The driver reads the file and broadcasts its bytes; executors need no copy of it. NULL and empty texts have none."""
    with open(vocabulary, "rb") as f:
        held = f.read(MAX_VOCABULARY + 1)
    if len(held) > MAX_VOCABULARY:
        raise ValueError(f"{vocabulary} has more than {MAX_VOCABULARY} bytes")
    sent = spark.sparkContext.broadcast(held)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        coder = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield texts.map(lambda t: len(coder.encode_ordinary(t)) if isinstance(t, str) else 0).astype("int64")

    return count


def source_sizes(documents: DataFrame, tokens: Column, seed: int) -> DataFrame:
    """(id, key, src, tokens) of the documents that count, written once: texts are read and tokenised a single time, every
    later step reads these narrow rows."""
    sized = documents.select(F.col("doc_id").alias("id"), source_key(F.col("source")).alias("src"), tokens.alias("tokens"))
    return written(sized.where("src is not null and tokens > 0").withColumn("key", random_key(F.col("id"), seed)), "sizes")


def mix_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: tokens there are, wanted and reachable, whole copies, and the hash threshold of the last partial copy.

    ``sizes``: id, src, tokens, key. ``targets``: plan_id, source, target_share, max_repeats, budget_tokens.
    """
    wanted = (F.coalesce("target_share", F.lit(0.0)) * F.coalesce("budget_tokens", F.lit(0))).alias("wanted")
    asked = targets.select(*TARGET, source_key(F.col("source")).alias("src"), wanted, F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).distinct()
    buckets = written(sizes.groupBy("src", F.shiftright("key", 63 - LEVEL_BITS).alias("bucket")).agg(F.sum("tokens").alias("tokens")), "mix")
    there = buckets.groupBy("src").agg(F.sum("tokens").alias("there"))
    plan = asked.join(there, "src", "left").withColumn("there", F.coalesce("there", F.lit(0)))
    reach = F.least(F.col("wanted"), (F.col("there") * F.col("max_repeats")).cast("double"))
    plan = plan.withColumn("reach", reach).withColumn("copies", F.when(F.col("there") > 0, F.floor(F.col("reach") / F.col("there"))).otherwise(0).cast("bigint"))
    plan = plan.withColumn("rest", F.col("reach") - F.col("copies") * F.col("there")).withColumn("threshold", F.lit(0).cast("bigint"))
    plan = written(plan, "mix")
    for level in range(LEVELS):
        shift = 63 - LEVEL_BITS * (level + 1)
        if level == 0:
            counts = plan.select(*TARGET, "src").join(buckets, "src")
        else:  # only the documents of each target's boundary bucket
            edges = broadcast_if_small(plan.where("rest > 0").select(*TARGET, "src", "threshold"))
            part = sizes.join(edges, "src").where(F.shiftright("key", shift + LEVEL_BITS) == F.shiftright("threshold", shift + LEVEL_BITS))
            counts = part.groupBy(*TARGET, "src", F.shiftright("key", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        order = Window.partitionBy(*TARGET, "src").orderBy("bucket")
        counts = counts.withColumn("upto", F.sum("tokens").over(order))
        under = plan.select(*TARGET, "rest").join(counts, TARGET).where("upto <= rest")
        under = under.groupBy(*TARGET).agg(F.max("bucket").alias("bucket"), F.max("upto").alias("taken"))
        # the threshold moves past the last whole bucket; what is left of the budget goes one level down, into the next bucket
        nearest = plan.select(*TARGET, "rest").join(counts, TARGET).where("upto > rest").groupBy(*TARGET).agg(F.min("bucket").alias("edge"))
        plan = plan.join(under, TARGET, "left").join(nearest, TARGET, "left")
        edge = F.coalesce(F.col("edge"), F.col("bucket") + 1, F.shiftright("threshold", shift))
        plan = plan.withColumn("threshold", F.shiftleft(edge, shift)).withColumn("rest", F.col("rest") - F.coalesce("taken", F.lit(0)))
        plan = written(plan.drop("bucket", "taken", "edge"), "mix")
    return plan


def mixed(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(plan_id, source, id, tokens, repeats): the documents of each target and how often they come."""
    chosen = sizes.join(broadcast_if_small(plan.select(*TARGET, "src", "copies", "threshold")), "src")
    repeats = F.col("copies") + (F.col("key") < F.col("threshold")).cast("bigint")
    return chosen.select(*TARGET, "id", "tokens", repeats.alias("repeats")).where("repeats > 0")


def mix_report(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: tokens wanted, the most its documents can give (``reachable``), tokens in the mix and their actual share of it."""
    plan = mix_plan(sizes, targets)
    given = mixed(sizes, plan).groupBy(*TARGET).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("given"))
    rows = plan.join(given, TARGET, "left").withColumn("given", F.coalesce("given", F.lit(0)))
    whole = F.sum("given").over(Window.partitionBy("plan_id"))
    return rows.select(*TARGET, "wanted", (F.col("there") * F.col("max_repeats")).alias("reachable"), "given", F.round(F.col("given") / F.nullif(whole, F.lit(0)), 6).alias("actual_share"))

"""Documents combined so that each source contributes a target share of all tokens.

Every document gets a hash-random key. A source's documents are range-partitioned by key into fixed buckets; token sums per bucket
give prefix sums over the buckets, so the place where the source's budget ends is known up to one bucket; that bucket is divided once more in the
same way, and only the documents of one part in BUCKETS x BUCKETS are put in order. A budget beyond the source's own tokens repeats all of them in full passes, up to the allowed number,
and takes the rest of the budget from the start of the order. Token counts are exact and made once.

Only sums per (source, bucket) are gathered, twice: sources x BUCKETS rows, whatever the number of documents.

Defined results: documents without source, or of a source without target, are not taken but count in the total; of several targets of a
source the least holds; a source without documents reaches 0; NULL texts have 0 tokens; rows may repeat and count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.tokens import TOKENIZERS, VOCABULARY, count_tokens
from lakewright.session import stage

BUCKET_BITS = 12
#: Targets (one row per source) up to which they are broadcast; a longer table is refused.
MAX_TARGETS = 100_000


def counted(documents: DataFrame, *, seed: int = 0, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, key, bucket, fine), written once and read by all later steps."""
    tokens = count_tokens("text", folder, vocabulary).alias("n_tokens")
    rows = documents.select("doc_id", "source", tokens, F.xxhash64(F.lit(seed), "doc_id", "source", F.xxhash64("text")).alias("key"))
    fine = F.shiftrightunsigned(F.shiftleft("key", BUCKET_BITS), 64 - BUCKET_BITS)
    return stage(rows.withColumn("bucket", F.shiftrightunsigned("key", 64 - BUCKET_BITS)).withColumn("fine", fine), "mix-tokens")


def plan(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: budget, full passes, and where the last pass ends (cut bucket, part of it, tokens left for that part)."""
    if targets.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    wanted = targets.where("source is not null").groupBy("source").agg(F.min(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("most"))).alias("t"))
    sums = stage(rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")), "mix-sums")
    total = F.broadcast(sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")))  # one row
    own = sums.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum("documents").alias("documents"))
    planned = wanted.join(own, "source", "left").join(total).select(
        "source", F.col("t.share").alias("target_share"), F.col("t.most").alias("max_repeats"), "total",
        F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.floor(F.col("t.share") * F.col("total") + F.lit(1e-6)).alias("budget"),
    )
    whole = F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available")), F.col("max_repeats").cast("bigint"))).otherwise(F.lit(0))
    planned = planned.withColumn("passes", whole)
    planned = planned.withColumn("rest", F.when(F.col("passes") < F.col("max_repeats"), F.col("budget") - F.col("passes") * F.col("available")).otherwise(F.lit(0)))
    prefix = _prefix(sums, "bucket").join(F.broadcast(planned.select("source", "rest")), "source")
    ends = prefix.where("upto > rest").groupBy("source").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))).alias("end"))
    ends = stage(ends.select("source", F.col("end.bucket").alias("cut"), F.col("end.left").alias("rest")), "mix-ends")
    edge = rows.join(F.broadcast(ends), "source").where("bucket = cut")
    parts = _prefix(edge.groupBy("source", "fine", "rest").agg(F.sum("n_tokens").alias("tokens")), "fine", "rest")
    inner = parts.where("upto > rest").groupBy("source").agg(F.min(F.struct("fine", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))).alias("end"))
    none = F.lit(1 << BUCKET_BITS).cast("bigint")
    planned = planned.join(ends.select("source", "cut"), "source", "left").join(inner, "source", "left")
    return planned.select(*(c for c in planned.columns if c not in ("cut", "end")), F.coalesce("cut", none).alias("cut"), F.coalesce("end.fine", none).alias("fine_cut"), F.coalesce("end.left", F.lit(0)).alias("left"))


def _prefix(sums: DataFrame, bucket: str, *more: str) -> DataFrame:
    """Tokens up to and with each bucket of a source; one row per bucket."""
    upto = Window.partitionBy("source").orderBy(bucket)
    return sums.select("source", bucket, *more, F.sum("tokens").over(upto).alias("upto"), "tokens")


def mixture(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents that are taken; copies counts the passes that hold the document."""
    joined = rows.join(F.broadcast(planned.select("source", "passes", "cut", "fine_cut", "left")), "source")
    before = (F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & (F.col("fine") < F.col("fine_cut")))
    on_edge = (F.col("bucket") == F.col("cut")) & (F.col("fine") == F.col("fine_cut"))
    inside = joined.where(~on_edge).withColumn("copies", F.col("passes") + F.when(before, 1).otherwise(0))
    so_far = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = joined.where(on_edge).withColumn("copies", F.col("passes") + F.when(F.sum("n_tokens").over(so_far) <= F.col("left"), 1).otherwise(0))
    return inside.unionByName(edge).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(taken: DataFrame, planned: DataFrame) -> DataFrame:
    """Report per source: share wanted and reached, tokens available and reached, passes."""
    reached = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached"), F.max("copies").alias("most"))
    ratio = F.when(F.col("total") > 0, F.col("reached_tokens") / F.col("total")).otherwise(F.lit(0.0))
    return planned.join(reached, "source", "left").select(
        "source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), F.col("budget").alias("target_tokens"),
        F.coalesce("reached", F.lit(0)).alias("reached_tokens"), F.coalesce("most", F.lit(0)).alias("repeats"), "total",
    ).withColumn("reached_share", ratio).withColumn("short", F.col("target_tokens") - F.col("reached_tokens")).drop("total")

"""Past incidents like a new failure: exact by signature, similar by weighted parts, nearest by vector."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.functions.distance import similarity_column
from lakewright.operators.failures import canonical_type, family

# Weights of the parts and limits of the search.
WEIGHTS = {"failure_type": 0.25, "column": 0.25, "table": 0.15, "value": 0.35}
THRESHOLD, TOP_K = 0.85, 3

#: Queries that are sent to all workers at a time.
BLOCK = 10_000

#: Failures and incidents whose overlaps are in memory at a time.
CHUNK = 2_000


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 1 for two empty sets."""
    x, y = (F.coalesce(c, F.array().cast("array<string>")) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def in_blocks(queries: DataFrame, key: str, size: int) -> list[DataFrame]:
    """A query set cut by hash into blocks of about ``size`` rows, each small enough to be sent to all workers."""
    n = max(1, -(-queries.count() // size))
    block = F.pmod(F.xxhash64(key), F.lit(n))
    return [F.broadcast(queries.where(block == b)) for b in range(n)]


def similar(failures: DataFrame, incidents: DataFrame, *, k: int = TOP_K) -> DataFrame:
    """The k most similar incidents of each failure, itself left out, with the score (4 decimals) and whether that reaches the threshold.

    Both have signature_id, failure_type, column_name, table_name, layer, raw_value, one row per signature, and where there are
    schema failures expected_only and source_only. Only incidents of the same column are scored: others lose the column's share and
    can't reach the threshold. Values compare as texts, once per pair of texts, the failures sent to the incidents block by block;
    schema failures compare by the mean Jaccard of expected_only and of source_only.
    """
    failures, incidents = _with_sets(failures), _with_sets(incidents)
    schema = F.coalesce(family(F.col("failure_type")) == "SCHEMA", F.lit(False))
    texts = [_scored(block, incidents) for block in in_blocks(failures.where(~schema), "signature_id", BLOCK)]
    scored = reduce(DataFrame.unionByName, [*texts, _scored_sets(failures.where(schema), incidents, k)])
    best = Window.partitionBy("signature_id").orderBy(F.col("score").desc(), "incident_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.withColumn("reaches", F.col("score") >= THRESHOLD)


def _with_sets(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    return rows.withColumns({c: none for c in ("expected_only", "source_only") if c not in rows.columns})


def _scored(failures: DataFrame, incidents: DataFrame) -> DataFrame:
    f, i = failures.alias("f"), incidents.alias("i")
    pairs = f.join(i, F.col("f.column_name").eqNullSafe(F.col("i.column_name")) & (F.col("f.signature_id") != F.col("i.signature_id")))
    kinds = canonical_type(F.col("f.failure_type")) == canonical_type(F.col("i.failure_type"))
    kin = (family(F.col("f.failure_type")) == family(F.col("i.failure_type"))) & (family(F.col("f.failure_type")) != "UNKNOWN")
    table = F.when(F.col("f.table_name") == F.col("i.table_name"), 1.0).when(F.col("f.layer") == F.col("i.layer"), 0.7).otherwise(0.0)
    pairs = pairs.withColumn("value", similarity_column(F.col("f.raw_value"), F.col("i.raw_value")))
    score = WEIGHTS["failure_type"] * F.when(kinds, 1.0).when(kin, 0.5).otherwise(0.0) + WEIGHTS["column"] + WEIGHTS["table"] * table + WEIGHTS["value"] * F.col("value")
    return pairs.select(F.col("f.signature_id").alias("signature_id"), F.col("i.signature_id").alias("incident_id"), F.round(score, 4).alias("score"))


def _scored_sets(failures: DataFrame, incidents: DataFrame, k: int) -> DataFrame:
    """Schema failures by their column sets. Every pair of a chunk of failures and a chunk of incidents is one table of overlaps,
    of which only the k best of each failure are passed on."""
    chunks = lambda df: max(1, -(-df.count() // CHUNK))
    n, m = chunks(failures), chunks(incidents)
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    at = lambda size: F.pmod(F.xxhash64("signature_id"), F.lit(size)).cast("int")
    form = ("signature_id", canonical_type(F.col("failure_type")).alias("kind"), family(F.col("failure_type")).alias("family"), "column_name", "table_name", "layer", "expected_only", "source_only")
    f = failures.select(*form, at(n).alias("_f")).withColumn("_i", every(m)).groupBy("_f", "_i")
    i = incidents.select(*form, at(m).alias("_i")).withColumn("_f", every(n)).groupBy("_f", "_i")
    return f.cogroup(i).applyInPandas(_best_of_chunks(k), "signature_id string, incident_id string, score double")


def _best_of_chunks(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def equal(a: pd.Series, b: pd.Series, nulls: bool = False) -> np.ndarray:
        codes, _ = pd.factorize(pd.concat([a, b], ignore_index=True))
        x, y = codes[: len(a), None], codes[None, len(a) :]
        return (x == y) & (nulls | (x >= 0))

    def jaccards(a: pd.Series, b: pd.Series) -> np.ndarray:
        """Jaccard of every pair. An empty set counts as one of a sign of its own: equal to another empty set, apart from all others."""
        sets = [set(() if x is None else x) or {""} for x in [*a, *b]]
        place = {c: n for n, c in enumerate(sorted(set().union(*sets)))}
        there = np.zeros((len(sets), len(place)), dtype=np.float32)
        for row, names in enumerate(sets):
            there[row, [place[c] for c in names]] = 1
        x, y = there[: len(a)], there[len(a) :]
        common = (x @ y.T).astype(np.float64)
        return common / (x.sum(1)[:, None] + y.sum(1)[None, :] - common)

    def best(f: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if f.empty or i.empty:
            return pd.DataFrame({"signature_id": [], "incident_id": [], "score": []}, dtype=object)
        i = i.sort_values("signature_id", ignore_index=True)
        kind = np.where(equal(f.kind, i.kind), 1.0, np.where(equal(f.family, i.family), 0.5, 0.0))
        table = np.where(equal(f.table_name, i.table_name), 1.0, np.where(equal(f.layer, i.layer), 0.7, 0.0))
        value = (jaccards(f.expected_only, i.expected_only) + jaccards(f.source_only, i.source_only)) / 2
        score = WEIGHTS["failure_type"] * kind + WEIGHTS["column"] + WEIGHTS["table"] * table + WEIGHTS["value"] * value
        score = np.floor(score * 10_000 + 0.5 + 1e-6).astype(np.int64)  # half up, as round() of a column
        rank = np.where(equal(f.column_name, i.column_name, nulls=True) & ~equal(f.signature_id, i.signature_id), score * len(i) + np.arange(len(i))[::-1], -1)
        top = np.argpartition(-rank, min(k, len(i)) - 1, axis=1)[:, :k]
        rows = np.repeat(np.arange(len(f)), top.shape[1])
        keep = rank[rows, top.ravel()] >= 0
        rows, top = rows[keep], top.ravel()[keep]
        ids = lambda column, at: pd.Series(column.to_numpy(dtype=object)[at], dtype=object)
        return pd.DataFrame({"signature_id": ids(f.signature_id, rows), "incident_id": ids(i.signature_id, top), "score": score[rows, top] / 10_000})

    return best


def cosine(a: Column, b: Column) -> Column:
    """(1 + cosine) / 2 of two vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return (1 + dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))) / 2


def nearest(vectors: DataFrame, queries: DataFrame, *, vec_id: str, vector: str, k: int) -> DataFrame:
    """The k nearest vectors of each query by cosine, itself left out. Queries are a stated set, sent to all rows block by block.

    The rank limit is applied before the shuffle: each task passes on at most k rows per query.
    """
    blocks = in_blocks(queries.select(F.col(vec_id).alias("query_id"), F.col(vector).alias("_q")), "query_id", BLOCK)
    one = lambda q: vectors.join(q, F.col(vec_id) != F.col("query_id")).select("query_id", vec_id, F.round(cosine(F.col(vector), F.col("_q")), 6).alias("score"))
    pairs = reduce(DataFrame.unionByName, map(one, blocks))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), vec_id)
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


# -- reuse of past fixes

BY_HAND = ("MANUAL", "DISMISS")


def exact_hits(incidents: DataFrame) -> DataFrame:
    """(table_name, column_name, signature, incident_id, fixes, borrowed): of verified successes per exact signature the newest, those that weren't borrowed first, and the distinct fixes.

    incidents: incident_id, table_name, column_name, raw_value, action, action_params, outcome, verified, borrowed, resolved_at.
    """
    rows = incidents.where("verified and outcome = 'SUCCESS'").withColumn("signature", F.upper(F.trim("raw_value")))
    keys = ["table_name", "column_name", "signature"]
    fix = F.concat_ws(" ", "action", "action_params")
    best = F.max_by(F.struct("incident_id", "action", "action_params", F.coalesce("borrowed", F.lit(False)).alias("borrowed")), F.struct(~F.coalesce("borrowed", F.lit(False)), "resolved_at", "incident_id"))
    agg = rows.groupBy(*keys).agg(best.alias("b"), F.count_distinct(fix).alias("fixes"))
    return agg.select(*keys, "b.*", "fixes")


def decide(failures: DataFrame, candidates: DataFrame, incidents: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(signature_id, incident_id, score, matched_by, reusable, reason): whether a past fix may be used again for each failure.

    failures: signature_id, failure_type, table_name, column_name, raw_value, trusted; candidates: similar()'s (signature_id, incident_id, score);
    incidents as in exact_hits(), where other outcomes than SUCCESS are attempts that failed. An exact signature scores 1. A fix made by hand, one of several
    that disagree, one that failed before for the same signature, and for a merely similar value any fix, are not used again; nor is any for an untrusted failure.
    """
    schema = F.coalesce(family(F.col("failure_type")) == "SCHEMA", F.lit(False))
    own = failures.withColumn("signature", F.upper(F.trim("raw_value")))
    same = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("table_name", "column_name", "signature")))
    exact = own.alias("f").join(exact_hits(incidents).alias("x"), same("f", "x")).select("f.signature_id", "x.incident_id", F.lit(1.0).alias("score"), F.lit("EXACT").alias("matched_by"), "x.fixes")
    known = incidents.where("verified and outcome = 'SUCCESS'").select("incident_id").distinct()
    others = candidates.join(known, "incident_id", "left_semi").select("signature_id", "incident_id", "score", F.lit("STRUCTURED").alias("matched_by"), F.lit(1).cast("bigint").alias("fixes"))
    rank = Window.partitionBy("signature_id").orderBy(F.col("score").desc(), F.col("matched_by"), "incident_id")
    best = exact.unionByName(others).withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")
    told = incidents.select("incident_id", "action", "action_params", F.col("column_name").alias("i_column"), F.col("raw_value").alias("i_value")).dropDuplicates(["incident_id"])
    failed = incidents.where("coalesce(outcome, '') <> 'SUCCESS'").select("table_name", "column_name", F.upper(F.trim("raw_value")).alias("signature"), "action", "action_params").distinct().withColumn("_failed", F.lit(True))
    rows = own.join(best, "signature_id", "left").join(told, "incident_id", "left")
    on = same("r", "a") & F.col("r.action").eqNullSafe(F.col("a.action")) & F.col("r.action_params").eqNullSafe(F.col("a.action_params"))
    rows = rows.alias("r").join(failed.alias("a"), on, "left").select("r.*", "a._failed")
    plain = lambda c: F.regexp_replace(F.upper(F.trim(c)), r"[^A-Z0-9]+", " ")
    is_exact = F.col("matched_by") == "EXACT"
    alike = (F.col("column_name").eqNullSafe(F.col("i_column"))) & (plain("raw_value") == plain("i_value"))
    against = (
        F.when(F.col("action").isin(*BY_HAND), "fixed by hand").when(is_exact & (F.col("fixes") > 1), "past fixes disagree").when(F.col("_failed"), "this fix failed before")
        .when(~is_exact & schema & (F.col("score") < 1.0), "different column sets").when(~is_exact & ~schema & ~alike, "similar value only")
    )
    reason = (
        F.when(~F.coalesce("trusted", F.lit(False)), "classification needs review").when(F.col("incident_id").isNull(), "no verified incident")
        .when(F.col("score") < threshold, "below threshold").when(against.isNotNull(), against).when(is_exact, "exact signature").otherwise("same after normalisation")
    )
    return rows.withColumn("reason", reason).select("signature_id", "incident_id", "score", "matched_by", F.col("reason").isin("exact signature", "same after normalisation").alias("reusable"), "reason")

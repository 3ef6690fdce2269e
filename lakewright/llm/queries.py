"""Queries of the text problems. What SQL can't express has none and is tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.llm import canon, contamination, mixing, splitting
from lakewright.llm.tokens import count_tokens
from lakewright.session import stage
from lakewright.sources.tables import table

FIELDS = ["weather_condition", "crash_month"]


def p3_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Every value that the reference list doesn't hold as it is, with what it means."""
    found = canon.canonicalise(table(spark, d, "silver1_crashes"), table(spark, d, "ref_canonical_mappings"), FIELDS)
    return found.where("not known")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_mapped(spark, d).select("record_id", "field_name", "canonical_value").distinct()


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Report of the values that mean none, or no single one, by frequency."""
    missed = p3_mapped(spark, d).where(F.col("canonical_value") == canon.UNMATCHED)
    return missed.groupBy("field_name", F.upper(F.trim("value")).alias("value")).agg(F.count("*").alias("records"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "benchmark_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans to remove from each document that leaks."""
    spans = contamination.removal_spans(_leaks(spark, d))
    return spans.select("doc_id", F.inline("spans"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that leaked, with the number of documents that hold them."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mixture and how often each is taken."""
    rows = mixing.counted(table(spark, d, "documents"))
    return mixing.mixture(rows, mixing.plan(rows, table(spark, d, "mix_targets")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares wanted and reached."""
    rows = mixing.counted(table(spark, d, "documents"))
    planned = mixing.plan(rows, table(spark, d, "mix_targets"))
    return mixing.shares(mixing.mixture(rows, planned), planned)


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the documents above the limit."""
    return splitting.pieces(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents above the limit: those that the operator splits."""
    return splitting.pieces(table(spark, d, "documents"), with_text=False).select("doc_id").distinct()


#: The last line of a piece is a heading.
_HEADING_LAST = r"(?:^|[\r\n]) {0,3}#{1,6}[ \t][^\r\n]*\s*$"


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the pieces, counted over all of them: every number should be 0."""
    documents = table(spark, d, "documents")
    rows = stage(splitting.pieces(documents), "p9-pieces")
    order = Window.partitionBy("doc_id").orderBy("piece")  # the pieces of one document
    rows = rows.withColumn("before", F.lag("end").over(order)).withColumn("after", F.lead("start").over(order))
    rows = rows.join(documents.select("doc_id", F.col("text").alias("whole")), "doc_id")
    rows = rows.withColumn("counted", count_tokens("text")).withColumn("shared", count_tokens(F.expr("substring(text, 1, body_start - start)")))
    first, last = F.col("before").isNull(), F.col("after").isNull()
    faults = {
        "heading at the end": ~last & F.col("text").rlike(_HEADING_LAST),
        "more tokens than the limit": (F.col("counted") > splitting.LIMIT) | (F.col("counted") != F.col("n_tokens")),
        "overlap missing or too large": ~first & ~F.col("shared").between(1, splitting.OVERLAP + splitting.SLACK),
        "texts that don't rejoin": F.expr("text <> substring(whole, start + 1, end - start)") | (F.coalesce("before", F.lit(0)) != F.col("body_start")) | (last & (F.col("end") != F.char_length("whole"))),
    }
    counts = rows.agg(*(F.count(F.when(wrong, 1)).alias(name) for name, wrong in faults.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(name).alias("fault"), F.col(f"`{name}`").alias("pieces")) for name in faults))))


def queries() -> dict:
    return {
        "p3_found": p3_found, "p3_mapped": p3_mapped, "p3_unmatched": p3_unmatched, "p7_found": p7_found, "p7_spans": p7_spans, "p7_items": p7_items,
        "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_pieces": p9_pieces, "p9_checks": p9_checks,
    }


_LEAKS = r"""
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS s FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT item_id, list_transform(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda x: x <> ''), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')) AS ws FROM benchmark_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 13), lambda k: array_to_string(ws[k:k + 14], ''))) AS phrase FROM w),
f AS (SELECT DISTINCT doc_id, item_id FROM d JOIN p ON contains(d.s, p.phrase) WHERE phrase <> '')
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": _LEAKS + "SELECT doc_id, item_id FROM f",
        "p7_items": _LEAKS + "SELECT item_id, count(DISTINCT doc_id) AS documents FROM f GROUP BY item_id",
        "p9_checks": "SELECT unnest(['heading at the end', 'more tokens than the limit', 'overlap missing or too large', 'texts that don''t rejoin']) AS fault, CAST(0 AS BIGINT) AS pieces",
    }

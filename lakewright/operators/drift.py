"""Records whose fields are added, renamed, removed or retyped from batch to batch, read into one table, with every change listed.

A file here is a (table_name, batch_id). Headers (the keys of a record with the types of their values) are read in parallel from
the records and folded per file: equal headers collapse before the shuffle, so what is shuffled follows the number of distinct
headers, not of records. Types fold through a promotion lattice per column, keys are resolved to columns, every record is cast to the union
schema (the wanted columns and all added ones, each with its promoted type), and the differences are logged in order.

Key resolution, in this order: the column itself; another case, spacing or punctuation; a technical prefix or suffix taken off;
the words in reverse; each word shortened; a synonym if some are given; and, for keys that are left, evidence: a column that is absent
whenever the key is there, if the key's values look like the column's (see ``learn_synonyms``).

Defined results: text that is no JSON object, or has a payload that is no object, or lacks table_name or batch_id, takes no part;
JSON null is a present key without type; rows repeat without effect; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from types import MappingProxyType

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.functions.barrier import hold
from lakewright.session import small, stage
from lakewright.sources.envelopes import fields, looks_like_object, parsed, text_field
from lakewright.vocab import CRASH_COLUMNS

# Words that feeds put before or after a name.
PREFIXES = ("src", "source", "raw", "orig", "original", "new", "old", "in", "fld", "col")
SUFFIXES = ("txt", "text", "str", "string", "val", "value", "raw", "new", "old", "orig", "desc", "cd", "code")

#: Rows up to which a small side (keys, headers) is broadcast; beyond it the join is by shuffle.
BROADCAST_ROWS = 200_000
#: Keys up to which their values are picked out of the records by a list in the plan; beyond it by a join.
LISTED_KEYS = 1_000
#: Added keys that get a column of their own; those beyond it, in order of name, go to the map ``more_fields``.
ADDED_COLUMNS = 500
#: Evidence. Files in which a key must stand for the column if the shapes of its values are all there is.
EVIDENCE_FILES = 3
#: Share of a key's values whose shape must occur in the column, and common part of the two distributions of shapes.
EVIDENCE_SHARE, EVIDENCE_SHAPES = 0.9, 0.3
#: With fewer files, or several columns to choose from: records of the key, different values it shares with the column, common part of the distributions
#: of values, and how many times that must exceed the next column's.
EVIDENCE_RECORDS, EVIDENCE_VALUES, EVIDENCE_OVERLAP, EVIDENCE_LEAD = 10, 3, 0.3, 2.0

# The lattice, from the least type up: what two types have in common is the least type above both.
LATTICE = ("void", "boolean", "number", "string", "array", "object", "variant")


def words(key: str) -> tuple[str, ...]:
    """Lower-case words of a name in any spelling."""
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", key)
    split = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", split)
    return tuple(w.lower() for w in re.split(r"[\W_]+", split) if w)


def resolve_key(key: str, columns: Iterable[str] = CRASH_COLUMNS, synonyms: Mapping[str, str] = MappingProxyType({})) -> str | None:
    """The column that ``key`` names, or None if there is none or more than one."""
    by_words = {tuple(c.split("_")): c for c in columns}
    if key in by_words.values():
        return key
    said = words(key)
    if not said:
        return None
    squeezed = {"".join(k): c for k, c in by_words.items()}

    def exact(w: tuple[str, ...]) -> str | None:
        return by_words.get(w) or squeezed.get("".join(w))

    cores = [said]
    if len(said) > 1 and said[0] in PREFIXES:
        cores.append(said[1:])
    for core in list(cores):
        if len(core) > 1 and (core[-1] in SUFFIXES or re.fullmatch(r"v\d+", core[-1])):
            cores.append(core[:-1])
        if len(core) > 1 and core[-1] in ("flag", "ind", "indicator", "yn"):
            cores.append((*core[:-1], "i"))
            cores.append(core[:-1])
    for core in cores:
        if found := exact(core) or exact(core[::-1]):
            return found
    for core in cores:
        if found := synonyms.get("_".join(core)):
            return found
    for core in cores:
        for order in (core, core[::-1]):
            near = [c for k, c in by_words.items() if len(k) == len(order) and all(_shortened(a, b) for a, b in zip(order, k, strict=True))]
            if len(near) == 1:
                return near[0]
    return None


def _shortened(said: str, word: str) -> bool:
    """Whether ``said`` is the word or a beginning of it, of four letters or nearly all of it."""
    return said == word or (word.startswith(said) and (len(said) >= 4 or len(said) >= max(2, len(word) - 1)))


def promote(a: str, b: str) -> str:
    """Join of two types in the lattice: void is least, numbers and booleans meet in string, arrays and objects in variant."""
    if a == b or b == "void":
        return a
    if a == "void":
        return b
    return "string" if {a, b} <= {"boolean", "number", "string"} else "variant"


def promoted(kinds: Column) -> Column:
    """``promote`` folded over an array of types."""
    scalar = F.array(*(F.lit(x) for x in ("boolean", "number", "string")))
    rest = F.array_distinct(F.array_remove(kinds, "void"))
    return (
        F.when(F.size(rest) == 0, F.lit("void")).when(F.size(rest) == 1, rest[0])
        .when(F.size(F.array_except(rest, scalar)) == 0, F.lit("string")).otherwise(F.lit("variant"))
    )


# JSON types by the first letters of a variant's schema; whatever else there is, is a number.
_KINDS = {"ST": "string", "BO": "boolean", "VO": "void", "OB": "object", "AR": "array"}


def kind(letters: Column) -> Column:
    """JSON type by the first two letters of a variant's schema."""
    named = F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair))
    return F.coalesce(F.try_element_at(named, letters), F.lit("number"))


def envelopes(df: DataFrame, raw: str = "raw_value") -> DataFrame:
    """(table_name, batch_id, record_id, ingestion_ts, fields) of the readable envelopes; fields is map<string,variant>."""
    read = parsed(df.select(raw), raw)
    named = hold(read, *(text_field("envelope", c).alias(c) for c in ("table_name", "batch_id", "record_id", "ingestion_ts")))
    named = named.withColumn("batch_id", F.col("batch_id").try_cast("bigint")).where("table_name is not null and batch_id is not null")
    return fields(named).select("table_name", "batch_id", "record_id", "ingestion_ts", "fields")


def headers(df: DataFrame, raw: str = "raw_value") -> DataFrame:
    """(table_name, batch_id, header, records): the distinct headers of each file. header is an array<struct<key, kind>> in order of keys."""
    short = F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("key"), F.substring(F.schema_of_variant(e["value"]), 1, 2).alias("kind")))
    rows = hold(envelopes(df, raw).select("table_name", "batch_id", "fields"), short.alias("header")).drop("fields")
    merged = rows.groupBy("table_name", "batch_id", "header").agg(F.count("*").alias("records"))
    return merged.withColumn("header", F.transform("header", lambda h: F.struct(h["key"].alias("key"), kind(h["kind"]).alias("kind"))))


def dictionary(keys: DataFrame, learned: DataFrame | None = None, synonyms: Mapping[str, str] = MappingProxyType({})) -> DataFrame:
    """(key, column) of the distinct keys, one row each; column is NULL for keys that name none.

    learned: (key, column) for keys that no rule resolves. Keys are resolved on the workers, each once.
    """
    known = dict(synonyms)

    @F.pandas_udf("string")
    def resolve(texts: pd.Series) -> pd.Series:
        return texts.map(lambda key: resolve_key(key, synonyms=known))

    found = keys.select("key").where("key is not null").distinct().withColumn("column", resolve.asNondeterministic()("key"))
    if learned is not None:
        found = found.join(learned.select("key", F.col("column").alias("_learned")), "key", "left").select("key", F.coalesce("column", "_learned").alias("column"))
    return stage(found, "drift-names")


def _beside(df: DataFrame) -> DataFrame:
    """``df`` as the small side of a join: broadcast up to a checked size."""
    return F.broadcast(df) if small(df, BROADCAST_ROWS) else df


def _shape(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\d+", "9"), r"\p{L}+", "A"), r"\s+", " ")


def learn_synonyms(df: DataFrame, heads: DataFrame, names: DataFrame, raw: str = "raw_value") -> DataFrame:
    """(key, column) for keys that ``names`` leaves open, by evidence. ``heads`` should be a scan; the records are only read if there are candidates.

    A candidate is a column that is absent from every header that holds the key. It is taken if the key's values have the column's
    shapes and, by themselves, it is the only candidate in at least three files; or else if the distributions of the values themselves agree,
    clearly more than with any other candidate.
    """
    spark = heads.sparkSession
    nothing = spark.createDataFrame([], "key string, column string")
    unknown = names.where("column is null").select("key")
    if unknown.isEmpty():
        return nothing
    flat = heads.select("table_name", "batch_id", F.transform("header", lambda h: h["key"]).alias("keys"))
    ids = flat.withColumn("h", F.xxhash64("table_name", "batch_id", "keys"))
    long = ids.select("h", "table_name", "batch_id", F.explode("keys").alias("key"))
    at = long.join(_beside(unknown), "key").select("h", "table_name", "batch_id", "key")
    present = long.join(F.broadcast(at.select("h").distinct()) if small(at, BROADCAST_ROWS) else at.select("h").distinct(), "h", "left_semi").join(_beside(names.where("column is not null")), "key")
    present = present.groupBy("h").agg(F.collect_set("column").alias("present"))
    every = F.array(*(F.lit(c) for c in CRASH_COLUMNS))
    both = at.join(present, "h", "left").select("key", "h", F.explode(F.array_except(every, F.coalesce("present", F.array().cast("array<string>")))).alias("column"))
    total = at.groupBy("key").agg(F.count_distinct("h").alias("n"), F.count_distinct("table_name", "batch_id").alias("files"))
    pairs = both.groupBy("key", "column").agg(F.count_distinct("h").alias("m")).join(total, "key").where("m = n").select("key", "column", "files")
    pairs = stage(pairs, "drift-pairs")
    wanted = pairs.select("key").union(pairs.select(F.col("column").alias("key"))).distinct()
    if pairs.isEmpty():
        return nothing
    if small(wanted, LISTED_KEYS):
        values = _listed_values(df, raw, sorted(r.key for r in wanted.collect()))
    else:
        long = envelopes(df, raw).select(F.explode("fields").alias("key", "v")).join(_beside(wanted), "key", "left_semi")
        values = long.select("key", F.expr("try_variant_get(v, '$', 'string')").alias("text"))
    text = F.upper(F.regexp_replace(F.trim("text"), r"\s+", " "))
    values = values.select("key", text.alias("value")).where("value <> ''").groupBy("key", "value").agg(F.count("*").alias("n"))
    values = stage(values.withColumn("shape", _shape(F.col("value"))), "drift-values")
    by_value = _agreement(values.select("key", F.col("value").alias("x"), "n"), pairs)
    by_shape = _agreement(values.select("key", F.col("shape").alias("x"), "n"), pairs)
    scored = pairs.join(by_value.select("key", "column", F.col("common").alias("same_values"), F.col("overlap").alias("value_overlap"), "records"), ["key", "column"])
    scored = scored.join(by_shape.select("key", "column", "share", F.col("overlap").alias("shape_overlap")), ["key", "column"])
    fit = scored.where((F.col("share") >= EVIDENCE_SHARE) & (F.col("shape_overlap") >= EVIDENCE_SHAPES))
    rank = Window.partitionBy("key").orderBy(F.col("value_overlap").desc(), "column")  # at most one row per wanted column
    fit = fit.withColumn("next", F.coalesce(F.lead("value_overlap").over(rank), F.lit(0.0))).withColumn("place", F.row_number().over(rank)).withColumn("choices", F.count("*").over(Window.partitionBy("key")))
    alone = (F.col("choices") == 1) & (F.col("files") >= EVIDENCE_FILES)
    alike = (F.col("value_overlap") >= EVIDENCE_OVERLAP) & (F.col("same_values") >= EVIDENCE_VALUES) & (F.col("records") >= EVIDENCE_RECORDS) & (F.col("value_overlap") >= EVIDENCE_LEAD * F.col("next"))
    return stage(fit.where((F.col("place") == 1) & (alone | alike)).select("key", "column"), "drift-learned")


def _listed_values(df: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """(key, text) of some keys in every record: a reader that is told the keys skips all others, which costs less than reading whole records."""
    texts = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    read = F.from_json(raw, T.StructType([T.StructField("payload", texts), *(f for f in texts.fields if f.name != "payload")]))
    rows = hold(df.where(looks_like_object(raw)).select(raw), read.alias("_read"))
    field = lambda k: F.when(F.col("_read.payload").isNotNull(), F.col("_read.payload")[k]).otherwise(F.col("_read")[k] if k != "payload" else F.lit(None).cast("string"))
    return rows.select(F.inline(F.array(*(F.struct(F.lit(k).alias("key"), field(k).alias("text")) for k in keys)))).where("text is not null")


def _agreement(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of (key, x, n): per pair the records of the key, the different x both have, the share of the key's records with such an x, and the common part of the distributions."""
    total = counts.groupBy("key").agg(F.sum("n").alias("total"))
    parts = counts.groupBy("key", "x").agg(F.sum("n").alias("n")).join(_beside(total), "key").withColumn("p", F.col("n") / F.col("total"))
    left = parts.join(_beside(pairs), "key").select("key", "column", "x", "p", "n", "total")
    right = parts.select(F.col("key").alias("column"), "x", F.col("p").alias("q"))
    joined = left.join(right, ["column", "x"], "left").groupBy("key", "column")
    shared = F.col("q").isNotNull()
    return joined.agg(
        F.max("total").alias("records"), F.count(F.when(shared, 1)).alias("common"), F.sum(F.when(shared, F.col("p")).otherwise(0.0)).alias("share"),
        F.sum(F.when(shared, F.least("p", "q")).otherwise(0.0)).alias("overlap"),
    )


def read_headers(df: DataFrame, raw: str = "raw_value", synonyms: Mapping[str, str] = MappingProxyType({})) -> tuple[DataFrame, DataFrame]:
    """The staged headers of the files, each with a number h, and the (key, column) dictionary of their keys."""
    heads = stage(headers(df, raw).withColumn("h", F.monotonically_increasing_id()), "drift-headers")
    keys = heads.select(F.explode("header.key").alias("key"))
    names = dictionary(keys, synonyms=synonyms)
    learned = learn_synonyms(df, heads, names, raw)
    return heads, names if learned.isEmpty() else dictionary(keys, learned, synonyms)


def _changes(files: DataFrame, names: DataFrame) -> DataFrame:
    """files: (table_name, batch_id, header, h), h numbers the headers -> changes, one row per change of a file."""
    long = files.select("table_name", "batch_id", "h", F.explode("header").alias("f")).select("table_name", "batch_id", "h", "f.*")
    long = long.join(_beside(names), "key", "left")
    change = lambda rows, kind, field, seen: rows.select("table_name", "batch_id", F.lit(kind).alias("change_kind"), field.alias("field_name"), seen.alias("seen_as"))
    column, key = F.col("column"), F.col("key")
    renamed = change(long.where("column is not null and column <> key"), "renamed", column, key)
    added = change(long.where("column is null"), "added", key, F.lit(""))
    retyped = change(long.where("column is not null and kind not in ('string', 'void')"), "retyped", column, F.col("kind"))
    every = F.array(*(F.lit(c) for c in CRASH_COLUMNS))
    present = long.groupBy("table_name", "batch_id", "h").agg(F.collect_set("column").alias("present"))
    missing = present.select("table_name", "batch_id", F.explode(F.array_except(every, "present")).alias("field_name"))
    removed = change(missing, "removed", F.col("field_name"), F.lit(""))
    return renamed.unionByName(added).unionByName(retyped).unionByName(removed).distinct()


def changes(df: DataFrame, raw: str = "raw_value", synonyms: Mapping[str, str] = MappingProxyType({})) -> tuple[DataFrame, DataFrame]:
    """Changes of the files in ``df`` and the (key, column) dictionary that was used."""
    heads, names = read_headers(df, raw, synonyms)
    return _changes(heads, names), names


def logged(changes: DataFrame) -> DataFrame:
    """Changes in order, numbered per source from 1: by batch, then kind, field and name. No source is put in order as a whole: files are numbered, and changes within a file."""
    rows = stage(changes.distinct(), "drift-changes")
    sizes = rows.groupBy("table_name", "batch_id").agg(F.count("*").alias("size"))
    before = Window.partitionBy("table_name").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = sizes.select("table_name", "batch_id", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("table_name", "batch_id").orderBy("change_kind", "field_name", "seen_as"))
    numbered = rows.withColumn("within", within).join(_beside(offsets), ["table_name", "batch_id"])
    return numbered.select("table_name", (F.col("offset") + F.col("within")).alias("seq"), "batch_id", "change_kind", "field_name", "seen_as")


def reported_changes(failures: DataFrame, names: DataFrame) -> DataFrame:
    """Changes from reports that list the columns that were missing (expected_only) and the keys that came instead (source_only)."""
    rows = failures.where("failure_type = 'SCHEMA_MISMATCH'").select(
        F.col("folder").alias("table_name"), F.col("batch_id").try_cast("bigint").alias("batch_id"),
        F.coalesce("expected_only", F.array().cast("array<string>")).alias("missing"), F.coalesce("source_only", F.array().cast("array<string>")).alias("extra"),
    ).where("table_name is not null and batch_id is not null")
    rows = rows.distinct()
    keys = dictionary(rows.select(F.explode("extra").alias("key")), names.where("column is not null"))
    long = rows.select("table_name", "batch_id", "missing", F.explode_outer("extra").alias("key")).join(_beside(keys), "key", "left")
    pair = lambda d, change, field, seen: d.select("table_name", "batch_id", F.lit(change).alias("change_kind"), field.alias("field_name"), seen.alias("seen_as"))
    renamed = pair(long.where("column is not null and column <> key"), "renamed", F.col("column"), F.col("key"))
    added = pair(long.where("key is not null and column is null"), "added", F.col("key"), F.lit(""))
    instead = long.groupBy("table_name", "batch_id", "missing").agg(F.collect_set("column").alias("found"))
    gone = instead.select("table_name", "batch_id", F.explode(F.array_except("missing", "found")).alias("field_name"))
    removed = pair(gone.where(F.col("field_name").isin(*CRASH_COLUMNS)), "removed", F.col("field_name"), F.lit(""))
    return renamed.unionByName(added).unionByName(removed).distinct()


#: Spark types of the lattice's types; arrays, objects and mixtures are JSON text.
CASTS = {"number": "double", "boolean": "boolean"}
META = ("record_id", "batch_id", "table_name", "ingestion_ts")


def added_name(key: str) -> str:
    """Column of an added key: its words, so that spellings of one name share a column."""
    name = "_".join(words(key)) or "unnamed"
    return f"added_{name}" if name in CRASH_COLUMNS or name in (*META, "more_fields") else name


def _added(key: str) -> Column:
    @F.pandas_udf("string")
    def named(keys: pd.Series) -> pd.Series:
        return keys.map(added_name)

    return named(key)


def union_schema(heads: DataFrame, names: DataFrame) -> DataFrame:
    """(field_name, wanted, kinds, promoted) of the union schema: the wanted columns and the added ones with the types of all files folded through the lattice."""
    named = names.select("key", "column").withColumn("field_name", F.coalesce("column", _added("key")))
    long = heads.select(F.explode("header").alias("f")).select("f.key", "f.kind").distinct()
    folded = long.join(_beside(named), "key").groupBy("field_name").agg(F.max(F.col("column").isNotNull()).alias("wanted"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return folded.withColumn("promoted", promoted(F.col("kinds")))


def unified(df: DataFrame, heads: DataFrame, names: DataFrame, raw: str = "raw_value") -> DataFrame:
    """Every readable record in the union schema: the wanted columns, then the added ones by name, each cast to its promoted type.

    A column delivered under several names takes the first present one in the order: own name, then names in order. Where each column lies
    is found once per header; a record only looks its header up. ``heads`` are the headers of ``df`` (read_headers).
    """
    schema = stage(union_schema(heads, names), "drift-schema")
    kinds = {r.field_name: r.promoted for r in schema.where("wanted").collect()}
    added = schema.where("not wanted").orderBy("field_name").limit(ADDED_COLUMNS).collect()
    extra, kinds = [r.field_name for r in added], kinds | {r.field_name: r.promoted for r in added}
    order = [*CRASH_COLUMNS, *extra]
    place = F.create_map(*(F.lit(x) for k, c in enumerate(order) for x in (c, k)))
    keys = heads.select(F.transform("header", lambda h: h["key"]).alias("keys")).distinct()
    named = names.select("key", F.coalesce("column", _added("key")).alias("field_name"))
    at = keys.select("keys", F.posexplode("keys").alias("pos", "key")).join(_beside(named), "key")
    first = at.groupBy("keys", "field_name").agg(F.min(F.struct(F.col("key") != F.col("field_name"), "key", "pos")).alias("f"))
    spot = F.try_element_at(place, F.col("field_name"))
    found = first.groupBy("keys").agg(F.map_from_entries(F.collect_list(F.when(spot.isNotNull(), F.struct(spot, "f.pos")))).alias("spots"), F.collect_list(F.when(spot.isNull(), F.col("f.pos"))).alias("rest"))
    lies = found.select("keys", F.xxhash64("keys").alias("h"), F.transform(F.sequence(F.lit(0), F.lit(len(order) - 1)), lambda k: F.coalesce(F.try_element_at("spots", k) + 1, F.lit(0))).alias("lies"), "rest")
    lies = stage(lies, "drift-places")
    rows = hold(envelopes(df, raw), F.map_keys("fields").alias("keys"), F.map_values("fields").alias("vals")).drop("fields").withColumn("h", F.xxhash64("keys"))
    rows = rows.join(_beside(lies), ["h", "keys"])
    value = lambda k, c: F.expr(f"try_variant_get(if(lies[{k}] = 0, null, vals[lies[{k}] - 1]), '$', '{CASTS.get(kinds.get(c, 'string'), 'string')}')").alias(c)
    more = F.map_from_entries(F.transform("rest", lambda i: F.struct(F.element_at("keys", i + 1), F.element_at("vals", i + 1)))).cast("map<string,string>").alias("more_fields")
    return rows.select(*META, *(value(k, c) for k, c in enumerate(order)), more)


def column_types(df: DataFrame, raw: str = "raw_value") -> DataFrame:
    """(table_name, field_name, kinds, promoted): the types of each column over a source's files, folded through the lattice."""
    heads, names = read_headers(df, raw)
    long = heads.select("table_name", F.explode("header").alias("f")).select("table_name", "f.key", "f.kind").distinct()
    folded = long.join(_beside(names), "key").where("column is not null").groupBy("table_name", "column").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return folded.select("table_name", F.col("column").alias("field_name"), "kinds", promoted(F.col("kinds")).alias("promoted"))

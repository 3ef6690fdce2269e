"""CSV records that fail to parse, set apart with the reason, while the valid ones are loaded.

Workers write the records of a batch into CSV files, each with its number in front, and let DuckDB read them with reject
tables. Rejected lines are joined back to the records by that number and give the class; what was loaded is cast to the columns'
types in the same pass, and the typed outputs of all files are consolidated. A record that opens a quote and never closes it would swallow its
successors; so each record with a quote is followed by a fence, a line that is a row of its own unless a quote is open: then the fence
closes it, and the rejected line holds it. Records that still came out neither loaded nor rejected, and those around them, are read again
from files of their own.

The reader is laxer than RFC 4180 about quotes within unquoted fields and blanks around quoted ones, so records with a quote that it accepts,
or rejects for their number of columns, are checked against the grammar. A typed column accepts signs and exponents, so
the form of the text is checked beside the cast.

error_class is the first that applies of BROKEN_QUOTING, WRONG_COLUMN_COUNT and INVALID_VALUE, else NULL.

Defined results: NULL text stays with error_class NULL and no fields, for there is no record in it; empty text is one empty field and thus
WRONG_COLUMN_COUNT; a line end after the record is no part of it; line breaks elsewhere belong to their field; rows may repeat; other
columns pass through.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.vocab import CRASH_COLUMNS, WHOLE_NUMBER_COLUMNS

if TYPE_CHECKING:
    import duckdb

BROKEN, COUNT, VALUE = "BROKEN_QUOTING", "WRONG_COLUMN_COUNT", "INVALID_VALUE"

#: Records and characters per file given to the CSV reader; they bound the worker's memory, not the result.
RECORDS_PER_FILE, CHARACTERS_PER_FILE = 5_000, 32_000_000
#: Files of single records read in one call.
SINGLE_FILES = 500

#: Types of the columns that hold no free text, with the least and greatest value.
TYPES = dict.fromkeys(WHOLE_NUMBER_COLUMNS, ("BIGINT", None, None)) | {
    "crash_hour": ("BIGINT", None, 23), "num_units": ("DOUBLE", 0, None), "latitude": ("DOUBLE", -90, 90), "longitude": ("DOUBLE", -180, 180), "crash_date": ("DATE", None, None),
}
FORMS = {"BIGINT": "[0-9]+", "DOUBLE": "[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)", "DATE": "[0-9]{4}-[0-9]{2}-[0-9]{2}"}
TYPED = tuple(c for c in CRASH_COLUMNS if c in TYPES)
_SPARK = {"BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "DATE": T.DateType()}

#: Possessive, so that a record is read once from left to right however long it is.
_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'
RECORD = re.compile(rf"{_FIELD}(?:,{_FIELD})*", re.DOTALL)
#: The longest line end at the end of the text is no part of the record.
LINE_END = re.compile(r"(?:\r\n|\n|\r)\Z")


def well_quoted(record: str) -> bool:
    """Whether every quote opens or closes a field or is doubled within one."""
    return '"' not in record or RECORD.fullmatch(record) is not None


class CsvReader:
    """DuckDB's reader for records of the given columns; one per worker task."""

    def __init__(self, names: Sequence[str] = CRASH_COLUMNS, *, fields: bool = True):
        import duckdb

        self.names, self.fields = list(names), fields
        self.db: duckdb.DuckDBPyConnection = duckdb.connect()
        self.db.execute("set threads = 1")
        self.columns = {f"c{i}": "VARCHAR" for i in range(len(self.names) + 1)}

    def read(self, texts: Sequence[str]) -> pa.Table:
        """(error_class, bad_column, fields, typed) of each record, in their order."""
        db, everything = self.db, "\n".join(texts)
        self.token = uuid.uuid4().hex[:10]
        while self.token in everything:
            self.token = uuid.uuid4().hex[:10]
        self.marks = self._marks(everything)
        for char, mark in self.marks.items():
            texts = [t.replace(char, mark) for t in texts]
        db.execute("create or replace temp table outcome (n INTEGER, broken BOOLEAN, loaded BOOLEAN, bad_column VARCHAR, fields VARCHAR[], typed " + self._typed_kind() + ")")
        with tempfile.TemporaryDirectory() as folder:  # the reader takes files; gone after the batch
            self._load(folder, texts, [list(range(len(texts)))])
            again = sorted(self._doubtful(len(texts)))
            db.execute("delete from outcome where n in (select unnest(?))", [again])
            for start in range(0, len(again), SINGLE_FILES):
                self._load(folder, texts, [[i] for i in again[start : start + SINGLE_FILES]])
        told = dict(db.execute("select n, broken from outcome").fetchall())
        # an open quote to the end of the record's own file leaves no trace: broken
        wrong = [i for i, t in enumerate(texts) if i not in told or (not told[i] and not well_quoted(t))]
        return db.sql(
            "select case when w.n is not null or o.broken then ? when not o.loaded then ? when o.bad_column is not null then ? end as error_class, "
            "case when w.n is null then o.bad_column end as bad_column, case when w.n is null then o.fields end as fields, case when w.n is null then o.typed end as typed "
            "from range(?) r(n) left join outcome o on o.n = r.n left join (select unnest(?::INTEGER[]) as n) w on w.n = r.n order by r.n",
            params=[BROKEN, COUNT, VALUE, len(texts), wrong],
        ).to_arrow_table()

    def _marks(self, everything: str) -> dict[str, str]:
        """Stand-ins, not used in the texts, for characters that would end a line in the file."""
        free = (chr(k) for k in range(0xE000, 0x110000) if not 0xF900 <= k < 0xF0000 and chr(k) not in everything)
        return {char: next(free) for char in "\r\n\0" if char == "\n" or char in everything}

    def _typed_kind(self) -> str:
        return "STRUCT(" + ", ".join(f"{c} {TYPES[c][0]}" for c in self.names if c in TYPES) + ")" if any(c in TYPES for c in self.names) else "BOOLEAN"

    def _load(self, folder: str, texts: Sequence[str], groups: list[list[int]]) -> None:
        """Read groups of records, a file each, and add what was loaded and what was rejected to the outcome."""
        db, paths, fence = self.db, [], f'{self.token}F"{"," * len(self.names)}\n' if len(groups) == 1 else ""
        for k, group in enumerate(groups):
            paths.append(os.path.join(folder, f"{k}.csv"))
            with open(paths[-1], "w", newline="", encoding="utf-8", errors="surrogatepass") as f:
                f.writelines(f"{self.token}{i},{texts[i]}\n{fence if chr(34) in texts[i] else ''}" for i in group)
        # room for the longest file of single records, or for many lines of a large one; a buffer is allocated per file
        line = 4 * max((len(texts[i]) for group in groups for i in group), default=0) + 256
        buffer = 2 * line if len(groups) > 1 else max(2 * line, 8_000_000)
        db.execute("drop table if exists reject_errors; drop table if exists reject_scans")
        scan = (
            f"read_csv(?, header = false, auto_detect = false, delim = ',', quote = '\"', escape = '\"', new_line = '\\n', strict_mode = true, null_padding = false, "
            f"store_rejects = true, rejects_limit = 0, parallel = false, max_line_size = {line}, buffer_size = {buffer}, nullstr = '{self.token}', columns = {self.columns})"
        )
        number = f"try_cast(substr(c0, {len(self.token) + 1}) as INTEGER)"
        trimmed = lambda c: f"regexp_replace(c{self.names.index(c) + 1}, '^\\s+|\\s+$', '', 'g')"
        typed = {c: f"try_cast({trimmed(c)} as {TYPES[c][0]})" for c in self.names if c in TYPES}
        wrong = " ".join(f"when {self._bad(c, trimmed(c), typed[c])} then '{c}'" for c in typed)
        values = "struct_pack(" + ", ".join(f"{c} := {v}" for c, v in typed.items()) + ")" if typed else "NULL"
        fields = "[" + ", ".join(self._text(f"c{i + 1}") for i in range(len(self.names))) + "]" if self.fields else "NULL"
        bad = f"case {wrong} end" if wrong else "NULL"
        db.execute(f"insert into outcome select {number}, false, true, {bad}, {fields}, {values if self.fields else 'NULL'} from {scan} where starts_with(c0, '{self.token}') and {number} is not null", [paths])
        db.execute(
            f"insert into outcome select n, bool_or(broken), false, NULL, NULL, NULL from (select try_cast(regexp_extract(csv_line, '^{self.token}([0-9]+),', 1) as INTEGER) as n, "
            f"error_type = 'UNQUOTED VALUE' or contains(csv_line, '{self.token}F\"') as broken from reject_errors) "
            "where n is not null and n not in (select n from outcome) group by n"
        )
        for path in paths:
            os.remove(path)

    def _text(self, column: str) -> str:
        for char, mark in self.marks.items():
            column = f"replace({column}, '{mark}', chr({ord(char)}))"
        return f"coalesce({column}, '')"

    @staticmethod
    def _bad(column: str, text: str, value: str) -> str:
        """SQL condition that a non-blank text is no value of its column's type."""
        kind, least, most = TYPES[column]
        rules = [f"regexp_full_match({text}, '{FORMS[kind]}')"]
        if kind == "DATE":
            rules.append(f"{value} is not null")
        if least is not None:
            rules.append(f"{value} >= {least}")
        if most is not None:
            rules.append(f"{value} <= {most}")
        return f"{text} <> '' and not coalesce({' and '.join(rules)}, false)"

    def _doubtful(self, count: int) -> set[int]:
        """Records that came out neither loaded nor rejected, and the one before each, which may have hidden it."""
        told = dict(self.db.execute("select n, broken from outcome").fetchall())
        found, last = set(), None
        for i in range(count):
            if i in told:
                last = i
            else:
                found |= {i} if last is None else {i, last}
        return found


def _slices(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if k + 1 - start >= RECORDS_PER_FILE or size >= CHARACTERS_PER_FILE:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def classify(df: DataFrame, raw: str = "raw_value", *, fields: bool = True, names: Sequence[str] = CRASH_COLUMNS) -> DataFrame:
    """Adds error_class and bad_column (of an INVALID_VALUE); replaces an old error_class.

    With ``fields`` also the texts of the record's fields and the values of the typed columns (struct ``typed``, NULL where a text is no value).
    """
    names = tuple(names)
    rows = df.drop("error_class", "bad_column", "fields", "typed")
    kinds = T.StructType([T.StructField(c, _SPARK[TYPES[c][0]]) for c in names if c in TYPES])
    more = [T.StructField("error_class", T.StringType()), T.StructField("bad_column", T.StringType())]
    more += [T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("typed", kinds if kinds.fields else T.BooleanType())] if fields else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = CsvReader(names, fields=fields)
        for batch in batches:
            everything = batch.column(batch.schema.names.index(raw)).to_pylist()
            for start, end in _slices(everything):
                texts = everything[start:end]
                done = reader.read([LINE_END.sub("", t) for t in texts if t is not None])
                at = iter(range(len(texts)))
                where = pa.array([next(at) if t is not None else None for t in texts], pa.int64())
                found = pa.Table.from_batches([batch.slice(start, end - start)])
                for f in more:
                    found = found.append_column(f.name, done.column(f.name).combine_chunks().take(where) if done.num_rows else pa.nulls(len(texts), done.schema.field(f.name).type))
                yield from found.combine_chunks().to_batches()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more]))


def loaded(classified: DataFrame, keep: Sequence[str] = ("record_id",)) -> DataFrame:
    """The good records in their columns as texts; blanks are NULL."""
    good = classified.where("error_class is null and fields is not null")
    text = lambda i: F.nullif(F.trim(F.col("fields")[i]), F.lit(""))
    return good.select(*keep, *(text(i).alias(c) for i, c in enumerate(CRASH_COLUMNS)))


def typed(classified: DataFrame, keep: Sequence[str] = ("record_id",)) -> DataFrame:
    """The typed columns of the good records as the reader's casts gave them; NULL where blank."""
    good = classified.where("error_class is null and typed is not null")
    return good.select(*keep, *(F.col(f"typed.{c}").alias(c) for c in TYPED))

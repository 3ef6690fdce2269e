"""Free-entered values mapped to the canonical value they mean, and the unmatched reported.

The entries of a field form one trie whose paths are their spellings: canonical values, accepted synonyms, and alias paths (translations, phrases) from a table
that the user may extend. A value is searched with a Levenshtein automaton that walks the trie: its state is a row of edit
distances, a branch is left when the whole row exceeds the bound, and all entries within the entry's length-dependent distance
come back. A swap of neighbours is one edit. The value is mapped if the nearest entries mean one canonical value.

A value is freed of decoration (brackets, codes, repeated halves, spaced letters) before it is searched, so that its edits are spent on its letters. What
no entry is near to may be the number of a month, an abbreviation of exactly one canonical value, or a description: every one of its words must then
either be an entry of the field's second trie, of words, and all these mean one value, or be a word that only says how or when (``MODIFIERS``). One other
word leaves it unmatched: SNOW PLOW is no weather.

Reference entries are a list whose size is checked; it goes to the workers once. Each distinct value is searched once per worker.

Defined results: NULL is no case; blank and unmatched values, and values that mean more than one canonical value, are UNMATCHED;
of several rows of one spelling that with the latest added_at holds (ties: the greatest canonical value); rows may repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.aliases import MODIFIERS, PHRASES, ROMAN, WORD_PAIRS, WORDS

UNMATCHED = "UNMATCHED"

#: Reference spellings that are held in memory at most; a longer list is refused.
MAX_ENTRIES = 1_000_000
#: Values whose result a worker remembers; bounds its memory, not the result.
MEMO = 200_000


def bound(length: int) -> int:
    """Edits by which a spelling of that many letters may differ."""
    return 0 if length <= 3 else 1 if length <= 5 else 2


def alias_bound(length: int) -> int:
    """Edits by which an alias or a word of a description may differ: less than a spelling of the reference list."""
    return 0 if length <= 6 else 1


class Trie:
    """Spellings by their letters, each with the canonical values it stands for."""

    __slots__ = ("children", "entries", "limit")

    def __init__(self) -> None:
        self.children: dict[str, Trie] = {}
        self.entries: dict[str, int] = {}
        self.limit = 0  # the greatest bound of any entry below

    def add(self, spelling: str, canonical: str, limit: int | None = None) -> None:
        """Add an entry that may differ by ``limit`` edits, by default according to its length."""
        node, limit = self, bound(len(spelling)) if limit is None else limit
        node.limit = max(node.limit, limit)
        for letter in spelling:
            node = node.children.setdefault(letter, Trie())
            node.limit = max(node.limit, limit)
        node.entries[canonical] = max(limit, node.entries.get(canonical, 0))

    def search(self, value: str) -> list[tuple[int, str, int]]:
        """(distance, canonical value, length of the spelling) of all entries within their bound."""
        found: list[tuple[int, str, int]] = []
        start = list(range(len(value) + 1))
        stack = [(child, letter, "", start, None, 1) for letter, child in self.children.items()]
        while stack:
            node, letter, before, row, older, depth = stack.pop()
            new = [row[0] + 1]
            for k in range(1, len(value) + 1):
                cost = min(new[k - 1] + 1, row[k] + 1, row[k - 1] + (value[k - 1] != letter))
                if older is not None and k > 1 and value[k - 1] == before and value[k - 2] == letter:
                    cost = min(cost, older[k - 2] + 1)
                new.append(cost)
            if node.entries:
                found += [(new[-1], c, depth) for c, limit in node.entries.items() if new[-1] <= limit]
            if min(new) <= node.limit or min(row) < node.limit:
                stack += [(child, x, letter, new, row, depth + 1) for x, child in node.children.items()]
        return found


class Canon:
    """Resolution of one field's values."""

    def __init__(self, field: str, mapping: Mapping[str, str], aliases: Mapping[str, str] | None = None):
        self.field = field
        self.canonical = sorted(set(mapping.values()))
        self.exact = dict(mapping) | {c: c for c in self.canonical}
        self.trie = Trie()
        for spelling, canonical in self.exact.items():
            self.trie.add(spelling, canonical)
        held = set(self.canonical)
        aliases = given_aliases(field) if aliases is None else aliases
        self.aliases = {p: c for p, c in aliases.items() if c in held and p not in self.exact}
        for phrase, canonical in self.aliases.items():
            self.trie.add(phrase, canonical, alias_bound(len(phrase)))
        self.words = Trie()
        for canonical, words in WORDS.get(field, {}).items():
            for word in words if canonical in held else ():
                self.words.add(word, canonical, alias_bound(len(word)))
        self.pairs = [(set(p), c) for c, ps in WORD_PAIRS.get(field, {}).items() if c in held for p in ps]
        self.modifiers = set(MODIFIERS.get(field, ()))
        self.months = field.endswith("month")

    def known(self, value: str) -> bool:
        return value.strip().upper() in self.exact

    def resolve(self, value: str) -> str:
        """The canonical value that ``value`` stands for, or UNMATCHED."""
        text = " ".join(value.upper().split())
        if text in self.exact:
            return self.exact[text]
        plain = list(undecorated(text))
        for form in plain:
            if found := self.exact.get(form) or self.aliases.get(form):
                return found
        bare = [form for form in plain[1:] if form] or plain[:1]
        found = (self._plain(form) for form in bare)
        return next((c for c in found if c and c != UNMATCHED), UNMATCHED)

    def _plain(self, text: str) -> str | None:
        """Canonical value of an undecorated text, UNMATCHED if it means several, None if nothing is known of it."""
        if not text:
            return None
        if found := self.exact.get(text) or self.aliases.get(text):
            return found
        if self.months and (number := self._number(text)) is not None:
            return number
        halves = [h.strip() for h in re.split(r"\s*[/|&+]\s*|\s+OR\s+", text)]
        if len(halves) > 1:
            meant = {self._plain(h) for h in halves}
            return meant.pop() if len(meant) == 1 and None not in meant else UNMATCHED
        if found := self._nearest(text):
            return found
        return self._abbreviated(text) or self._described(text)

    def _nearest(self, text: str) -> str | None:
        hits = self.trie.search(text)
        if not hits:
            return None
        best = min(d for d, _, _ in hits)
        meant = {c for d, c, _ in hits if d == best}
        return meant.pop() if len(meant) == 1 else UNMATCHED

    def _number(self, text: str) -> str | None:
        """Months by number: 6, 06.0, M06, MONTH 6, 6TH MONTH, VI."""
        m = re.fullmatch(r"(?:M|MONTH|MONTH NO\.?|NO\.?|#)? ?0*(\d{1,2})(?:\.0+)?(?:ST|ND|RD|TH)?(?: MONTH)?", text)
        number = int(m[1]) if m else ROMAN.index(text) + 1 if text in ROMAN else None
        if number is None:
            return None
        return self.exact.get(str(number), UNMATCHED) if 1 <= number <= 12 else UNMATCHED

    def _abbreviated(self, text: str) -> str | None:
        """Three letters or more that begin exactly one canonical value, or four or more of its letters in order."""
        if not text.isalpha() or len(text) < 3:
            return None
        starts = [c for c in self.canonical if c.startswith(text)]
        if starts:
            return starts[0] if len(starts) == 1 else UNMATCHED
        if len(text) >= 4:
            inside = [c for c in self.canonical if c[0] == text[0] and c[-1] == text[-1] and subsequence(text, c)]
            return inside[0] if len(inside) == 1 else None
        return None

    def _described(self, text: str) -> str | None:
        """What all words of a description speak for, but for those that only say how or when."""
        said = [w for w in re.findall(r"[^\W_]+", text) if w not in self.modifiers and not (self.months and re.fullmatch(r"\d{1,2}(?:ST|ND|RD|TH)?|\d{4}", w))]
        if not said or len(said) == len(text.split()) == 1 and self.months:
            return None
        pairs = {c for pair, c in self.pairs if pair == set(said)}
        if pairs:
            return pairs.pop()
        meant = set()
        for word in said:
            hits = self.trie.search(word) if self.months else self.words.search(word)
            best = min((d for d, _, _ in hits), default=0)
            named = {c for d, c, _ in hits if d == best}
            if not named:
                return None
            meant |= named
        return meant.pop() if len(meant) == 1 else UNMATCHED


def given_aliases(field: str) -> dict[str, str]:
    """alias -> canonical value of a field, from the lists that come with the library."""
    return {p: c for c, phrases in PHRASES.get(field, {}).items() for p in phrases}


def subsequence(short: str, long: str) -> bool:
    rest = iter(long)
    return all(letter in rest for letter in short)


def undecorated(text: str) -> Iterator[str]:
    """The text with less and less around it; most of it first."""
    yield text
    bare = re.sub(r"\s*[\(\[][^)\]]*[\)\]]\s*", " ", text)
    bare = bare if bare.strip() else re.sub(r"[\(\)\[\]]", " ", text)
    bare = re.sub(r"^[A-Z ]{2,20}[=:]\s*", "", bare)
    bare = " ".join(bare.strip(" \t.?!*;:,-_~\"'`#=<>").split())
    halves = re.split(r"\s*[/|]\s*", bare)
    if len(halves) > 1 and len(set(halves)) == 1:
        bare = halves[0]
    if bare != text:
        yield bare
    letters = bare.split(" ")
    if len(letters) > 2 and all(len(x) == 1 for x in letters):
        yield "".join(letters)


def reference(mappings: DataFrame, fields: Iterable[str]) -> dict[str, dict[str, str]]:
    """field -> spelling -> canonical value, upper case, the latest row of each spelling."""
    spelling, canonical = F.upper(F.trim("raw_synonym")), F.upper(F.trim("canonical_value"))
    rows = mappings.where(F.col("field_name").isin(*fields)).select("field_name", spelling.alias("s"), canonical.alias("c"), "added_at").where("s is not null and c is not null")
    latest = Window.partitionBy("field_name", "s").orderBy(F.col("added_at").desc_nulls_last(), F.col("c").desc())
    rows = rows.withColumn("n", F.row_number().over(latest)).where("n = 1").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} reference spellings")
    out: dict[str, dict[str, str]] = {f: {} for f in fields}
    for r in rows:
        out[r.field_name][r.s] = r.c
    return out


def alias_table(aliases: DataFrame, fields: Iterable[str]) -> dict[str, dict[str, str]]:
    """field -> alias -> canonical value of a table (field_name, alias, canonical_value), beside the lists that come with the library; the table holds."""
    spelling, canonical = F.upper(F.trim("alias")), F.upper(F.trim("canonical_value"))
    rows = aliases.where(F.col("field_name").isin(*fields)).groupBy("field_name", spelling.alias("s")).agg(F.max(canonical).alias("c")).where("s is not null and c is not null").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} aliases")
    out = {f: given_aliases(f) for f in fields}
    for r in rows:
        out[r.field_name][r.s] = r.c
    return out


def canonicalise(df: DataFrame, mappings: DataFrame, fields: list[str], keep: tuple[str, ...] = ("record_id",), aliases: DataFrame | None = None) -> DataFrame:
    """(keep..., field_name, value, canonical_value, known) for every non-null value of the fields.

    ``known`` tells values that the reference lists as they are; others are searched. canonical_value may be UNMATCHED. aliases:
    (field_name, alias, canonical_value), more alias paths for the trie.
    """
    entries = reference(mappings, fields)
    paths = {f: given_aliases(f) for f in fields} if aliases is None else alias_table(aliases, fields)
    canons: dict[str, Canon] = {}

    @F.pandas_udf("canonical_value string, known boolean")
    def look_up(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        memo: dict[tuple[str, str], tuple[str, bool]] = {}
        for names, values in batches:
            out = []
            for key in zip(names, values, strict=True):
                if key not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                    canon = canons.get(key[0]) or canons.setdefault(key[0], Canon(key[0], entries[key[0]], paths[key[0]]))
                    memo[key] = (canon.resolve(key[1]), canon.known(key[1]))
                out.append(memo[key])
            yield pd.DataFrame(out, columns=["canonical_value", "known"])

    pairs = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields))
    long = df.select(F.struct(*keep).alias("_keep"), F.explode(pairs).alias("p")).select("_keep", "p.*").where("value is not null")
    out = long.withColumn("_r", look_up.asNondeterministic()("field_name", "value"))
    return out.select("_keep.*", "field_name", "value", "_r.canonical_value", "_r.known")

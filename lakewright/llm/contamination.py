"""Passages of held-out evaluation items inside training documents.

A case is a document that contains a number of consecutive words of an item, compared by letters and digits only. Both
sides are reduced to the stream of their lower-case letters and digits; the test phrases are all windows of that many words.

Each worker indexes its documents shard by shard. A shard's stream is cut at places that its content defines (a hash of the next
four bytes), so that a phrase is cut at the same places wherever it stands; the pieces that occur in some phrase become symbols,
runs of other pieces collapse to a separator. Over the symbols an FM-index is built: suffix order by prefix doubling, the
Burrows-Wheeler transform, and a wavelet matrix for ranks. All phrases are searched backward at once; occurrences are
located by sampled suffix positions, and the edges of the phrase, which the symbols don't cover, are compared exactly.
Phrases with too few cuts for a symbol are searched in the stream directly. Nothing is sampled or left out, and no document leaves
its partition: the phrases, a fixed list whose size is checked, go to the workers in blocks.

Defined results: NULL or empty texts and items hold nothing, nor do rows without id; items with fewer words than the window give no phrase; repeated
rows give one pair.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 15
#: Characters of documents per index; bounds a worker's memory, not the result (a longer document is a shard by itself).
SHARD_CHARS = 8_000_000
#: Phrases per block of the query set; each block is one pass over the documents.
BLOCK_PHRASES = 2_000_000
#: Characters of all items together; the query set is held by the driver and sent to the workers, so a larger one is refused and has to be given in parts.
MAX_ITEM_CHARS = 1_000_000_000
#: Every suffix position that is a multiple of this is kept for locating.
SAMPLE = 16

_CUT_EVERY = 6
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_NOT_ALNUM = re.compile(r"[\W_]+")


def stream(text: str) -> bytes:
    """Lower-case letters and digits of a text, as UTF-8."""
    return _NOT_ALNUM.sub("", text.lower()).encode("utf-8", "surrogatepass")


def phrases(text: str, window: int = WINDOW) -> list[bytes]:
    """Streams of all windows of consecutive words; words are separated by white space."""
    words = [stream(w) for w in text.split()]
    return [b"".join(words[k : k + window]) for k in range(len(words) - window + 1)]


def _cuts(a: np.ndarray) -> np.ndarray:
    """Positions before which the bytes are cut; each depends on the four bytes from it on."""
    if len(a) < 4:
        return np.empty(0, dtype=np.int64)
    w = a.astype(np.uint32)
    gram = w[:-3] | (w[1:-2] << np.uint32(8)) | (w[2:-1] << np.uint32(16)) | (w[3:] << np.uint32(24))
    mixed = gram * np.uint32(0x85EBCA6B)
    mixed ^= mixed >> np.uint32(13)
    mixed *= np.uint32(0xC2B2AE35)
    return np.flatnonzero((mixed >> np.uint32(8)) % np.uint32(_CUT_EVERY) == 0)


def _powers(n: int, cached: list[np.ndarray] = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if not cached or len(cached[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, dtype=np.uint64)]))
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, dtype=np.uint64)]))
        cached[:] = [up, down]
    return cached[0], cached[1]


def _pieces(a: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the pieces between two cuts."""
    cuts = _cuts(a) if cuts is None else cuts
    if len(cuts) < 2:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    up, down = _powers(len(a))
    with np.errstate(over="ignore"):
        sums = np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)
        upto = np.where(cuts > 0, sums[np.maximum(cuts, 1) - 1], np.uint64(0))
        return cuts[:-1], cuts[1:], (upto[1:] - upto[:-1]) * down[cuts[:-1]]


class WaveletMatrix:
    """Ranks of any symbol in a sequence, for many queries at once."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        s = symbols
        for level in range(bits - 1, -1, -1):
            bit = (s >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
            self.levels.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        begin, end = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            begin = np.where(one, zeros + ones[begin], begin - ones[begin])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - begin

    def at(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, its rank) at each position."""
        symbol, begin, p = np.zeros_like(positions), np.zeros_like(positions), positions
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (ones[p + 1] - ones[p]).astype(bool)
            symbol = symbol | (one.astype(symbol.dtype) << (self.bits - 1 - k))
            begin = np.where(one, zeros + ones[begin], begin - ones[begin])
            p = np.where(one, zeros + ones[p], p - ones[p])
        return symbol, p - begin


class FMIndex:
    """Backward search over symbols 1, 2, ...; 0 separates, no pattern crosses it."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.n = len(symbols)
        order = suffix_order(symbols)
        before = symbols[order - 1]  # of position 0 the last symbol, which is a separator
        self.bwt = WaveletMatrix(before, max(1, int(alphabet).bit_length()))
        counts = np.bincount(symbols, minlength=alphabet + 2)
        self.below = np.concatenate([[0], np.cumsum(counts)])
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.marks = np.concatenate([[0], np.cumsum(sampled, dtype=np.int64)])
        self.samples = order[sampled]

    def search(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns flat[ends[k-1]:ends[k]] in suffix order; empty ones have equal bounds."""
        starts = np.concatenate([[0], ends[:-1]])
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.n, dtype=np.int64)
        live, at = np.arange(len(ends)), ends - 1
        while len(live):
            c = flat[at[live]]
            low[live] = self.below[c] + self.bwt.rank(c, low[live])
            high[live] = self.below[c] + self.bwt.rank(c, high[live])
            at[live] -= 1
            live = live[(low[live] < high[live]) & (at[live] >= starts[live])]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order, by steps back to a sampled one."""
        found, steps, at = np.full(len(rows), -1, dtype=np.int64), 0, rows.copy()
        open_ = np.arange(len(rows))
        while len(open_):
            marked = self.marks[at[open_] + 1] > self.marks[at[open_]]
            done = open_[marked]
            found[done] = self.samples[self.marks[at[done]]] + steps
            open_ = open_[~marked]
            symbol, rank = self.bwt.at(at[open_])
            at[open_] = self.below[symbol] + rank
            steps += 1
        return found


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes, each read up to its first separator; equal ones by position."""
    n = len(symbols)
    separators = np.flatnonzero(symbols == 0)
    length = separators[np.searchsorted(separators, np.arange(n))] - np.arange(n)  # symbols before the next separator
    rank, step, longest = symbols.astype(np.int64), 1, int(length.max()) if n else 0
    while step < longest:
        later = np.zeros(n, dtype=np.int64)
        later[: n - step] = rank[step:]
        later[length < step] = 0
        _, rank = np.unique(rank * (n + 2 + int(rank.max())) + later, return_inverse=True)
        # separators keep the least rank: nothing sorts before them
        step *= 2
    return np.argsort(rank, kind="stable")


class Phrases:
    """The query set: all phrases with their items, cut into symbols."""

    def __init__(self, items: Iterable[tuple[int, str]], window: int = WINDOW):
        owners: dict[bytes, set[int]] = defaultdict(set)
        for item, text in items:
            for phrase in phrases(text or "", window):
                if phrase:
                    owners[phrase].add(item)
        self.texts = list(owners)
        self.items = [sorted(owners[p]) for p in self.texts]
        data = np.frombuffer(b"\0".join(self.texts), dtype=np.uint8)
        begin = np.cumsum([0, *(len(p) + 1 for p in self.texts)], dtype=np.int64)
        cuts = _cuts(data)
        owner = np.searchsorted(begin, cuts, side="right") - 1
        inside = cuts + 4 < begin[owner + 1]  # the four bytes that make the cut are the phrase's own
        cuts = cuts[inside]
        starts, ends, hashes = _pieces(data, cuts)
        owner = np.searchsorted(begin, starts, side="right") - 1
        whole = ends < begin[owner + 1] if len(starts) else np.empty(0, dtype=bool)
        starts, hashes, owner = starts[whole], hashes[whole], owner[whole]
        self.vocabulary = np.unique(hashes)
        self.cored, first, count = np.unique(owner, return_index=True, return_counts=True)
        self.bare = np.setdiff1d(np.arange(len(self.texts)), self.cored).tolist()
        self.offset = starts[first] - begin[self.cored]
        self.flat = np.searchsorted(self.vocabulary, hashes) + 1
        self.ends = np.cumsum(count, dtype=np.int64)

    def find(self, data: bytes) -> list[tuple[int, int]]:
        """(phrase, position) of all occurrences in a stream of documents that are separated by zero bytes."""
        a = np.frombuffer(data, dtype=np.uint8)
        found: list[tuple[int, int]] = []
        for k in self.bare:
            at = data.find(self.texts[k])
            while at >= 0:
                found.append((k, at))
                at = data.find(self.texts[k], at + 1)
        starts, _, hashes = _pieces(a)
        if not len(starts) or not len(self.cored):
            return found
        symbol = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[symbol] == hashes, symbol + 1, 0)
        keep = (symbol > 0) | np.concatenate([[True], symbol[:-1] > 0])  # one separator for a run of them
        symbol, starts = np.append(symbol[keep], 0), np.append(starts[keep], len(data))
        index = FMIndex(symbol, len(self.vocabulary))
        low, high = index.search(self.flat, self.ends)
        hits = np.flatnonzero(low < high)
        if not len(hits):
            return found
        sizes = (high - low)[hits]
        rows = np.repeat(low[hits], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        which = np.repeat(hits, sizes)
        at = starts[index.locate(rows)] - self.offset[which]
        for k, p in zip(which.tolist(), at.tolist(), strict=True):
            phrase = int(self.cored[k])
            text = self.texts[phrase]
            if p >= 0 and data[p : p + len(text)] == text:
                found.append((phrase, p))
        return found


@lru_cache(maxsize=1)
def _prepared(block: tuple[tuple[int, str], ...], window: int) -> Phrases:
    """The query set of a block, made once per worker."""
    return Phrases(block, window)


def _shards(ids: Sequence, texts: Sequence[str | None]) -> Iterator[list[tuple[object, str]]]:
    shard, size = [], 0
    for doc, text in zip(ids, texts, strict=True):
        if not text:
            continue
        if shard and size + len(text) > SHARD_CHARS:
            yield shard
            shard, size = [], 0
        shard.append((doc, text))
        size += len(text)
    if shard:
        yield shard


def _spans(shard: list[tuple[object, str]], query: Phrases) -> list[tuple[object, int, int, int]]:
    """(document, item, start, end) with character positions in the document, merged where passages of one item touch."""
    streams = [stream(t) for _, t in shard]
    first = np.concatenate([[0], np.cumsum([len(s) + 1 for s in streams])])
    per: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for k, at in query.find(b"\0".join(streams)):
        doc = int(np.searchsorted(first, at, side="right")) - 1
        begin = at - int(first[doc])
        for item in query.items[k]:
            per[doc, item].append((begin, begin + len(query.texts[k])))
    out, places = [], {}
    for (doc, item), spans in sorted(per.items()):
        if doc not in places:
            kept = [(i, len(low.encode("utf-8", "surrogatepass"))) for i, c in enumerate(shard[doc][1]) if (low := _NOT_ALNUM.sub("", c.lower()))]
            places[doc] = np.repeat([i for i, _ in kept], [n for _, n in kept])
        merged: list[list[int]] = []
        for begin, end in sorted(spans):
            if merged and begin <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([begin, end])
        out += [(shard[doc][0], item, int(places[doc][b]), int(places[doc][e - 1]) + 1) for b, e in merged]
    return out


def leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, start, end): every passage of an item in a document, touching ones merged.

    The items are read to the driver in blocks of a bounded number of words; the documents are read once per block.
    """
    if (items.agg(F.sum(F.char_length(item_text))).first()[0] or 0) > MAX_ITEM_CHARS:
        raise ValueError(f"items of more than {MAX_ITEM_CHARS} characters: give them in parts")
    rows = [(r[0], r[1]) for r in items.select(item_id, item_text).where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).toLocalIterator()]
    blocks, size = [[]], 0
    for row in rows:
        size += max(0, len(row[1].split()) - window + 1)
        if size > BLOCK_PHRASES and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(row)
    schema = f"doc_id {dict(documents.dtypes)[doc_id]}, item_id {dict(items.dtypes)[item_id]}, start long, end long"

    def one(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query = _prepared(tuple(block), window)
            for batch in batches:
                for shard in _shards(batch[doc_id].tolist(), batch[text].tolist()):
                    if found := _spans(shard, query):
                        yield pd.DataFrame(found, columns=["doc_id", "item_id", "start", "end"])

        return documents.select(doc_id, text).where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).mapInPandas(run, schema)

    return reduce(DataFrame.unionByName, map(one, blocks))


def removal_spans(found: DataFrame) -> DataFrame:
    """(doc_id, spans): the places to cut out of each document that leaks, over all items, merged and in order."""
    ordered = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done, span):
        last = F.try_element_at(done, F.lit(-1))
        touches = (F.size(done) > 0) & (span["start"] <= last["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(F.struct(span["start"].alias("start"), span["end"].alias("end")))))

    return ordered.select("doc_id", F.aggregate("spans", start, add).alias("spans"))

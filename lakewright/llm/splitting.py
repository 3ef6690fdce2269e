"""Items above a size limit cut into pieces at natural boundaries, with an overlap between consecutive pieces.

A text is parsed into a tree: sections by their headings (``#`` marks, underlined titles, ``<h1>`` to ``<h6>``), and within them paragraphs,
lists of items with their continuation lines and nested lists, tables of rows, and fenced code, which is a leaf whatever its lines look like. Only
nodes that are too large are entered. Their children are packed bottom-up: neighbours are merged as long as they fit, siblings only, so that no
piece holds the end of one section and the beginning of the next unless it holds both whole. A heading stays with the
beginning of its text; one without text with what follows it. A paragraph, item, row or code block that is too large by itself is cut between
lines, then sentences, clauses, words and at last tokens, never within a character.

Every piece but the first begins with the last tokens of the one before, from a word's beginning on. Sizes are tokens of a public
tokenizer, exact for each piece: one that has more tokens by itself than within its text gets a shorter overlap, and is cut again if that isn't enough.

Texts of at most as many bytes as the limit has tokens can't exceed it and aren't encoded. Each text is split where it lies: no shuffle.

Defined results: NULL, empty and small texts, and rows without id, give no pieces; repeated rows give their pieces each.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.tokens import TOKENIZERS, VOCABULARY, encoding

LIMIT, OVERLAP = 1_500, 100
#: Tokens by which an overlap is shortened at a time where a piece by itself has more tokens than within its text.
SLACK = 8

_LINES = re.compile(rb"[^\r\n]*(?:\r\n|\n|\r|\Z)")
_HEADING = re.compile(rb" {0,3}(#{1,6})(?:[ \t]|$)|[ \t]*<h([1-6])[ >]", re.IGNORECASE)
_UNDERLINE = re.compile(rb" {0,3}(=+|-{3,})[ \t]*$")
_FENCE = re.compile(rb" {0,3}(`{3,}|~{3,})")
_ITEM = re.compile(rb"([ \t]*)(?:[-*+]|\xe2\x80\xa2|\d{1,9}[.)])[ \t]+\S")
_ROW = re.compile(rb"[ \t]*\|")
_INDENT = re.compile(rb"[ \t]*")
#: Ends of lines, sentences, clauses, words: a leaf is cut after the match.
_ENDS = (
    re.compile(rb"(?:\r\n|\n|\r)"), re.compile(rb"(?:[.!?]|\xe2\x80\xa6)[\"')\]]*(?=[ \t])"), re.compile(rb"[,;:](?=[ \t])"),
    re.compile(rb"(?<=\S)(?=[ \t])|(?<=[^\s])(?=\xc2\xa0)"),
)
_WORDS = len(_ENDS) - 1


@dataclass
class Node:
    """A span of the text; a leaf has no children, those of others make it up without gaps. A section's heading belongs to its first child, whose own text begins at ``body``."""

    begin: int
    end: int
    kind: str
    children: list[Node] = field(default_factory=list)
    body: int = 0


def _blocks(data: bytes) -> Iterator[tuple[str, int, int, int]]:
    """(kind, level, begin, end) of headings, fenced code and other lines in order; blank lines belong to what precedes them."""
    lines = [(m.start(), m.end()) for m in _LINES.finditer(data) if m.end() > m.start()]
    k = 0
    while k < len(lines):
        begin, end = lines[k]
        line = data[begin:end].rstrip(b"\r\n")
        kind, level, k = "line", 0, k + 1
        if fence := _FENCE.match(line):
            kind, mark = "code", fence[1]
            while k < len(lines):
                inner = data[lines[k][0] : lines[k][1]].strip()
                end, k = lines[k][1], k + 1
                if inner.startswith(mark) and not inner.strip(mark[:1]):
                    break
        elif heading := _HEADING.match(line):
            kind, level = "heading", len(heading[1]) if heading[1] else int(heading[2])
        elif not line.strip():
            kind = "blank"
        elif k < len(lines) and (under := _UNDERLINE.match(data[lines[k][0] : lines[k][1]].rstrip(b"\r\n"))) and not _ITEM.match(line) and not _ROW.match(line):
            kind, level, end, k = "title", 1 if under[1].startswith(b"=") else 2, lines[k][1], k + 1
        yield kind, level, begin, end


def parse(data: bytes) -> Node:
    """The tree of a text."""
    root = Node(0, len(data), "text")
    open_sections: list[tuple[int, Node]] = [(0, root)]
    body: list[Node] = []  # blocks of the innermost section that have no node of their own yet
    above_blank = True  # whether a line stands at the beginning or below a blank one
    bare: int | None = None  # where a heading begins that has no text yet

    def close_body() -> None:
        if body:
            open_sections[-1][1].children += body
            body.clear()

    for kind, level, begin, end in _blocks(data):
        if kind == "title" and not above_blank:
            kind = "line"  # the last line of a paragraph above a rule
        if kind in ("heading", "title"):
            close_body()
            lower = None
            while open_sections[-1][0] >= level:
                _, node = open_sections.pop()
                if bare is not None and node.begin >= bare:
                    open_sections[-1][1].children.remove(node)  # no text: it stays with the next heading
                    lower = node.begin
            node = Node(begin if lower is None else lower, end, "section")
            open_sections[-1][1].children.append(node)
            open_sections.append((level, node))
            bare = node.begin if bare is None or lower is not None else bare
        elif kind == "blank" and bare is None and body:
            body[-1].end = end
            _stretch(body[-1])
        elif kind != "blank":
            bare = None
            _add(body, data, kind, begin, end, above_blank)
        above_blank = kind == "blank" or kind in ("heading", "title", "code")
    close_body()
    _fill(root, 0, len(data))
    return root


def _stretch(node: Node) -> None:
    """Let the last descendants end where the node ends."""
    while node.children:
        node.children[-1].end = node.end
        node = node.children[-1]


def _add(body: list[Node], data: bytes, kind: str, begin: int, end: int, above_blank: bool) -> None:
    """Add a line or a code block to the blocks of a section."""
    last = body[-1] if body else None
    line = data[begin:end]
    item, indent = _ITEM.match(line), len(_INDENT.match(line)[0].expandtabs(4))
    if kind == "code":
        body.append(Node(begin, end, "code"))
    elif item and (last is None or last.kind == "list" or above_blank or indent == 0):
        if last is None or last.kind != "list":
            body.append(Node(begin, end, "list", [Node(begin, end, f"item {indent}")]))
        else:
            _nest(last, Node(begin, end, f"item {indent}"), indent)
    elif last is not None and last.kind == "list" and (indent > 0 or not above_blank):
        last.end = end
        _stretch(last)
    elif _ROW.match(line):
        if last is not None and last.kind == "table" and not above_blank:
            last.children.append(Node(begin, end, "row"))
            last.end = end
        else:
            body.append(Node(begin, end, "table", [Node(begin, end, "row")]))
    elif last is not None and last.kind == "paragraph" and not above_blank:
        last.end = end
    else:
        body.append(Node(begin, end, "paragraph"))


def _nest(parent: Node, item: Node, indent: int) -> None:
    """Put an item behind its siblings: into the last item that is indented less."""
    parent.end = item.end
    last = parent.children[-1]
    while int(last.kind.split()[1]) < indent:
        last.end = item.end
        if not last.children:
            last.children.append(Node(last.begin, item.begin, last.kind))  # the item's own text
            last.children.append(item)
            return
        parent, last = last, last.children[-1]
    parent.children.append(item)


def _fill(node: Node, begin: int, end: int) -> None:
    """Stretch nodes over gaps between them (headings, blank lines), so that children make up their parent."""
    node.body, node.begin, node.end = node.begin, begin, end
    for k, child in enumerate(node.children):
        left = begin if k == 0 else child.begin
        right = end if k + 1 == len(node.children) else node.children[k + 1].begin
        _fill(child, left, right)


class Packer:
    """Spans of a text of at most so many tokens, along its tree."""

    def __init__(self, data: bytes, ends: np.ndarray):
        self.data, self.ends = data, ends.tolist()  # ends: byte after each token
        self.starts = [0, *self.ends[:-1]]
        self._places: list[list[int] | None] = [None] * len(_ENDS)

    def places(self, k: int) -> list[int]:
        """Where leaves are cut at level k: lines, sentences, clauses, words."""
        if self._places[k] is None:
            self._places[k] = [m.end() for m in _ENDS[k].finditer(self.data)]
        return self._places[k]

    def size(self, begin: int, end: int) -> int:
        """Tokens that lie in or reach into the span."""
        return bisect_left(self.starts, end) - bisect_right(self.ends, begin)

    def pack(self, node: Node, most: int) -> list[tuple[int, int]]:
        """Spans of at most ``most`` tokens that make up the node."""
        if self.size(node.begin, node.end) <= most:
            return [(node.begin, node.end)]
        if not node.children:
            return self.leaf(node.begin, node.end, most, node.body)
        return self._merged(((c.kind == "section", self.pack(c, most)) for c in node.children), most)

    def leaf(self, begin: int, end: int, most: int, body: int = 0, k: int = 0) -> list[tuple[int, int]]:
        """Spans of a text without structure; what stands above ``body`` stays with the text's beginning."""
        if self.size(begin, end) <= most:
            return [(begin, end)]
        if k == len(_ENDS):
            return self._hard(begin, end, most)
        places = self.places(k)
        bounds = [begin, *places[bisect_right(places, max(begin, body)) : bisect_left(places, end)], end]
        if len(bounds) == 2:
            return self.leaf(begin, end, most, body, k + 1)
        return self._merged(((False, self.leaf(a, b, most, body, k + 1)) for a, b in zip(bounds, bounds[1:])), most)

    def _merged(self, parts: Iterator[tuple[bool, list[tuple[int, int]]]], most: int) -> list[tuple[int, int]]:
        """Siblings in order, each as its spans: whole ones are merged while they fit. What is left of a block that was cut goes on with the next block, of a section with none."""
        packed: list[tuple[int, int]] = []
        joins = False
        for section, spans in parts:
            whole = len(spans) == 1
            if packed and joins and whole and self.size(packed[-1][0], spans[0][1]) <= most:
                packed[-1] = (packed[-1][0], spans[0][1])
            else:
                packed += spans
            joins = whole or not section
        return packed

    def _hard(self, begin: int, end: int, most: int) -> list[tuple[int, int]]:
        spans = []
        while self.size(begin, end) > most:
            cut = self.ends[bisect_right(self.ends, begin) + most - 1]
            while cut > begin + 1 and self.data[cut] & 0xC0 == 0x80:  # not within a character
                cut -= 1
            spans.append((begin, cut))
            begin = cut
        return [*spans, (begin, end)]

    def before(self, place: int, tokens: int) -> int:
        """Begin of the word that starts within the last ``tokens`` tokens before ``place``."""
        early = self.starts[max(0, bisect_left(self.starts, place) - tokens)]
        words = self.places(_WORDS)
        k = bisect_left(words, early)
        if k < len(words) and words[k] < place:
            return words[k]
        while early < place and self.data[early] & 0xC0 == 0x80:
            early += 1
        return early


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> list[tuple[int, int, int, int]]:
    """(start, body_start, end, tokens) of the pieces in characters; empty if the text is within the limit."""
    encoder, lengths = encoding(folder, vocabulary)
    tokens = encoder.encode_ordinary(text)
    if len(tokens) <= limit:
        return []
    data = text.encode("utf-8")
    packer = Packer(data, np.cumsum(lengths[tokens]))
    count = lambda a, b: len(encoder.encode_ordinary(data[a:b].decode("utf-8")))
    todo = packer.pack(parse(data), limit - overlap)[::-1]
    pieces, char, byte, most = [], 0, 0, limit - overlap
    while todo:
        begin, end = todo.pop()
        back = overlap if begin else 0
        start = packer.before(begin, back) if back else begin
        n = count(start, end)
        while n > limit and back > 0:  # more tokens by itself than within its text: shorter overlap
            back = max(0, back - SLACK)
            start = packer.before(begin, back) if back else begin
            n = count(start, end)
        if n > limit:
            most = max(1, min(most - SLACK, packer.size(begin, end) * limit // n - 1))
            todo += packer.leaf(begin, end, most)[::-1]
            continue
        most = limit - overlap
        char += len(data[byte:begin].decode("utf-8"))
        byte = begin
        lead = len(data[start:begin].decode("utf-8"))
        pieces.append((char - lead, char, char + len(data[begin:end].decode("utf-8")), n))
    return pieces


def pieces(documents: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, body_start, end, n_tokens[, text]) of every document above the limit."""
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start int, body_start int, end int, n_tokens int" + ", text string" * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                for k, (start, body, end, n) in enumerate(split_text(text, limit, overlap, folder, vocabulary)):
                    rows.append((doc, k, start, body, end, n, *([text[start:end]] if with_text else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "body_start", "end", "n_tokens", *(["text"] if with_text else [])])

    large = documents.select("doc_id", "text").where((F.octet_length("text") > limit) & F.col("doc_id").isNotNull())
    return large.mapInPandas(run, schema)

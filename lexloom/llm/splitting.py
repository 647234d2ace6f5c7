"""Cutting oversized items into pieces at natural boundaries, by packing a tree of their structure.

A text is parsed into leaves (sentences), lines, list items by their nesting, blocks, and sections by the rank of their
headings. The tree is packed bottom-up: a node that fits is one piece, neighbours merge while they fit, and only a node
that does not fit is entered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ends of lines, pages and sentences: where an item may be cut.
NATURAL = re.compile("\r\n|[\n\r\v\f\x85\u2028\u2029]|[.!?]+(?=\\s)|[。！？]+")
_LINE_ENDS = "\r\n\v\f\x85\u2028\u2029"
# Headings and their ranks, from the top; a rank of None is the number of the signs that match.
HEADINGS = [
    (1, re.compile(r"\s*(?:PART|BAB|Part|Bab|Часть|Phần)\s+[\dIVXLC]+\b|第[\d一二三四五六七八九十百千]+编")),
    (2, re.compile(r"\s*(?:CHAPTER|Chapter|Глава|Chương|Bagian)\s+[\dIVXLC]+\b|第[\d一二三四五六七八九十百千]+章")),
    (None, re.compile(r"(#{1,6})\s")),
    (None, re.compile(r"(={1,6})\s*[^=\s].*=\s*$")),
    (7, re.compile(r"\s*(?:Section|Article|Pasal|Điều|Статья|SECTION|ARTICLE)\s+\d|第[\d一二三四五六七八九十百千]+条|\\\\(?:sub)*section\b")),
    (8, re.compile(r"\d{1,3}[.)]?\s+\S{1,60}$")),
]
_ITEM = re.compile(r"([ \t]*)(?:[-*+•·]|\(?\w{1,3}[.)])\s")


class Tree:
    """The structure of a text: nodes with start, end, children (later nodes) and, of leaves, where their wording ends."""

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] = []
        self.end: list[int] = []
        self.inside: list[list[int]] = []
        self.wording: list[int | None] = []
        self._node(0, None)
        self._grow()

    def _node(self, start: int, parent: int | None, wording: int | None = None) -> int:
        self.start.append(start)
        self.end.append(start)
        self.inside.append([])
        self.wording.append(wording)
        if parent is not None:
            self.inside[parent].append(len(self.start) - 1)
        return len(self.start) - 1

    def _lines(self):
        """(leaves as (start, end of the wording, end), whether a page ends) of each line."""
        text, leaves, at = self.text, [], 0
        for m in NATURAL.finditer(text):
            end = m.end()
            if m[0][0] in _LINE_ENDS:
                leaves.append((at, m.start(), end))
                yield leaves, m[0] == "\f"
                leaves = []
            else:
                while end < len(text) and text[end] in " \t\u3000":  # blanks stay with the sentence they follow
                    end += 1
                leaves.append((at, m.start(), end))
            at = end
        if at < len(text) or leaves:
            leaves.append((at, len(text), len(text)))
            yield leaves, False

    def _rank(self, line: str) -> int | None:
        for rank, sign in HEADINGS:
            if m := sign.match(line):
                return rank if rank is not None else len(m[1])
        return None

    def _grow(self) -> None:
        page = self._node(0, 0)
        sections: list[tuple[int, int]] = [(0, page)]  # rank, node; a page is of rank 0
        block: int | None = None
        items: list[tuple[int, int]] = []  # indentation, node
        for leaves, page_ends in self._lines():
            a, b = leaves[0][0], leaves[-1][2]
            line = self.text[a : leaves[-1][1]]
            if not line.strip():
                parent = block if block is not None else sections[-1][1]
                self._node(a, parent, a)
                block, items = None, []
            else:
                rank = self._rank(line)
                if rank is not None:
                    while sections[-1][0] >= rank:
                        sections.pop()
                    sections.append((rank, self._node(a, sections[-1][1])))
                    block, items = None, []
                if block is None:
                    block = self._node(a, sections[-1][1])
                parent = block
                if m := _ITEM.match(line):
                    deep = len(m[1].expandtabs(4))
                    while items and items[-1][0] >= deep:
                        items.pop()
                    parent = self._node(a, items[-1][1] if items else block)
                    items.append((deep, parent))
                elif items:
                    parent = items[-1][1]
                row = self._node(a, parent)
                for x, w, y in leaves:
                    leaf = self._node(x, row, w)
                    self.end[leaf] = y
            self.end[-1] = b
            if page_ends:
                page = self._node(b, 0)
                sections, block, items = [(0, page)], None, []
        for i in range(len(self.start) - 1, -1, -1):
            if self.inside[i]:
                self.end[i] = self.end[self.inside[i][-1]]

    def longest_stretch(self) -> int:
        """The length of the longest stretch without a natural boundary, read off the leaves."""
        return max((w - a for a, w in zip(self.start, self.wording) if w is not None), default=0)

    def pack(self, room: int) -> list[tuple[int, int, bool]]:
        """Spans of at most `room` that cover the text, and whether each ends by a forced cut."""
        packed: dict[int, list[tuple[int, int, bool]]] = {}
        for i in range(len(self.start) - 1, -1, -1):  # children come after their parents
            a, b = self.start[i], self.end[i]
            if b - a <= room:
                packed[i] = [(a, b, False)]
                for k in self.inside[i]:
                    del packed[k]
                continue
            out: list[tuple[int, int, bool]] = []
            if not self.inside[i]:  # nothing to cut at: at a blank in the last tenth, else anywhere
                while b - a > room:
                    blank = self.text.rfind(" ", a + room - room // 10, a + room)
                    at = blank + 1 if blank > a else a + room
                    out.append((a, at, True))
                    a = at
                packed[i] = [*out, (a, b, False)]
                continue
            for k in self.inside[i]:
                own = packed.pop(k)
                if out and not out[-1][2] and own[0][1] - out[-1][0] <= room:
                    out[-1] = (out[-1][0], own[0][1], own[0][2])
                    own = own[1:]
                out += own
            packed[i] = out
        return [p for p in packed[0] if p[1] > p[0]]


def has_long_stretch(text: str, limit: int) -> bool:
    """Whether some stretch of more than `limit` characters holds no natural boundary."""
    return Tree(text).longest_stretch() > limit


def split_text(text: str, limit: int = 3000, overlap: int = 200) -> list[tuple[int, int, int, bool]]:
    """(start, new from, end, forced end) of the pieces of a text.

    Every piece but the first begins with the last `overlap` characters of the one before (`start` to `new from`); no
    piece is longer than `limit`; the new parts, put together, are the text. A text within the limit is one piece.
    """
    return _pieces(Tree(text), limit, overlap)


def _pieces(tree: Tree, limit: int, overlap: int) -> list[tuple[int, int, int, bool]]:
    if len(tree.text) <= limit:
        return [(0, 0, len(tree.text), False)]
    return [(max(0, a - overlap) if i else 0, a, b, f) for i, (a, b, f) in enumerate(tree.pack(limit - overlap))]


PIECES = "array<struct<piece: int, start: int, new_from: int, end: int, forced_end: int, text: string>>"


def split_oversized(items: DataFrame, id_col: str, text_col: str, limit: int = 3000, overlap: int = 200, json_field: str | None = None) -> DataFrame:
    """(id, forced INT, pieces): the items of more than `limit` characters and their pieces; the others are left out.

    With `json_field` the text is that field of the JSON in `text_col`; JSON may have been written into a string once
    more; what is unreadable or has no such string has no text. Null and empty texts are never oversized. `forced` is
    1 if a leaf of the tree, a stretch without a natural boundary, has more than `limit` characters. Repeated rows give repeated results.
    `pieces` has piece (0, 1, ...), start, new_from, end (offsets in characters), forced_end and text.
    Rows that can't be oversized are dropped before they reach Python: JSON is never shorter than what it holds.
    """
    schema = f"`{id_col}` {items.schema[id_col].dataType.simpleString()}, forced int, pieces {PIECES}"

    def wording(raw: str) -> str | None:
        try:
            v = json.loads(raw)
            for _ in range(2):
                if isinstance(v, str):
                    v = json.loads(v)
            v = v.get(json_field) if isinstance(v, dict) else None
        except (ValueError, RecursionError):
            return None
        return v if isinstance(v, str) else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, forced, pieces = [], [], []
            for i, t in zip(f.iloc[:, 0], f.iloc[:, 1]):
                t = wording(t) if json_field else t
                if t is None or len(t) <= limit:
                    continue
                ids.append(i)
                tree = Tree(t)
                forced.append(int(tree.longest_stretch() > limit))
                pieces.append([{"piece": k, "start": s, "new_from": n, "end": e, "forced_end": int(x), "text": t[s:e]} for k, (s, n, e, x) in enumerate(_pieces(tree, limit, overlap))])
            yield pd.DataFrame({id_col: pd.Series(ids, dtype=f.dtypes.iloc[0]), "forced": pd.Series(forced, dtype="int32"), "pieces": pd.Series(pieces, dtype=object)})

    return items.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("_text")).where(F.length("_text") > limit).mapInPandas(run, schema)

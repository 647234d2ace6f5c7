"""Byte-pair encoding of a whole corpus with the rank file of a public tokenizer.

Merges run in numpy over the symbols of many words at once: all symbols lie in one flat array, adjacent pairs are
looked up by binary search in the sorted array of pair keys, each word merges every occurrence of its lowest-ranked
pair, and words without a pair left leave the array. Rounds are as many as the longest chain of merges in any word,
not as there are words.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.session import spread

#: Words whose ids a worker remembers between batches; beyond it the memory starts anew. It never changes a result.
MEMORY = 300_000
#: Symbols encoded in one go; bounds the memory of the merge rounds.
SYMBOLS = 4_000_000

_loaded: dict[tuple[str, str], Encoder] = {}


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """(path of the rank file, pattern that splits text) of an installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


class Encoder:
    """Ids of words under a rank file: lines of base64 token and rank, the rank being the id."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        self.byte_id = np.zeros(256, np.int64)
        keys, ids = [], []
        for token, rank in ranks.items():
            if len(token) == 1:
                self.byte_id[token[0]] = rank
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ids.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ids = np.array(keys, np.int64)[order], np.array(ids, np.int64)[order]
        self.whole = ranks
        self.known: dict[str, np.ndarray] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (non-empty byte strings)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[np.ndarray | None] = [None] * len(words)
        none = np.iinfo(np.int64).max
        while symbols.size:
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ids[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, first)
            over = best == none
            counts = np.diff(np.r_[first, len(owner)])
            if over.any():
                for w, a, n in zip(owner[first[over]].tolist(), first[over].tolist(), counts[over].tolist()):
                    done[w] = symbols[a : a + n]
            hit = (rank == np.repeat(best, counts)) & (rank != none)
            # in a run of overlapping occurrences every second one merges, from the left
            where = np.flatnonzero(hit)
            starts = np.r_[True, np.diff(where) != 1] if where.size else np.zeros(0, bool)
            begin = where[starts]
            nth = where - np.repeat(begin, np.diff(np.r_[np.flatnonzero(starts), where.size])) if where.size else where
            where = where[nth % 2 == 0]
            symbols[where] = rank[where]
            keep = np.repeat(~over, counts)
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return done

    def learn(self, words: list[str]) -> None:
        """Encodes words and keeps their ids in `known`."""
        batch, n = [], 0
        raws: list[bytes] = []

        def flush():
            for w, ids in zip(batch, self.merge(raws)):
                self.known[w] = ids
            batch.clear()
            raws.clear()

        for w in words:
            raw = w.encode("utf-8", "replace")
            whole = self.whole.get(raw)
            if whole is not None:
                self.known[w] = np.array([whole], np.int64)
                continue
            batch.append(w)
            raws.append(raw)
            n += len(raw)
            if n > SYMBOLS:
                flush()
                n = 0
        if batch:
            flush()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): text i has ids[offsets[i]:offsets[i + 1]]; an empty or null text has none."""
        split, number = self.split, {}
        counts = np.zeros(len(texts), np.int64)
        flow: list[int] = []
        for i, t in enumerate(texts):
            if t:
                w = split(t)
                counts[i] = len(w)
                flow.extend([number.setdefault(x, len(number)) for x in w])
        words = list(number)
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > MEMORY:
            self.known.clear()
            fresh = words
        self.learn(fresh)
        known = self.known
        ids = [known[w] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        table = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        start = np.concatenate([[0], np.cumsum(size)])
        f = np.array(flow, np.int64)
        each = size[f] if f.size else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(each)])
        out = table[np.repeat(start[f] - total[:-1], each) + np.arange(total[-1])] if f.size else table[:0]
        ends = total[np.concatenate([[0], np.cumsum(counts)])]
        return ends, out


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this worker process, loaded once."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Encoder(path, pattern)
    return _loaded[path, pattern]


def encode_corpus(docs: DataFrame, id_col: str, text_col: str, vocabulary: tuple[str, str] | None = None, only_sizes: bool = False) -> DataFrame:
    """(id, ids ARRAY<INT>) of each row, or (id, n_tokens INT) with `only_sizes`.

    No special tokens are added; strings that look like them are ordinary text. Empty and null texts have an empty
    list (size 0). Rows are kept as they are, repeated ones too; a null id stays null. Narrow: no shuffle but the dealing out of a scan of few files.
    """
    path, pattern = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.IntegerType()) if only_sizes else T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            for piece in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                ends, out = enc.encode(piece.column(1).to_pylist())
                if only_sizes:
                    value = pa.array(np.diff(ends).astype(np.int32))
                else:
                    value = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([piece.column(0), value], names=[id_col, "n_tokens" if only_sizes else "ids"])

    return spread(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("_text"))).mapInArrow(run, schema)

"""Repairing the text of scanned pages: running heads, page numbers, cut words, misread characters.

Lines are labelled by a hidden Markov model over symbols of their layout, fitted on all lines by expectation-maximisation;
plain rules say only what the surest lines are, as weak seeds.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.session import materialize, small_batches, spread

#: States of a line: running head or foot, page number, start of a paragraph or heading, its continuation, blank.
STATES = ("head", "number", "start", "more", "blank")
HEAD, NUMBER, START, MORE, BLANK = range(5)
CUT = "-\u2010\u2011\xac\xad"
PAGE_NUMBER = re.compile(
    r"^\W*(?:(?:page|pg|p|hal(?:aman)?|стр(?:аница)?|с|trang|第)\W*)?(?:\d{1,4}|[ivx]{1,2}|(?=[ivxlc]{3})[ivxlc]{3,7})(?:\s*(?:of|/|from|dari|из|trên|共)\s*\d{1,4})?\s*页?\W*$|^\W*\d(?: \d){1,3}\W*$", re.I
)
NUMBERED = re.compile(r"^\s*(?:(?:\d{1,3}[.)]|\(\w{1,3}\)|[A-ZА-Я]{3,7} \d+)\s*\S|\(\w{1,3}\)$)")
_GAP = re.compile(r"\S {4,}\S")
_SIDE_NUMBER = re.compile(r"^\d{1,4}\s{2,}|\s{2,}\d{1,4}$")
_SAYS = re.compile(r"\S [a-zа-я]+ [a-zа-я]+ [a-zа-я]+ [a-zа-я]+")
# What a scan reads and what stood there, single letters and groups, Latin and Cyrillic.
MISREAD = {
    "@": ["a"], "!": ["i", "l"], "0": ["o", "о", "d"], "5": ["s"], "(": ["c", "с"], "1": ["l", "i"], "9": ["g"], "6": ["b", "б"], "3": ["з", "e"], "8": ["b", "в"], "4": ["a", "ч"], "|": ["l", "i"],
    "$": ["s"], "2": ["z"], "7": ["t"], "ſ": ["f"], "f": ["t"], "t": ["f"], "b": ["h"], "h": ["b", "li"], "c": ["e", "o", "е", "с"], "e": ["c", "o", "е"], "l": ["i", "t", "1"], "i": ["l", "j"],
    "o": ["c", "о"], "u": ["v", "ii"], "v": ["y", "u"], "n": ["ri", "u"], "m": ["in", "rn", "nn"], "d": ["cl"], "w": ["vv"], "ri": ["n"], "rn": ["m"], "nn": ["m"], "cl": ["d"], "ii": ["u"],
    "vv": ["w"], "li": ["h"], "in": ["m"], "lc": ["k"], "ui": ["ш"], "н": ["и", "п"], "п": ["н", "л"], "и": ["н"], "г": ["т"], "т": ["г"], "л": ["п"], "ц": ["и"], "ш": ["щ"], "щ": ["ш"], "ь": ["ы", "ъ"], "б": ["6"],
    "э": ["з"], "з": ["э"], "с": ["е"], "о": ["с"], "a": ["а", "o"], "p": ["р"], "x": ["х"], "y": ["у", "v"], "k": ["к", "lc"], "ч": ["ц"], "ы": ["ь"], "е": ["с"], "рп": ["м"], "м": ["рп"], "ж": ["к"], "в": ["з"],
}
_FOLD = [("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("in", "m")]
_FOLD_CHAR = str.maketrans("@!0(159ſ|бп63гhcfijl", "aioclsgf|бнбзтbetiii")


def _fold(line: str) -> str:
    """A line without its numbers at the ends and with look-alike characters made one, to see that it is repeated."""
    s = re.sub(r"^\W*\d{0,4}\W+|\W+\d{1,3}\W*$", "", f" {line.lower()} ")
    s = s.translate(_FOLD_CHAR)
    for a, b in _FOLD:
        s = s.replace(a, b)
    return re.sub(r"[\W_]+", "", s)


def _title_like(s: str) -> bool:
    words = [w for w in re.findall(r"[^\W\d_][\w'’-]*", s)]
    if not words:
        return False
    up = sum(w[0].isupper() for w in words)
    return up >= 0.7 * len(words) or bool(re.match(r"^\W*\w+\W+[«(]", s) and re.search(r"\d{4}", s))


#: The parts of a line's symbol; a symbol is a number below SYMBOLS that says all five.
PLACES = ("any", "mid", "top", "second", "end")
FORMS = ("blank", "number", "item", "title", "short", "last", "text", "run")
SYMBOLS = len(PLACES) * len(FORMS) * 8


def symbol(place: str, form: str, again: bool, apart: bool, breaks: bool) -> int:
    return (PLACES.index(place) * len(FORMS) + FORMS.index(form)) * 8 + again * 4 + apart * 2 + breaks


#: Place, form, recurrence, apartness and break of every symbol.
FEATURES = np.array([[w // 8 // len(FORMS), w // 8 % len(FORMS), w // 4 % 2, w // 2 % 2, w % 2] for w in range(SYMBOLS)])


def line_features(pages: list[str | None], paged: bool) -> list[tuple[int, int, str, int, int]]:
    """(page index, line number, text, symbol, seed) of every line of a result.

    The symbol joins five features of layout: place on the page, form, whether the line recurs in the result, whether it
    stands apart, whether it breaks into a sentence. The seed is the place in STATES of what a line plainly is, or -1:
    a number alone at the edge of a page, a recurring title at the edge, an item, running text in the middle. It says
    nothing of all other lines.
    """
    split = [(t or "").split("\n") for t in pages]
    fold = {x: _fold(x) for lines in split for x in lines}
    folds = Counter(f for lines in split for f in ({fold[x] for x in lines} if paged else [fold[x] for x in lines]) if len(f) >= 3)
    widths = sorted(len(x.strip()) for lines in split for x in lines if x.strip())
    width = widths[int(len(widths) * 0.9)] if widths else 0
    out = []
    for p, lines in enumerate(split):
        bare_lines = [x.strip() for x in lines]
        full = [i for i, s in enumerate(bare_lines) if s]
        edge = {**dict.fromkeys(full[1:2] + full[-2:-1], "second"), **({full[-1]: "end", full[0]: "top"} if full else {})}
        for k, i in enumerate(full):
            x, s = lines[i], bare_lines[i]
            place = "any" if not paged else edge.get(i, "mid")
            before, after = bare_lines[full[k - 1]] if k else "", bare_lines[full[k + 1]] if k + 1 < len(full) else ""
            ended, lower = s[-1] in ".;:!?。", s[0].islower()
            apart = (i + 1 < len(lines) and not bare_lines[i + 1]) or (i > 0 and not bare_lines[i - 1]) or x[:3] == "   " or bool(_GAP.search(s))
            again = folds[fold[x]] >= 2 and s[-1] != "."
            bare = _SIDE_NUMBER.sub("", s)
            open_end = not ended and not lower and s[-1] not in CUT + ","
            if PAGE_NUMBER.match(s):
                form = "number"
            elif bare == s and NUMBERED.match(bare):
                form = "item"
            elif open_end and len(bare) < 0.95 * width + 20 and _title_like(bare) and not _SAYS.search(bare):
                form = "title"
            elif open_end and len(bare) < 0.62 * width:
                form = "short"
            elif lower:
                form = "run"
            elif ended and len(s) < 0.8 * width:
                form = "last"
            else:
                form = "text"
            breaks = form in ("title", "short", "number") and bool(before) and before[-1] not in ".;:!?。" and bool(after) and after[0].islower()
            seed = -1
            if form == "number" and place in ("top", "end", "any"):
                seed = NUMBER
            elif form in ("title", "short") and again and (place in ("top", "end") or place == "any" and breaks):
                seed = HEAD
            elif form == "item" or form == "text" and (not again or place in ("mid", "second") and bool(after) and after[0].islower()) and (not before or place == "second" and bool(after) and after[0].islower() or before[-1] in ".;:!?。"):
                seed = START
            elif form in ("run", "last") or form == "number" and place == "mid":
                seed = MORE
            out.append((p, i + 1, x, symbol(place, form, again, apart, breaks), seed))
        out += [(p, i + 1, x, symbol("mid", "blank", False, False, False), BLANK) for i, x in enumerate(lines) if not bare_lines[i]]
    return sorted(out, key=lambda r: r[:2])


class Model(NamedTuple):
    """A hidden Markov model of lines: probabilities of the first state, of moves and of symbols by state."""

    first: np.ndarray
    move: np.ndarray
    show: np.ndarray


def _padded(pages: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Pages of like length together, (their places, lines × pages of line numbers, mask), no more than 65,536 cells or one page at once."""
    order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        longest, k = 0, at
        while k < len(order) and max(longest, len(pages[order[k]])) * (k + 1 - at) <= 65_536 or k == at:
            longest = max(longest, len(pages[order[k]]))
            k += 1
        some = order[at:k]
        where = np.zeros((longest, len(some)), dtype=np.int64)
        mask = np.zeros((longest, len(some)), dtype=bool)
        for j, i in enumerate(some):
            where[: len(pages[i]), j] = pages[i]
            mask[: len(pages[i]), j] = True
        yield some, where, mask
        at = k


def seed_counts(symbols: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """What the seeds alone say of symbols by state, as counts; of moves they say nothing."""
    s = len(STATES)
    show = np.zeros((s, SYMBOLS))
    np.add.at(show, (seeds[seeds >= 0], symbols[seeds >= 0]), 1.0)
    return np.concatenate([np.zeros(s + s * s), show.ravel()])


def expected_counts(pages: list[np.ndarray], symbols: np.ndarray, seeds: np.ndarray, model: Model, trust: float) -> tuple[np.ndarray, float]:
    """One forward-backward pass: expected counts (first, moves, symbols by state; flat) and the log likelihood.

    Seeds are weak: they divide the odds of the other states by `trust`, no more.
    """
    s = len(STATES)
    first, move, show, total = np.zeros(s), np.zeros((s, s)), np.zeros((s, SYMBOLS)), 0.0
    says = np.ones((s + 1, s))
    says[:s] = 1.0 / trust
    says[np.arange(s), np.arange(s)] = 1.0
    for _, where, mask in _padded(pages):
        length, n = where.shape
        if not length:
            continue
        codes = symbols[where]
        e = model.show.T[codes] * says[seeds[where]]  # lines × pages × states
        alpha, scale = np.empty((length, n, s)), np.ones((length, n))
        for t in range(length):
            a = (model.first if t == 0 else alpha[t - 1] @ model.move) * e[t]
            c = a.sum(1)
            on = mask[t]
            alpha[t] = np.where(on[:, None], a / np.where(c > 0, c, 1.0)[:, None], alpha[t - 1] if t else 0.0)
            scale[t] = np.where(on & (c > 0), c, 1.0)
        beta = np.ones((n, s))
        for t in range(length - 1, -1, -1):
            gamma = alpha[t] * beta
            gamma = np.where(mask[t][:, None], gamma / np.maximum(gamma.sum(1, keepdims=True), 1e-300), 0.0)
            np.add.at(show.T, codes[t], gamma)
            if t == 0:
                first += gamma.sum(0)
                break
            ahead = np.where(mask[t][:, None], e[t] * beta / scale[t][:, None], 0.0)
            move += (alpha[t - 1].T @ ahead) * model.move
            beta = np.where(mask[t][:, None], ahead @ model.move.T, beta)
        total += float(np.log(scale).sum())
    return np.concatenate([first, move.ravel(), show.ravel()]), total


def fit_model(counts: np.ndarray, joint: float = 200.0) -> Model:
    """Probabilities from expected counts, with a little added to each.

    A symbol's probability in a state is that of its five features on their own; the more lines of the state have the
    symbol (`joint` of them count half), the more its own share counts.
    """
    s = len(STATES)
    first, move, show = counts[:s] + 0.5, counts[s : s + s * s].reshape(s, s) + 0.5, counts[s + s * s :].reshape(s, SYMBOLS)
    free = np.ones((s, SYMBOLS))
    for values in FEATURES.T:
        each = np.stack([show[:, values == v].sum(1) for v in range(values.max() + 1)], 1) + 0.05
        free *= (each / each.sum(1, keepdims=True))[:, values]
    free /= free.sum(1, keepdims=True)
    own = show + joint * free
    return Model(first / first.sum(), move / move.sum(1, keepdims=True), own / own.sum(1, keepdims=True))


def viterbi(pages: list[np.ndarray], symbols: np.ndarray, model: Model) -> np.ndarray:
    """The likeliest state of every line, page by page."""
    out = np.zeros(len(symbols), dtype=np.int64)
    first, move, show = (np.log(x) for x in model)
    for _, where, mask in _padded(pages):
        length, n = where.shape
        if not length:
            continue
        e = show.T[symbols[where]]
        best, back = first + e[0], np.zeros((length, n, len(STATES)), dtype=np.int8)
        for t in range(1, length):
            step = best[:, :, None] + move
            back[t] = step.argmax(1)
            best = np.where(mask[t][:, None], step.max(1) + e[t], best)
        state = best.argmax(1)
        for t in range(length - 1, -1, -1):
            out[where[t][mask[t]]] = state[mask[t]]
            state = np.where(mask[t], back[t][np.arange(n), state], state)
    return out


def _pages(pages, text) -> tuple[list[int], list[str | None], bool]:
    if pages is not None and len(pages):
        return [int(p["page"]) if p["page"] is not None else 0 for p in pages], [p["text"] for p in pages], True
    return [0], [text], False


FEATURED = {"p": pa.int32(), "page": pa.int32(), "n": pa.int32(), "text": pa.string(), "symbol": pa.int32(), "seed": pa.int32()}


def featured_lines(scans: DataFrame, id_col: str) -> DataFrame:
    """(id, p, page, n, text, symbol, seed) of each result, parallel arrays with a place for each line: page index, page,
    number, text, symbol and seed; found once and written."""
    kind = scans.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            cols: dict[str, list] = {c: [] for c in FEATURED}
            for pages, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                numbers, texts, paged = _pages(pages, text)
                rows = line_features(texts, paged) if paged or text else []
                for c, v in zip(FEATURED, zip(*((p, numbers[p], n, t, w, s) for p, n, t, w, s in rows)) if rows else [()] * len(FEATURED)):
                    cols[c].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cols[c], pa.list_(k)) for c, k in FEATURED.items())], names=[id_col, *FEATURED])

    schema = ", ".join(f"{c} array<{'string' if c == 'text' else 'int'}>" for c in FEATURED)
    return materialize(spread(scans.select(F.col(f"`{id_col}`"), "pages", "text")).mapInArrow(run, f"`{id_col}` {kind}, {schema}"), "p7-features")


def _sequences(result: pa.ListArray, page_index: np.ndarray) -> list[np.ndarray]:
    """Where the lines of each page of a batch lie: a page is a stretch of one result and one page index."""
    offsets, p = result.offsets.to_numpy(), page_index
    return [part for a, z in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0]) if z > a for part in np.split(np.arange(a, z), np.flatnonzero(np.diff(p[a:z])) + 1)]


def train(featured: DataFrame, rounds: int = 12, trust: float = 100.0, least_gain: float = 2e-3) -> Model:
    """The line model, fitted on all lines by expectation-maximisation from weak seeds.

    Each round is one forward-backward pass over all pages; only sums leave the executors, a row of one size for each
    task whatever the number of pages. Rounds end when the mean log likelihood of a line gains less than `least_gain`,
    or after `rounds`: what is gained after that is gained by giving states other meanings than the seeds gave them.
    """
    src = featured.select("p", "symbol", "seed")
    model: Model | None = None  # at first there are only the seeds
    last = -math.inf
    for _ in range(rounds + 1):
        now = model

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total, like, lines = np.zeros(len(STATES) * (1 + len(STATES) + SYMBOLS)), 0.0, 0
            for b in batches:
                p, w, s = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(3))
                counts, more = expected_counts(_sequences(b.column(0), p), w, s, now, trust) if now else (seed_counts(w, s), -math.inf)
                total, like, lines = total + counts, like + more, lines + len(w)
            yield pa.RecordBatch.from_arrays([pa.array([[*total.tolist(), like, float(lines)]], pa.list_(pa.float64()))], names=["counts"])

        sums = src.mapInArrow(run, "counts array<double>").select(F.posexplode("counts").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        if not sums:
            break
        counts = np.zeros(1 + max(r["i"] for r in sums))
        counts[[r["i"] for r in sums]] = [r["v"] for r in sums]
        *counts, like, lines = counts
        if not lines:
            break
        model = fit_model(np.array(counts))
        if now and like / lines - last < least_gain:
            break
        last = like / lines
    return model if model is not None else fit_model(np.zeros(len(STATES) * (1 + len(STATES) + SYMBOLS)))


_STRIP = ".,;:«»“”\"?[]{}–—'’‘"
_PIECE = re.compile("[^-‐‑/]+")
_OWN_HYPHEN = re.compile("[^\\W\\d_]+(?:[-‐‑][^\\W\\d_]+)+")


def _inner(t: str, chars: str) -> tuple[int, str]:
    """What is left of a string without these characters at its ends, and where it begins."""
    u = t.lstrip(chars)
    return len(t) - len(u), u.rstrip(chars)


@functools.lru_cache(maxsize=1 << 18)
def _token_words(t: str) -> tuple[tuple[str, int], ...]:
    """The words in a token between blanks, and where they begin in it."""
    out = []
    at, t = _inner(t, _STRIP)
    if ")" in t or t.startswith("(") and len(t) < 4:
        k, t = _inner(t, "()")
        at += k
    for q in _PIECE.finditer(t):
        k, w = _inner(q[0], _STRIP + ")")
        letters = sum(map(str.isalpha, w))
        if letters >= 2 and letters * 2 >= len(w):
            out.append((w, at + q.start() + k))
    return tuple(out)


def _tokens(line: str) -> list[tuple[str, int]]:
    """(word, place) of a line, lower-case, with characters a scan may have put into them; words of too few letters are left out."""
    low = line.lower()
    if len(low) != len(line):  # a letter whose small form is longer: places are those of the line as it stands
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in line)
    out, at = [], 0
    for t in low.split():
        at = low.index(t, at)
        out += [(w, at + k) for w, k in _token_words(t)]
        at += len(t)
    return out


LINES = (
    "page int, line_no int, state string, text string, words array<struct<word: string, at: int>>, compounds array<string>, "
    "cut struct<mark: string, left: string, right: string, at: int, page: int, line_no: int, lead: int>"
)


def read_lines(featured: DataFrame, id_col: str, model: Model) -> DataFrame:
    """One row for each line: (id, page, line_no, state, text, words, compounds, cut).

    `words` are the whole words of a line that is neither head nor number, with their places, without a word cut at its
    ends; `compounds` are words with a hyphen of their own within the line; `cut` tells of a word cut at the end: its
    mark, its halves, where the first half begins, the line of the second half, which may follow on another page after
    heads, numbers and blank lines, and where that half begins in it.
    """
    kind = featured.schema[id_col].dataType.simpleString()
    cut_type = pa.struct([("mark", pa.string()), ("left", pa.string()), ("right", pa.string()), ("at", pa.int32()), ("page", pa.int32()), ("line_no", pa.int32()), ("lead", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            p, page, n, symbols = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3, 5))
            texts = b.column(4).flatten().to_pylist()
            states = viterbi(_sequences(b.column(1), p), symbols, model)
            offsets = b.column(1).offsets.to_numpy() - b.column(1).offsets[0].as_py()
            words: list = [[]] * len(texts)
            compounds: list = [[]] * len(texts)
            cuts: list = [None] * len(texts)
            for a, z in zip(offsets[:-1], offsets[1:]):
                body = [i for i in range(a, z) if states[i] in (START, MORE)]
                taken: dict[int, int] = {}
                for i, j in zip(body, body[1:]):
                    x, y = texts[i].rstrip(), texts[j].lstrip()
                    if x and x[-1] in CUT and (m := re.search(r"(\S+)$", x[:-1])) and y and y[0].isalpha() and m[1][-1].isalpha():
                        right = re.match(r"\S+", y)[0]
                        k, left = _inner(m[1].lower(), "") if m[1][0] not in _STRIP + "(" else (len(m[1]) - len(m[1].lstrip(_STRIP + "(")), m[1].lower().lstrip(_STRIP + "("))
                        lead = len(texts[j]) - len(y)
                        cuts[i] = {"mark": x[-1], "left": left, "right": right.lower().rstrip(_STRIP + ")"), "at": m.start(1) + k, "page": page[j], "line_no": n[j], "lead": lead}
                        taken[j] = lead + len(right)
                for i in body:
                    found = _tokens(texts[i])
                    if i in taken:
                        found = [w for w in found if w[1] >= taken[i]]
                    if cuts[i]:
                        found = [w for w in found if w[1] + len(w[0]) <= cuts[i]["at"]]
                    words[i] = found
                    if any(h in texts[i] for h in "-‐‑"):
                        s = texts[i][taken.get(i, 0) : cuts[i]["at"] if cuts[i] else None]
                        compounds[i] = [t for t in (w.strip(_STRIP + "()") for w in s.lower().split()) if _OWN_HYPHEN.fullmatch(t)]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(b)), np.diff(offsets))))
            cols = [ids, pa.array(page, pa.int32()), pa.array(n, pa.int32()), pa.array([STATES[s] for s in states], pa.string()), pa.array(texts, pa.string())]
            flat = [w for line in words for w in line]
            said = pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.string()), pa.array([at for _, at in flat], pa.int32())], names=["word", "at"])
            held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(line) for line in words])]), pa.int32()), said)
            yield pa.RecordBatch.from_arrays([*cols, held, pa.array(compounds, pa.list_(pa.string())), pa.array(cuts, cut_type)], names=[id_col, "page", "line_no", "state", "text", "words", "compounds", "cut"])

    return featured.select(F.col(f"`{id_col}`"), "p", "page", "n", "text", "symbol").mapInArrow(run, f"`{id_col}` {kind}, {LINES}")


_ODD = re.compile(r"(?<=[^\W\d_])[\d@!(|$ſ]|[\d@!(|$ſ](?=[^\W\d_])")


def _odd(word: str) -> list[int]:
    """Where a word holds a character that no word has; a bracket may open before it."""
    return [m.start() for m in _ODD.finditer(word) if m.start() or word[0] != "("]


def candidates(word: str) -> dict[str, int]:
    """What a word may have been, and where it differs first: one character or group put back to what scans are known to
    misread. A word that holds a character that no word has must lose it: with one such character another place may be put
    back too, with two both are, and with more it is beyond repair."""

    def once(w: str, places) -> dict[str, int]:
        out: dict[str, int] = {}
        for i in places:
            for size in (1, 2):
                for right in MISREAD.get(w[i : i + size], ()) if i + size <= len(w) else ():
                    out.setdefault(w[:i] + right + w[i + size :], i)
        return out

    odd = _odd(word)
    if len(odd) > 2:
        return {}
    if not odd:
        out = once(word, range(len(word)))
    else:
        out = {}
        for w, i in once(word, odd).items():
            left = _odd(w)
            if not left:
                out.setdefault(w, i)
            for v, j in once(w, left or range(len(w))).items():
                out.setdefault(v, min(i, j))
    out.pop(word, None)
    return out


def corrections(counted: DataFrame, ratio: float = 4.0) -> DataFrame:
    """(word, right, at): misread words and what they are, from counts of words (word, n) over the whole corpus.

    Each word's `candidates` meet the words in an equi-join; nothing is compared in pairs. It is a misreading if a
    candidate is a word at least `ratio` times as frequent, and the most frequent of its kind. Words of two letters are
    not tried: one changed letter of two leaves nothing to know them by.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(w, n, v, i) for w, n in zip(f["word"], f["n"]) for v, i in candidates(w).items()]
            yield pd.DataFrame(rows, columns=["word", "n", "right", "at"])

    tried = counted.where("length(word) >= 3").mapInPandas(run, "word string, n long, right string, at int")
    known = counted.select(F.col("word").alias("right"), F.col("n").alias("m"))
    hit = tried.join(known, "right").where((F.col("m") >= F.greatest(F.lit(3.0), F.col("n") * ratio)))
    best = hit.groupBy("word").agg(F.max_by(F.struct("right", "at"), F.struct("m", "right")).alias("b"))
    return best.select("word", "b.right", "b.at")


def read_scans(scans: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, cuts, misread words by line) of all results, each once computed and written.

    lines as `read_lines`; cuts has (id, page, line_no, joined, cut); misread has (id, page, line_no, word, right, at,
    joined): the place of the word in its line, and whether it was cut, when its line is that of the half which is
    misread. Null and empty texts and blank pages have no findings; if `pages` is null or empty the text is page 0.
    """
    featured = featured_lines(scans, id_col)
    lines = materialize(read_lines(featured, id_col, train(featured)), "p7-lines")
    compounds = lines.select(F.explode("compounds").alias("c")).groupBy("c").count().where("count >= 2").select("c", F.col("count").alias("n_own"))
    inside = lines.select(id_col, "page", "line_no", F.explode("words").alias("w")).select(id_col, "page", "line_no", "w.word", F.col("w.at").alias("place"), F.lit(None).cast("int").alias("left"), F.lit(None).cast("struct<page:int,line_no:int>").alias("next"))
    plain = inside.groupBy("word").agg(F.count("*").alias("n"))
    cut = lines.where("cut is not null").select(id_col, "page", "line_no", "cut").withColumn("c", F.concat("cut.left", F.lit("-"), "cut.right")).withColumn("word", F.concat("cut.left", "cut.right"))
    joined = cut.join(compounds, "c", "left").join(plain, "word", "left")
    own = (F.col("cut.mark").isin("-", "‑")) & (F.coalesce("n_own", F.lit(0)) > F.coalesce("n", F.lit(0)))
    cuts = materialize(joined.where(~own).select(id_col, "page", "line_no", "word", "cut"), "p7-cuts")
    halves = cuts.select(id_col, "page", "line_no", "word", F.col("cut.at").alias("place"), F.length("cut.left").alias("left"), F.struct("cut.page", "cut.line_no").alias("next"))
    words = inside.unionByName(halves.where(~F.col("word").contains("-")))
    fixes = corrections(words.groupBy("word").agg(F.count("*").alias("n")))
    found = words.join(fixes, "word")
    second = F.col("left").isNotNull() & (F.col("at") >= F.col("left"))
    misread = found.select(
        id_col, F.when(second, F.col("next.page")).otherwise(F.col("page")).alias("page"), F.when(second, F.col("next.line_no")).otherwise(F.col("line_no")).alias("line_no"),
        "word", "right", F.col("place").alias("at"), F.col("left").isNotNull().alias("joined"),
    )
    return lines, cuts.select(id_col, "page", "line_no", F.col("word").alias("joined"), "cut"), misread


def line_findings(scans: DataFrame, id_col: str) -> DataFrame:
    """(id, page, line_no, kind): lines that are `header` or `page_no`, end in a cut word (`hyphen`) or hold a `misread` word."""
    lines, cuts, misread = read_scans(scans, id_col)
    head = lines.where("state in ('head', 'number')").select(id_col, "page", "line_no", F.when(F.col("state") == "head", "header").otherwise("page_no").alias("kind"))
    out = head.unionByName(cuts.select(id_col, "page", "line_no", F.lit("hyphen").alias("kind"))).unionByName(misread.select(id_col, "page", "line_no", F.lit("misread").alias("kind")))
    return out.distinct()


def paragraphs(scans: DataFrame, id_col: str) -> DataFrame:
    """(id, paragraph, text): the continuous text of each result, paragraph by paragraph.

    Heads, page numbers and blank lines are gone; a cut word stands whole where it began; misread words are put right
    where they stand, in capitals where they had them; a paragraph that a page break cut is one.
    """
    lines, cuts, misread = read_scans(scans, id_col)
    key = [id_col, "page", "line_no"]
    right = misread.select("word", "right").distinct()
    # every repair replaces `size` characters from `at`; the second half of a cut word is replaced by nothing
    inside = misread.where("not joined").select(*key, "at", F.length("word").alias("size"), "right", F.lit(False).alias("cut"))
    whole = cuts.join(right, cuts["joined"] == right["word"], "left").select(*key, F.col("cut.at").alias("at"), F.lit(1 << 30).alias("size"), F.coalesce("right", "joined").alias("right"), F.lit(True).alias("cut"))
    rest = cuts.select(id_col, F.col("cut.page").alias("page"), F.col("cut.line_no").alias("line_no"), F.col("cut.lead").alias("at"), F.length("cut.right").alias("size"), F.lit("").alias("right"), F.lit(False).alias("cut"))
    repairs = inside.unionByName(whole).unionByName(rest).groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("at", "size", "right", "cut")), asc=False).alias("repairs"))
    body = lines.where("state in ('start', 'more')").join(repairs, key, "left")

    def repair(t, r):
        old = F.substring(t, r["at"] + 1, r["size"])
        word = F.regexp_replace(old, "[-‐‑¬­\\s]+$", "")
        letter = F.substring(word, 1, 1)
        high = (word == F.upper(word)) & (F.length(word) > 1)
        new = F.when(high & (word != F.lower(word)), F.upper(r["right"])).when(letter != F.lower(letter), F.concat(F.upper(F.substring(r["right"], 1, 1)), F.substring(r["right"], F.lit(2), F.lit(1 << 30)))).otherwise(r["right"])
        return F.concat(F.substring(t, F.lit(1), r["at"]), new, F.substring(t, r["at"] + r["size"] + 1, F.lit(1 << 30)))

    none = F.array().cast("array<struct<at:int,size:int,right:string,cut:boolean>>")
    repaired = F.trim(F.aggregate(F.coalesce("repairs", none), F.col("text"), repair))
    w = Window.partitionBy(id_col).orderBy("page", "line_no")
    numbered = body.withColumn("paragraph", F.sum((F.col("state") == "start").cast("int")).over(w)).withColumn("line", repaired)
    return numbered.groupBy(id_col, "paragraph").agg(F.trim(F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "line_no", "line"))), lambda s: s["line"]), " "), " +", " ")).alias("text"))

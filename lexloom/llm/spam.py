"""Pages of repeated keywords, links or product tags: found by the shapes of their lines.

Every line is reduced to a shape; the shapes of all pages are grouped, and a group tells by the company it keeps whether
it is the shape of a page without sentences. A page that few such shapes dominate is reported.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import materialize, small_batches, spread

URL = re.compile(r"https?://\S+|(?<![\w.])[^\W\d_A-Z][\w-]*+\.(?:[^\W\d_A-Z][\w-]*\.)*[a-z]{2,}(?:/\S*)?(?![\w.])")
DOT = re.compile(r"\.[a-z]{2}")  # every link without a scheme has it
SEPARATOR = re.compile(r"\s+(?:[|·»•*/→~–—]|>>)\s+|\s{2,}|\t")
SEMICOLON = re.compile(r"\s*[;；]\s*")
COMMA = re.compile(r"\s*[,;，、；]\s*")
NUMBER_LED = re.compile(r"^\W*(?:\d[\d/.,]*|[a-zA-Z]|Q\d+|[ivxIVX]+)[.)\]:/|]*\s+\S")
NUMBER_ENDED = re.compile(r"(?:\.{4,}|[^\d(\s]\s*[,.\s]\s*\d{1,4}(?:, ?\d{1,4})*)\W?$")
AMOUNT = re.compile(r"[$€£¥]\s?\d|\b\d+\.\d\d\b")
COUNTED = re.compile(r"\(\d+\)")
SENTENCE_END = re.compile(r"[.!?](?=\s|$)|[。！？]")
WORD = re.compile(r"[^\W\d_]+")
HAN = re.compile("[㐀-鿿]")

#: Forms of lines that real texts have: sentences, and entries led or ended by numbers (contents, indexes, registers, clauses).
REAL = ("sentence", "entry")
#: The end of the shapes of keywords that their page does not repeat.
UNREPEATED = ", none repeat"
#: Characters of sentences that every shape is granted before its company is judged.
DOUBT = 100


def words(text: str) -> list[str]:
    """Lower-case words; runs of Chinese characters count as their overlapping pairs."""
    found = WORD.findall(text.lower())
    if text.isascii() or not HAN.search(text):
        return found
    out = []
    for w in found:
        if HAN.match(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w)
    return out


def _bucket(n: int) -> str:
    return "0" if n == 0 else "1" if n == 1 else "2-4" if n < 5 else "5-9" if n < 10 else "10-19" if n < 20 else "20+"


def _segments(text: str) -> Iterator[tuple[str, bool]]:
    """Lines; a line that is no list entry or sentence falls apart at its separators. (segment, whether number-led)."""
    for line in text.splitlines():
        line = line.strip()
        if not line:
            continue
        if NUMBER_LED.match(line):
            yield line, True
            continue
        for part in SEPARATOR.split(line):
            if not part:
                continue
            cut = SEMICOLON if part.count(";") + part.count("；") > 1 else COMMA if len(part) > 60 and len(COMMA.findall(part)) * 40 > len(part) else None
            if cut and SENTENCE_END.search(URL.sub("", part)):
                cut = None
            yield from ((p, False) for p in (cut.split(part) if cut else [part]) if p)


def _form(seg: str, led: bool, linked: bool) -> tuple[str, int, list[str]]:
    """(form, links, words without links) of a segment, from its layout alone; `linked` is false if its page has no link."""
    links = len(URL.findall(seg)) if linked else 0
    rest = URL.sub(" ", seg) if links else seg
    w = words(rest)
    if links and len(w) <= (2 if led else 7):
        return "link", links, w
    if led:
        return "entry", links, w
    if seg[0] == "#" and len(w) <= 3 or "#" in seg and seg.count("#") * 4 >= len(w):
        return "tag", links, w
    if AMOUNT.search(rest) and len(w) <= 12:
        return "product", links, w
    counted = len(COUNTED.findall(rest))
    if counted and counted * 4 >= len(w):
        return "counted", links, w
    if (any(map(str.isdigit, rest[-2:])) or "...." in rest[-5:]) and NUMBER_ENDED.search(rest):
        return "entry", links, w
    if len(w) >= 5 and SENTENCE_END.search(rest):
        return "sentence", links, w
    return "keyword", links, w


def _stuffing(sentences: list[list[str]]) -> set[tuple[str, str]] | None:
    """The pairs of words that fill a fifth of all the sentences they are in; None: all are stuffed, for there are hardly any words."""
    said = [x for w in sentences for x in w]
    if len(said) >= 40 and len(set(said)) <= min(40, 0.3 * len(said)):
        return None
    if len(sentences) < 4 and len(said) < 40:
        return set()
    times = Counter(p for w in sentences for p in zip(w, w[1:]))
    held: dict[tuple[str, str], int] = defaultdict(int)
    for w in sentences:
        for p in set(zip(w, w[1:])):
            held[p] += len(w)
    return {p for p, n in times.items() if n >= 5 and 2 * n >= 0.2 * held[p]}


def page_shapes(text: str | None) -> tuple[float, list[tuple[str, str, int]]]:
    """(share of non-sentence shapes, [(shape, form, characters)]) of a page by itself.

    A shape is the form of a segment with classes of its number of words, of capitals, separators and links, and of how
    far its words repeat over the page: none, some or most of a keyword segment's words; whether a pair of words that
    fills a fifth of all its sentences is in a sentence (`stuffed`). By itself a page's keywords count where they repeat.
    A null, empty or blank text has share 0.
    """
    found: list[tuple[str, str, int, list[str]]] = []
    linked = text is not None and ("://" in text or DOT.search(text) is not None)
    for seg, led in _segments(text or ""):
        form, links, w = _form(seg, led, linked)
        caps = sum(map(str.isupper, seg))
        shape = f"{_bucket(len(w))} words, {'all' if caps * 2 > len(seg) else 'some' if caps > 1 else 'few'} capitals, {'separated' if led and SEPARATOR.search(seg) else 'plain'}, {_bucket(links)} links"
        found.append((shape, form, len(seg), w))
    total = sum(n for _, _, n, _ in found)
    if not total:
        return 0.0, []
    often = Counter(x for _, f, _, w in found if f == "keyword" for x in w)
    stuffing = _stuffing([w for _, f, _, w in found if f == "sentence"])
    out, bad = [], 0
    for shape, form, n, w in found:
        echo = ""
        if form == "keyword":
            again = sum(often[x] > 1 for x in w)
            echo = UNREPEATED if again * 3 <= len(w) else ", some repeat" if again * 3 <= 2 * len(w) else ", most repeat"
        elif form == "sentence" and (stuffing is None or stuffing and any(p in stuffing for p in zip(w, w[1:]))):
            form = "stuffed"
        if form not in REAL and echo != UNREPEATED:
            bad += n
        out.append((shape + echo, form, n))
    return bad / total, out


def shape_pages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, share, sentences, shapes): for every row the share of characters in non-sentence shapes by itself, that in
    sentences, and its shapes.

    `shapes` is an array of (shape, form, segments, chars), the largest first. Null ids and repeated rows stay. Narrow.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, share double, sentences double, shapes array<struct<shape: string, form: string, segments: int, chars: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([("shape", pa.string()), ("form", pa.string()), ("segments", pa.int32()), ("chars", pa.int32())]))
        for b in small_batches(batches, 1024):
            shares, sentences, shapes = [], [], []
            for t in b.column(1).to_pylist():
                share, found = page_shapes(t)
                n, chars = Counter((s, f) for s, f, _ in found), Counter()
                for s, f, c in found:
                    chars[s, f] += c
                shares.append(share)
                sentences.append(sum(c for (_, f), c in chars.items() if f == "sentence") / max(1, sum(chars.values())))
                shapes.append([{"shape": s, "form": f, "segments": n[s, f], "chars": c} for (s, f), c in chars.most_common()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shares, pa.float64()), pa.array(sentences, pa.float64()), pa.array(shapes, struct)], names=[id_col, "share", "sentences", "shapes"])

    return spread(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("_text"))).mapInArrow(run, schema)


def shape_groups(pages: DataFrame) -> DataFrame:
    """(form, shape, pages, segments, chars, company): the shapes of all pages of `shape_pages`.

    `company` is the mean share of sentences in the pages where a shape occurs, weighted by its characters: headings
    keep the company of sentences, keywords and tags don't. There are at most as many groups as combinations of classes
    (under 3,000), whatever the number of pages; sums are made on the map side first.
    """
    one = pages.select("sentences", F.explode("shapes").alias("s"))
    groups = one.groupBy("s.form", "s.shape").agg(F.count("*").alias("pages"), F.sum("s.segments").alias("segments"), F.sum("s.chars").alias("chars"), F.sum(F.col("s.chars") * F.col("sentences")).alias("beside"))
    return groups.select("form", "shape", "pages", "segments", "chars", (F.col("beside") / F.col("chars")).alias("company"))


def spam_pages(docs: DataFrame, id_col: str, text_col: str, share: float = 0.5, few: int = 6, company: float = 0.5) -> DataFrame:
    """(id, share): pages of which the largest `few` non-sentence shapes hold more than `share` of the characters.

    Non-sentence are the shapes that are neither sentences nor entries and whose company over the whole corpus is under
    `company`, DOUBT characters of sentences being added to each: of a shape that hardly occurs nothing is said. Whole
    texts, every page; duplicated texts are judged alike. The groups reach the pages as one small array.
    """
    pages = materialize(shape_pages(docs, id_col, text_col), "p10-shapes")
    known = (F.col("company") * F.col("chars") + DOUBT) / (F.col("chars") + DOUBT)
    odd = shape_groups(pages).where(~F.col("form").isin(*REAL) & (known < company)).agg(F.collect_set(F.concat_ws(": ", "form", "shape")).alias("odd"))
    seen = pages.withColumn("odd", odd.scalar())
    bad = F.filter("shapes", lambda s: F.array_contains("odd", F.concat_ws(": ", s["form"], s["shape"])))
    total = F.aggregate("shapes", F.lit(0), lambda a, s: a + s["chars"])
    top = F.aggregate(F.slice(bad, 1, few), F.lit(0), lambda a, s: a + s["chars"])
    return seen.select(id_col, (top / F.greatest(total, F.lit(1))).alias("share")).where(F.col("share") > share)

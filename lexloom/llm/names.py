"""Linking names as people type them to the entities of a catalogue."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.lookalike import _replacement
from lexloom.session import materialize

# Words that carry no identity, and short forms that no rule of abbreviation gives.
FILLER = set("the on of in as force and for to a an tentang nomor no tahun thn th goda god g ot o ob s nam n ve du cua va 关于 的 года год г от о об с".split())
SHORT = {"uu": "undang undang", "pp": "peraturan pemerintah", "nd": "nghi dinh", "amdt": "amendment", "amendt": "amendment", "amend": "amendment"}
YEAR = re.compile(r"(?<!\d)(1[89]\d\d|20\d\d)(?!\d)")
SHORT_YEAR = re.compile(r"['’‘]\s?(\d\d)(?!\d)")
NUMBER = re.compile(r"(?:\b(?:act|no\.?|nomor|cap\.?|number)|№|第)\s*(\d{1,4})(?!\d)\s*号?", re.I)
HAN = re.compile("[㐀-鿿]")
CYRILLIC = re.compile("[Ѐ-ӿ]")


def _visible(ch: str) -> str:
    return ch if _same(ch) else ""


@functools.cache
def _same(ch: str) -> str:
    return _replacement(ch)


def fold(name: str, simpler: dict[int, str] | None = None) -> str:
    """A name in lower case without accents, invisible characters, widths and look-alikes; Chinese in simplified form."""
    # capitals of one script look like small letters of no other: a Cyrillic name is put in lower case first
    seen = "".join(map(_visible, name))
    letters = sum(c.isalpha() for c in seen)
    s = "".join(map(_same, seen.lower() if 2 * len(CYRILLIC.findall(seen)) > letters else seen))
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D")
    return " ".join((s.translate(simpler) if simpler else s).split())


FILLER |= {fold(w).lower() for w in FILLER}
LONG_FILLER = [w for w in FILLER if len(w) >= 4]


class Name:
    """What identifies a name: its words without fillers, its year, its number."""

    __slots__ = ("initials", "number", "text", "words", "year")

    def __init__(self, name: str, simpler: dict[int, str] | None = None):
        s = fold(name, simpler)
        self.number = None
        if m := list(NUMBER.finditer(s)):
            years = len(YEAR.findall(s))
            for x in m:
                if not YEAR.fullmatch(x[1]) or years > 1:
                    self.number = x[1]
                    s = s[: x.start()] + (" act " if x[0].lower().startswith("act") and not years and not re.search(r"\bact\b", s[: x.start()], re.I) else " ") + s[x.end() :]
                    break
        y = YEAR.search(s)
        self.year = int(y[1]) if y else None
        if y:
            s = s[: y.start()] + " " + s[y.end() :]
        elif m2 := SHORT_YEAR.search(s):
            self.year = -int(m2[1]) - 1  # the century is open
            s = s[: m2.start()] + " " + s[m2.end() :]
        caps = re.findall(r"\b(?:[A-Z]\.?){2,}(?![a-z])", s)
        self.initials = re.sub(r"\W", "", caps[0]).lower() if len(caps) == 1 and len(re.findall(r"[^\W\d_]+", s.replace(caps[0], ""))) == 0 else None
        low = s.lower()
        if HAN.search(low):
            low = re.sub(r"关于|的|\W|年|\d+", "", low)
            self.words = [low] if low else []
        else:
            low = re.sub(r"\b(\w)-(\w)\b", r"\1\2", low)
            out: list[str] = []
            for w in re.findall(r"[^\W_]+", low):
                out += SHORT.get(w, w).split()
            self.words = [w for w in out if w not in FILLER and not (w.isdigit())]
        self.text = " ".join(self.words)


def grams(words: list[str], n: int = 3) -> list[str]:
    """Character n-grams of the words, each framed, so that the order of words does not matter; pairs in Chinese."""
    out = []
    for w in words:
        if HAN.search(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        else:
            f = f"^{w}$"
            out += [f[i : i + n] for i in range(max(1, len(f) - n + 1))]
    return out


def _edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            c = min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, before[j - 2] + 1)
            cur.append(c)
        before, prev = prev, cur
    return prev[-1]


def _short_for(a: str, b: str) -> bool:
    """Whether `a` may be short for `b`: the same first letter, and its letters in order in `b`."""
    if len(a) >= len(b) or a[0] != b[0]:
        return False
    it = iter(b)
    return all(c in it for c in a)


@functools.lru_cache(maxsize=1 << 18)
def _word_score(a: str, b: str, known: bool) -> float:
    """How well the typed word `a` stands for the word `b`; a word the catalogue knows stands only for itself."""
    if a == b:
        return 1.0
    if known:
        return 0.0
    most = 0 if len(b) < 4 else 1 if len(b) < 6 else 2
    if most and (d := _edits(a, b, most)) <= most:
        return 0.9 if d == 1 else 0.8
    if _short_for(a, b) and (len(a) >= 2 or a == "e"):
        return 0.85 if b.startswith(a) else 0.75
    if len(a) >= 4 and len(b) > len(a) and any(_edits(a, b[:k], 1) <= 1 for k in (len(a) - 1, len(a), len(a) + 1) if k < len(b)):
        return 0.6  # an abbreviation with a slip
    return 0.0


@functools.lru_cache(maxsize=1 << 16)
def _slip_in_filler(w: str) -> bool:
    return any(_edits(w, x, 1) <= 1 for x in LONG_FILLER)


def terms(name: Name) -> list[str]:
    """The words of a name and, in Chinese, its pairs of characters: what a catalogue's vocabulary is made of."""
    return name.words + [w[i : i + 2] for w in name.words if HAN.search(w) for i in range(len(w) - 1)]


def soft_cosine(typed: Name, title: Name, known: frozenset[str] | set[str]) -> tuple[float, float, list[str]]:
    """(cosine, mean score, words as read) of a typed name against a title.

    A word that stands for one of the title's (a slip, a short form, any order) is read as that word; words the catalogue
    knows (`known`) stand only for themselves. The cosine is that of the words as read and the title's; the mean score of
    the readings tells titles of one cosine apart. In Chinese, where words are not set apart, one character may differ if
    it makes pairs of characters that no title has.
    """
    if not title.words or not typed.words:
        return 0.0, 0.0, typed.words
    if HAN.search(title.text):
        a, b = typed.text, title.text
        if a == b:
            return 1.0, 1.0, title.words
        if len(b) < 5 or _edits(a, b, 1) > 1 or all(p in known for p in (a[i : i + 2] for i in range(len(a) - 1))):
            return 0.0, 0.0, typed.words
        return 1.0, 0.9, title.words
    left = list(title.words)
    read: list[str] = []
    total = 0.0
    for w in sorted(typed.words, key=lambda w: (w not in known, -len(w))):
        best = max(range(len(left)), key=lambda i: _word_score(w, left[i], w in known), default=None)
        s = _word_score(w, left[best], w in known) if best is not None else 0.0
        if s == 0.0:
            if w not in known and len(w) >= 4 and _slip_in_filler(w):
                continue  # a slip in a word that carries no identity
            read.append(w)
        else:
            read.append(left.pop(best))
            total += s
    if not read:
        return 0.0, 0.0, typed.words
    return (len(title.words) - len(left)) / (len(read) * len(title.words)) ** 0.5, total / len(read), read


def _same_year(typed: int | None, year: int | None) -> bool | None:
    """None where the typed name has no year."""
    if typed is None:
        return None
    if year is None:
        return False
    return typed == year if typed > 0 else year % 100 == -typed - 1


def simpler_characters(spark: SparkSession) -> dict[int, str]:
    """Traditional Chinese characters and their simplified forms, by the transliterator that Spark ships (ICU)."""
    src = "".join(map(chr, range(0x4E00, 0xA000)))
    out = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate(src)
    return {ord(a): b for a, b in zip(src, out) if a != b} if len(out) == len(src) else {}


def weighted_grams(names: DataFrame, keys: list[str], idf: DataFrame) -> DataFrame:
    """(keys, gram, w): unit vectors of tf-idf weights of names given as (keys, scope, grams); grams without idf drop out."""
    tf = names.select(*keys, "scope", F.explode("grams").alias("gram")).groupBy(*keys, "scope", "gram").agg(F.count("*").alias("tf"))
    w = tf.join(idf, ["scope", "gram"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys, "scope")))
    return w.select(*keys, "scope", "gram", (F.col("w") / norm).alias("w"))


def top_similar(left: DataFrame, right: DataFrame, n: int, least: float) -> DataFrame:
    """(l, r, cosine): for each `l` of left (l, scope, gram, w) the n most similar `r` of right within its scope, at least `least`.

    An equi-join on scope and gram; products are summed on the map side first. Ties go to the smaller `r`.
    """
    prod = left.alias("a").join(right.alias("b"), ["scope", "gram"]).select("scope", "l", "r", (F.col("a.w") * F.col("b.w")).alias("p"))
    sim = prod.groupBy("scope", "l", "r").agg(F.sum("p").alias("cosine")).where(F.col("cosine") >= least)
    w = Window.partitionBy("scope", "l").orderBy(F.desc(F.round("cosine", 9)), "r")
    return sim.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


LINK = "scope string, name string, id string, score double, words array<string>, year int, grams array<string>"


def link_names(mentions: DataFrame, catalogue: DataFrame, top: int = 24, least: float = 0.25, same: float = 0.95) -> DataFrame:
    """(scope, name, id, score): each distinct typed name and the catalogue entry it means; names that mean none are left out.

    `mentions` has scope and name; `catalogue` has id, scope, title, aliases ARRAY<STRING> and number. Three steps:

    1. A name in the very words, year and number of one title is read as that title. Candidates of any other name are the `top` catalogue names of the highest cosine of weighted character n-grams within the
       scope, at least `least`; nothing but an equi-join on n-grams finds them.
    2. Each candidate's soft cosine (`soft_cosine`) must reach `same` and its year must agree; the name is read in the
       words of the best one. A name that fits several equally well is read as none. Capitals alone ("SSSR (1976)") are
       first letters of a title.
    3. Names as read and titles are grouped by average linkage of the cosines of their weighted n-grams, at least `same`,
       groups of years that differ kept apart. A name means the entry it was read as if that lies in its group.

    Null and blank names and scopes have no links.
    """
    spark = mentions.sparkSession
    simpler = simpler_characters(spark)
    own = mentions.select("scope", "name").where("scope is not null and trim(name) <> ''").distinct()

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            names = [Name(x, simpler) for x in f["name"]]
            yield pd.DataFrame({
                "scope": f["scope"], "name": f["name"], "terms": [terms(x) for x in names], "words": [sorted(x.words) for x in names], "year": [None if x.initials else x.year for x in names],
                "number": [x.number for x in names], "grams": [[f"={x.initials}"] if x.initials else grams(x.words) for x in names],
            })

    def parse_catalogue(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for scope, key, title, aliases in zip(f["scope"], f["id"], f["title"], f["aliases"]):
                x = Name(title, simpler)
                out.append((scope, f"{key}\x00{title}", key, title, title, terms(x), x.words, x.year or 0, grams(x.words)))
                if len(x.words) > 1:
                    out.append((scope, f"{key}\x01{title}", key, title, title, [], [], 0, ["=" + "".join(w[0] for w in x.words)]))
                for a in filter(None, aliases if aliases is not None else []):
                    y = Name(a, simpler)
                    out.append((scope, f"{key}\x02{a}", key, a, title, terms(y), [], 0, grams(y.words)))
            yield pd.DataFrame(out, columns=["scope", "r", "id", "title", "main", "terms", "words", "year", "grams"])

    named = materialize(own.mapInPandas(parse, "scope string, name string, terms array<string>, words array<string>, year int, number string, grams array<string>"), "names")
    entry = "scope string, r string, id string, title string, main string, terms array<string>, words array<string>, year int, grams array<string>"
    entries = materialize(catalogue.where("scope is not null and title is not null").select("scope", "id", "title", "aliases").mapInPandas(parse_catalogue, entry), "titles")
    # a name in the very words, year and number of one title has cosine 1 with it and with no other: it needs no search
    digits = F.regexp_replace(F.coalesce("number", F.lit("")), "[^0-9]", "")
    main = entries.where("size(words) > 0 and year > 0").join(catalogue.select("id", digits.alias("digits")), "id")
    alone = main.groupBy("scope", F.sort_array("words").alias("words"), "year").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"), F.min("digits").alias("digits"), F.first("grams").alias("grams")).where("n = 1").drop("n")
    exact = named.drop("grams").join(alone, ["scope", "words", "year"]).where("number is null or number = digits").select("scope", "name", "id", F.lit(1.0).alias("score"), "words", "year", "grams")
    typed = named.join(exact.select("scope", "name"), ["scope", "name"], "left_anti")
    size = entries.groupBy("scope").agg(F.count("*").alias("all"))
    df = entries.select("scope", F.explode(F.array_distinct("grams")).alias("gram")).groupBy("scope", "gram").agg(F.count("*").alias("df"))
    idf = df.join(size, "scope").select("scope", "gram", (F.log((F.col("all") + 1) / F.col("df")) + 0.1).alias("idf"))
    left = weighted_grams(typed.select("scope", F.col("name").alias("l"), "grams"), ["l"], idf)
    right = weighted_grams(entries.select("r", "scope", "grams"), ["r"], idf)
    found = top_similar(left, right, top, least)
    numbers = catalogue.select("id", F.col("number").alias("number"))
    pairs = found.join(entries.select("scope", "r", "id", "title", "main"), ["scope", "r"]).join(numbers, "id")
    vocabulary = entries.select("scope", F.explode("terms").alias("term")).distinct()
    known = typed.select("scope", F.col("name").alias("l"), F.explode("terms").alias("term")).distinct().join(vocabulary, ["scope", "term"]).groupBy("scope", "l").agg(F.collect_set("term").alias("known"))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed: dict[str, Name] = {}

        def name(x: str) -> Name:
            if x not in parsed:
                if len(parsed) > 200_000:
                    parsed.clear()
                parsed[x] = Name(x, simpler)
            return parsed[x]

        for f in frames:
            out = []
            for scope, typed_name, terms_known, cands in zip(f["scope"], f["l"], f["known"], f["cands"]):
                m, vocabulary = name(typed_name), frozenset(terms_known if terms_known is not None else ())
                fits: dict[str, tuple] = {}
                for c in cands:
                    kind, t, main = c["r"][len(c["id"])], name(c["title"]), name(c["main"])
                    if kind == "\x01":
                        same_letters = m.initials and m.initials == "".join(w[0] for w in t.words)
                        cosine, score, read = (1.0, 0.7, t.words) if same_letters else (0.0, 0.0, [])
                    else:
                        cosine, score, read = soft_cosine(m, t, vocabulary)
                    year = _same_year(m.year, t.year)
                    if kind == "\x02":
                        read = main.words if cosine >= same else read
                        if t.year is None:
                            year = year if year is None else None
                    number = re.sub(r"\D", "", c["number"] or "")
                    if cosine < same or year is False or (m.number and number and m.number != number and year is None):
                        continue
                    x = (score, year, bool(m.number and m.number == number), read, main.year or 0)
                    if c["id"] not in fits or x[0] > fits[c["id"]][0]:
                        fits[c["id"]] = x
                if not fits:
                    continue
                best = max((bool(y), n, s) for s, y, n, _, _ in fits.values())
                who = [k for k, (s, y, n, _, _) in fits.items() if (bool(y), n, s) == best]
                if len(who) == 1:
                    _, year, number, read, entry_year = fits[who[0]]
                    # a number tells the year as well; a name with neither keeps its year open
                    out.append((scope, typed_name, who[0], best[2], sorted(read), entry_year if number or year else m.year or 0, grams(read)))
            yield pd.DataFrame(out, columns=["scope", "name", "id", "score", "words", "year", "grams"])

    grouped = pairs.groupBy("scope", "l").agg(F.collect_list(F.struct("id", "r", "title", "main", "number")).alias("cands"))  # at most `top` each
    read = materialize(grouped.join(known, ["scope", "l"], "left").mapInPandas(judge, LINK).unionByName(exact), "read")
    form = F.concat(F.col("year").cast("string"), F.lit(" "), F.array_join(F.sort_array("words"), " "))
    titles = entries.where("size(words) > 0").select("scope", "id", form.alias("form"), "year", "grams")
    names = read.select("scope", "name", "id", "score", form.alias("form"), "year", "grams")
    # copies are one node: what is grouped are the different forms, whatever the number of names
    forms = materialize(titles.select("scope", F.col("form").alias("name"), "year", "grams").unionByName(names.select("scope", F.col("form").alias("name"), "year", "grams")).dropDuplicates(["scope", "name"]), "forms")
    node = F.concat("scope", F.lit(" "), "form")
    groups = average_linkage(similar_pairs(forms, same), same, forms.select(F.concat("scope", F.lit(" "), "name").alias("node"), "year"))
    grouped_as = lambda x: x.withColumn("node", node).join(groups, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")).drop("node", "form", "year", "grams")
    return grouped_as(names).join(grouped_as(titles).select("scope", "id", "cluster"), ["scope", "id", "cluster"]).select("scope", "name", "id", "score")


def grams_of(names: DataFrame) -> DataFrame:
    """(scope, name, year, grams) of distinct names given as (scope, name)."""
    simpler = simpler_characters(names.sparkSession)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            names = [Name(x, simpler) for x in f["name"]]
            yield pd.DataFrame({"scope": f["scope"], "name": f["name"], "year": [x.year or 0 for x in names], "grams": [grams(x.words) for x in names]})

    return materialize(names.mapInPandas(parse, "scope string, name string, year int, grams array<string>"), "grams")


def years_agree(a: Column, b: Column) -> Column:
    """Whether two names' years can be one: the same, one of them missing (0), or a year whose century is open (-1 - its two digits) and a full one."""
    fits = lambda x, y: (x < 0) & (y > 0) & (y % 100 == -x - 1)
    return (a == b) | (a == 0) | (b == 0) | fits(a, b) | fits(b, a)


def similar_pairs(names: DataFrame, least: float) -> DataFrame:
    """(a, b, s): pairs of names of one scope and of years that agree whose weighted n-grams have a cosine of at least `least`, a < b.

    Exact: a vector's n-grams stand in one order, rarest first, and only the longest tail whose norm is under `least`
    isn't joined on. The first n-gram that a pair shares is in both heads if the pair reaches `least`, as otherwise all
    they share lies in a tail. Similarities count all n-grams.
    """
    block = names.select("scope", F.concat_ws(" ", "scope", "name").alias("l"), "year", "grams")
    size = block.groupBy("scope").agg(F.count("*").alias("all"))
    df = block.select("scope", F.explode(F.array_distinct("grams")).alias("gram")).groupBy("scope", "gram").agg(F.count("*").alias("df"))
    idf = materialize(df.join(size, "scope").select("scope", "gram", "df", (F.log((F.col("all") + 1) / F.col("df")) + 0.1).alias("idf")), "idf")
    w = materialize(weighted_grams(block, ["l", "year"], idf.drop("df")), "vectors")
    tail = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("scope", "l").orderBy(F.desc("df"), F.desc("gram")))
    head = materialize(w.join(idf.select("scope", "gram", "df"), ["scope", "gram"]).withColumn("tail", tail).where(F.col("tail") >= least * least - 1e-9).select("scope", "gram", "l", "year"), "heads")
    p, q = head.alias("p"), head.alias("q")
    found = p.join(q, ["scope", "gram"]).where((F.col("p.l") < F.col("q.l")) & years_agree(F.col("p.year"), F.col("q.year"))).select("scope", F.col("p.l").alias("a"), F.col("q.l").alias("b")).distinct()
    full = found.join(w.select("scope", F.col("l").alias("a"), "gram", F.col("w").alias("wa")), ["scope", "a"]).join(w.select("scope", F.col("l").alias("b"), "gram", F.col("w").alias("wb")), ["scope", "b", "gram"])
    return full.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s")).where(F.col("s") >= least)


def average_linkage(pairs: DataFrame, least: float, years: DataFrame | None = None) -> DataFrame:
    """(node, cluster): average-linkage clusters of nodes from sparse similarities (a, b, s) with a < b; missing pairs are 0.

    In each round every two clusters that are each other's nearest, at an average similarity of at least `least`, merge:
    for average linkage this gives the same tree as merging one pair at a time. Each round is joins and sums over the
    table of pairs between clusters, written to the shared folder; nothing is gathered on the driver but a count.
    Rounds go on until none merges. Ties go to the smaller name. Nodes without a partner are clusters of their own.
    With `years` (node, year) clusters whose years don't agree never merge, so a name without a year can't draw two
    years together; a cluster has the year that its members have.
    """
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    dated = nodes.join(years, "node", "left").fillna(0, "year") if years is not None else nodes.withColumn("year", F.lit(0))
    member = materialize(dated.select("node", "year", F.col("node").alias("cluster")), "members")
    sums = materialize(pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("s").alias("s")), "sums")
    while True:
        # a full year is more than an open century's and than none: 0 gives way to either
        year = F.coalesce(F.max(F.when(F.col("year") > 0, F.col("year"))), F.min("year"))
        size = member.groupBy("cluster").agg(F.count("*").alias("n"), year.alias("y"))
        avg = (
            sums.join(size.select(F.col("cluster").alias("a"), F.col("n").alias("na"), F.col("y").alias("ya")), "a").join(size.select(F.col("cluster").alias("b"), F.col("n").alias("nb"), F.col("y").alias("yb")), "b")
            .withColumn("v", F.round(F.col("s") / (F.col("na") * F.col("nb")), 9)).where((F.col("v") >= least) & years_agree(F.col("ya"), F.col("yb")))
        )
        both = avg.select(F.col("a").alias("x"), F.col("b").alias("y"), "v").union(avg.select("b", "a", "v"))
        near = both.groupBy("x").agg(F.min_by("y", F.struct(-F.col("v"), F.col("y"))).alias("y"))
        merge = materialize(near.alias("p").join(near.alias("q"), (F.col("p.y") == F.col("q.x")) & (F.col("q.y") == F.col("p.x"))).where("p.x < p.y").select(F.col("p.y").alias("old"), F.col("p.x").alias("new")), "merges")
        if merge.limit(1).count() == 0:
            break
        member = materialize(member.join(merge, member.cluster == merge.old, "left").select("node", "year", F.coalesce("new", "cluster").alias("cluster")), "members")
        to = lambda c, side: F.coalesce(F.col(f"{side}.new"), F.col(c))
        moved = sums.join(merge.alias("l"), sums.a == F.col("l.old"), "left").join(merge.alias("r"), sums.b == F.col("r.old"), "left").select(to("a", "l").alias("a"), to("b", "r").alias("b"), "s").where("a <> b")
        sums = materialize(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s")), "sums")
    return member.select("node", "cluster")

"""Text functions as Catalyst expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"\p{IsHan}"
# Scripts without blanks between words (kana, Chinese, Thai, Lao, Khmer, Myanmar), Latin with its accents,
# and the other alphabets, which set words apart. Java and RE2 read the ranges alike.
NO_SPACE = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{0e00}-\x{0e7f}\x{0e80}-\x{0eff}\x{1780}-\x{17ff}\x{1000}-\x{109f}"
LATIN = r"a-z0-9\x{00c0}-\x{024f}\x{1e00}-\x{1eff}"
ALPHABETS = r"\x{0370}-\x{03ff}\x{0400}-\x{052f}\x{0530}-\x{058f}\x{0590}-\x{05ff}\x{0600}-\x{06ff}\x{0900}-\x{0dff}\x{10a0}-\x{10ff}"
TOKEN_RUNS = f"[{NO_SPACE}]+|[{LATIN}]+|[{ALPHABETS}]+"


def tokens(c: Column) -> Column:
    """Lower-case words; a run in a script without blanks as its overlapping pairs of characters, a single one as itself. Null gives null."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN_RUNS})"), 1)
    pairs = lambda r: F.when(
        r.rlike(f"^[{NO_SPACE}]{{2,}}$"), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    ).otherwise(F.array(r))
    return F.flatten(F.transform(runs, pairs))


def clean_title(c: Column) -> Column:
    """A title without a format prefix and without the portal's suffixes, however many were appended."""
    t = F.regexp_replace(F.trim(c), r"(?i)^\s*\[?(pdf|html|docx?)\]?\s*[:|-]\s*", "")
    return F.trim(F.regexp_replace(t, r"(?i)(\s*[|–-]\s*(official portal|legislation online|gazette|lex-[a-z]{2}))+\s*$", ""))


def years(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?:^|[^0-9])((?:1[89]|20)[0-9]{2})(?:$|[^0-9])"), 1), lambda y: y.cast("int"))


def latest_year(c: Column) -> Column:
    """The latest year named in a text, 0 if none."""
    return F.coalesce(F.array_max(years(c)), F.lit(0))


def law_key(c: Column) -> Column:
    """A title without year, amendment and consolidation words, numbers and punctuation: its family."""
    s = F.regexp_replace(F.lower(c), r"\(?(?:amendment|amending|consolidated|consolidation)\)?", " ")
    s = F.regexp_replace(s, r"(?:no\.?|act)\s*[0-9]+", " ")
    s = F.regexp_replace(s, r"(?:1[89]|20)[0-9]{2}", " ")
    return F.trim(F.regexp_replace(s, r"[^\p{L}]+", " "))


def law_identity(c: Column) -> Column:
    """Lower-case ASCII words of a title without its trailing year."""
    s = F.trim(F.regexp_replace(F.lower(clean_title(c)), "[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(s, r" (?:1[89]|20)[0-9]{2}$", ""))


def url_host_path(c: Column) -> Column:
    """Host and path of an address in lower case, without scheme, www, query, fragment and closing slash."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"^[a-z]+://(?:www\.)?", "")
    return F.regexp_replace(F.regexp_replace(s, r"[?#].*$", ""), r"/+$", "")


def url_law_key(c: Column) -> Column:
    """The last part of an address's path without extension and year, letters and digits only, and its long query ids."""
    last = F.regexp_extract(url_host_path(c), r"([^/]+)$", 1)
    stem = F.regexp_replace(F.regexp_replace(last, r"\.(?:pdf|html?|docx?|txt)$", ""), r"(?:1[89]|20)[0-9]{2}", "")
    ids = F.array_join(F.regexp_extract_all(c, F.lit(r"[?&=:]([0-9]{2,})"), 1), "-")
    return F.concat_ws(":", F.regexp_replace(stem, "[^a-z0-9]", ""), F.when(ids != "", ids))


def url_kind(c: Column) -> Column:
    """Format of an address by its ending."""
    p = url_host_path(c)
    return F.when(p.rlike(r"\.pdf$"), "pdf").when(p.rlike(r"\.docx?$"), "docx").when(p.rlike(r"\.txt$"), "text").otherwise("html")


def content_kind(content_type: Column, url: Column) -> Column:
    """Format by content type, else by the address."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(t.contains("pdf"), "pdf").when(t.contains("word"), "docx").when(t.contains("html"), "html").when(t.startswith("text/"), "text").otherwise(url_kind(url))


def name_tokens(c: Column, stop: list[str], least: int = 3) -> Column:
    """The distinct words of a name, sorted, without stop words and words shorter than `least`."""
    words = F.array_distinct(tokens(c))
    return F.sort_array(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop)))


def overlap_of_shorter(a: Column, b: Column) -> Column:
    """Shared elements of two arrays by the size of the shorter, 0 if one is empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def share_of(c: Column, pattern: str, limit: int | None = None) -> Column:
    """Share of the characters of a text (of its first `limit`) that match a character class, 0 for an empty text."""
    s = c if limit is None else F.substring(c, 1, limit)
    return F.coalesce((F.length(s) - F.length(F.regexp_replace(s, pattern, ""))) / F.nullif(F.length(s), F.lit(0)), F.lit(0.0))


def mostly_ascii(c: Column) -> Column:
    """Whether less than 15 in 100 of the first 1,000 characters are outside ASCII."""
    return share_of(c, r"[^\x00-\x7F]", 1000) < 0.15


# Words that name the kind of a provision, and how Chinese and Mongolian laws number theirs.
LABEL_WORDS = r"(?i)\b(?:articles?|sections?|regulations?|rules?|clauses?|paragraphs?|paras?|schedules?|arts?|secs?|ss|s|r|reg)\b\.?"
HAN_ARTICLE = r"第\s*([一二三四五六七八九十百千零〇两0-9]+)\s*[条章节]"
MONGOLIAN_ARTICLE = r"([0-9]{1,3})\s*(?:д[үу]г[эа]{0,2}р|дэх|дахь)\s+з[үу]йл"
CITED = r"^\s*([0-9]{1,4}[A-Za-z]{0,2}(?:\.[0-9]{1,3})*)((?:\([^)\s]{1,8}\))*)\s*$"


def article_spine(c: Column) -> Column:
    """The numeric identities that a citation names, sorted: s. 26(1) gives 26 and 26(1); 20.1.5 gives 20 and 20.1.5;
    第一百零一条 gives 101; 14 дүгээр зүйл gives 14; APP 8 gives app8. Null gives null."""
    han = F.transform(F.regexp_extract_all(c, F.lit(HAN_ARTICLE), 1), lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("bigint")).otherwise(han_to_int(x)).cast("string"))
    mongolian = F.regexp_extract_all(F.lower(c), F.lit(MONGOLIAN_ARTICLE), 1)
    principle = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\bAPP\s*([0-9]+(?:\.[0-9]+)?)"), 1), lambda x: F.concat(F.lit("app"), x))
    chunks = F.split(F.regexp_replace(c, LABEL_WORDS, " "), "[;,]| and ")
    base = F.transform(chunks, lambda x: F.lower(F.regexp_extract(x, CITED, 1)))
    whole = F.transform(chunks, lambda x: F.lower(F.concat(F.regexp_extract(x, CITED, 1), F.regexp_extract(x, CITED, 2))))
    root = F.transform(base, lambda x: F.regexp_extract(x, r"^([^.]*)", 1))
    return F.sort_array(F.array_distinct(F.filter(F.concat(han, mongolian, principle, base, whole, root), lambda x: x.isNotNull() & (x != ""))))


def section_key(c: Column) -> Column:
    """The leading number of a label with its letters and dots; structural headings have none."""
    k = F.regexp_extract(F.upper(c), r"([0-9]+[A-Z]{0,2}(?:\.[0-9]+)*)", 1)
    return F.when(F.lower(c).rlike(r"^\s*(?:part|chapter|schedule|bab|chương|глава|附表)"), None).when(k != "", k)


HAN_DIGITS = "〇一二三四五六七八九"
HAN_UNITS = {"十": 10, "百": 100, "千": 1000}


def han_to_int(c: Column) -> Column:
    """The number written with Chinese numerals up to the thousands; null for other text, 0 for zero."""
    s = F.translate(c, "零两", "〇二")
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("digit"), F.lit(False).alias("open"))

    def step(a, ch):
        unit = F.lit(0)
        for u, n in HAN_UNITS.items():
            unit = F.when(ch == u, F.lit(n)).otherwise(unit)
        digit = F.instr(F.lit(HAN_DIGITS), ch) - 1
        return F.when(unit > 0, F.struct((a["sum"] + unit * F.when(a["open"], a["digit"]).otherwise(F.lit(1))).alias("sum"), F.lit(0).alias("digit"), F.lit(False).alias("open"))).otherwise(
            F.struct(a["sum"].alias("sum"), digit.alias("digit"), (digit > 0).alias("open"))
        )

    value = F.aggregate(F.split(s, ""), start, lambda a, ch: F.when(ch == "", a).otherwise(step(a, ch)), lambda a: a["sum"] + F.when(a["open"], a["digit"]).otherwise(F.lit(0)))
    return F.when(s.rlike("^[〇一二三四五六七八九十百千]+$"), value)


def label(c: Column) -> Column:
    """A section label in one writing: Section 26A, Pasal 3, Điều 5, Статья 7, 第10条, APP 8.1; a bare number is a section."""
    t = F.trim(F.regexp_replace(c, r"[.:;,\s]+$", ""))
    n = F.upper(F.regexp_extract(t, r"([0-9]+[A-Za-z]?)", 1))
    low = F.lower(t)
    return (
        F.when(low.rlike(r"^(?:app|australian privacy principle|principle)\s*[0-9]"), F.concat(F.lit("APP "), F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)", 1)))
        .when(low.rlike(r"^(?:section|sec\.?|s\.?|art\.?|article)?\s*[0-9]+[a-z]?$"), F.concat(F.lit("Section "), n))
        .when(low.rlike(r"^pasal\s*[0-9]"), F.concat(F.lit("Pasal "), n))
        .when(low.rlike(r"^điều\s*[0-9]"), F.concat(F.lit("Điều "), n))
        .when(low.rlike(r"^статья\s*[0-9]"), F.concat(F.lit("Статья "), n))
        .otherwise(t)
    )


def code(c: Column) -> Column:
    """P6-I4 as 6.4; anything else is null. Codes stay text."""
    a, b = F.regexp_extract(c, r"^P([0-9]+)-I([0-9]+)$", 1), F.regexp_extract(c, r"^P([0-9]+)-I([0-9]+)$", 2)
    return F.when(a != "", F.concat_ws(".", a.cast("int").cast("string"), b.cast("int").cast("string")))


MONTHS = "January February March April May June July August September October November December".split()


def last_amended(date: Column, title: Column) -> Column:
    """Original, Month Year, Year, or the year of the title, in this order."""
    month = F.try_element_at(F.array(*map(F.lit, MONTHS)), F.try_to_number(F.regexp_extract(date, r"^[0-9]{4}-([0-9]{2})", 1), F.lit("99")).cast("int"))
    year = F.regexp_extract(date, r"^([0-9]{4})", 1)
    named = latest_year(title)
    return (
        F.when(date == "Original", date)
        .when(date.rlike(r"^[0-9]{4}-(?:0[1-9]|1[0-2])"), F.concat_ws(" ", month, year))
        .when(date.rlike(r"^[0-9]{4}"), year)
        .when(named > 0, named.cast("string"))
    )


def html_to_text(c: Column) -> Column:
    """Readable text of HTML by patterns alone: the parts out of sight and the tags go, block ends become line ends."""
    s = F.regexp_replace(c, r"(?is)<!--.*?-->|<(?:script|style|head|nav|header|footer|aside|noscript)\b.*?</(?:script|style|head|nav|header|footer|aside|noscript)\s*>", " ")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|ul|ol|table)\s*>", "\n")
    s = F.regexp_replace(s, r"<[^<>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"))


def markdown_to_plain(c: Column) -> Column:
    """Markdown without heading marks, emphasis, code marks, link targets and bullets."""
    s = F.regexp_replace(c, r"(?m)^#{1,6}[ \t]+|[ \t]+#+$", "")
    s = F.regexp_replace(s, r"\[([^\]\n]*)\]\([^)\n]*\)", "$1")
    s = F.regexp_replace(s, r"\*\*|__|`", "")
    return F.regexp_replace(s, r"(?m)^[ \t]*[-*+][ \t]+", "")


def hash_order(c: Column, seed: str) -> Column:
    """A value whose order is a shuffle that only the seed and the key decide."""
    return F.md5(F.concat(F.lit(seed), c.cast("string")))


def is_error_page(c: Column) -> Column:
    """Whether a short text begins like an error page."""
    return F.substring(F.lower(c), 1, 600).rlike("404|not found|access denied|service unavailable|page does not exist") & (F.length(c) < 4000)


def is_script_shell(page: Column) -> Column:
    """Whether a page is a frame for scripts: marks of one and neither headings nor paragraphs outside its scripts."""
    seen = F.regexp_replace(page, r"(?is)<(?:script|noscript)\b.*?</(?:script|noscript)\s*>", "")
    return (F.lower(page).contains('id="root"') | F.lower(page).contains("<noscript>")) & ~F.lower(seen).rlike("<(?:h[1-6]|p|li|td)[ >]")


def title_like(c: Column) -> Column:
    """Whether four fifths of the words begin with a capital or connect others, and no colon or semicolon occurs."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    good = F.filter(words, lambda w: w.rlike(r"^[\p{Lu}0-9(«“]") | F.lower(w).isin("of", "the", "and", "on", "in", "for", "to"))
    return (F.size(good) >= F.size(words) * 0.8) & ~c.rlike("[:;]")


def acronym(c: Column) -> Column:
    """First letters of the capitalised words of a title, connectors left out."""
    words = F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\s]", " "), r"\s+"), lambda w: w.rlike(r"^\p{Lu}") & ~F.lower(w).isin("of", "the", "and", "on"))
    return F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")

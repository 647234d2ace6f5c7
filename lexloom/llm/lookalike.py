"""One consistent form of text whose characters differ while it looks the same."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Letters of other scripts and the Latin letters they look like, in their order in Unicode.
LOOK_ALIKE = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχϲϳЅІЈАВЕКМНОРСТХаекорсухѕіјѡѵүҮһӀӏԁԌԍԚԛԜԝօսհոՕՍᏀ‐‑ꓸ",
        "ABEZHIKMNOPTYXaiKvopuxcjSIJABEKMHOPCTXaekopcyxsijwvyYhIldGgQqWwouhnOUG--.",
        strict=True,
    )
) | {"κ": "k", "в": "в", "ı": "i", "ɡ": "g", "ɑ": "a"}
#: Kinds of compatibility mapping that change a character's width or coding but not how it looks.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
# Characters whose compatibility mapping does change how they look.
OWN_LOOK = set("№℀℁℅℆")


@functools.cache
def _apart(ch: str) -> str:
    """Full decomposition of a character, as far as it keeps its look. Hangul syllables stay whole."""
    d = unicodedata.decomposition(ch)
    if not d or ch in OWN_LOOK or "가" <= ch <= "힣":
        return ch
    parts = d.split()
    if parts[0].startswith("<"):
        if parts[0] not in SAME_LOOK:
            return ch
        parts = parts[1:]
    return "".join(_apart(chr(int(p, 16))) for p in parts)


def _replacement(ch: str) -> str:
    out = []
    for c in _apart(ch):
        kind = unicodedata.category(c)
        if kind == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef":
            continue  # nothing to see
        if kind == "Zs" or c in "\t\n\v\f\r\x85\u2028\u2029":
            c = " "
        out.append(LOOK_ALIKE.get(c, c))
    return "".join(out)


@functools.cache
def character_rows() -> list[tuple[str, list[tuple[str, int]]]]:
    """(character, its replacement as characters with combining class) of every character that changes or combines."""
    rows = []
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        new = _replacement(ch)
        if new != ch or unicodedata.combining(ch):
            rows.append((ch, [(c, unicodedata.combining(c)) for c in new]))
    return rows


@functools.cache
def composition_rows() -> list[tuple[str, str]]:
    """(decomposed cluster, composed character) of every character that composes."""
    rows = []
    for cp in range(0xA0, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            rows.append((unicodedata.normalize("NFD", ch), ch))
    return rows


def _mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(character_rows(), "_c string, _new array<struct<ch: string, ccc: int>>")


def _composition(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(composition_rows(), "_cluster string, _whole string")


#: Texts in which no character stands for another: printable ASCII, single blanks inside.
PLAIN = r"^[!-~]+(?: [!-~]+)*(?![\s\S])"


def consistent_forms(texts: DataFrame, text_col: str) -> DataFrame:
    """(text_col, form): each distinct non-null text once, with its consistent form.

    Widths, kinds of blank, blanks at the ends, invisible characters, ligatures and other codings of one look, the
    order and composition of accents, and letters of other scripts that look like Latin ones (these become the Latin
    letter, also within a word of their own script) are made one; case, accents, digits, words, punctuation, the
    number of inner blanks and order stay. An empty text has an empty form. Null texts are left out. Two forms are
    equal if and only if the texts look the same in this sense.

    Texts of printable ASCII with single blanks inside are their own forms and pass by. The others are exploded to positioned characters, joined with the table of replacements (broadcast: some seven
    thousand rows, a bound that Unicode sets), their marks ordered by class within each base letter's cluster, the
    clusters recomposed by another such table, and joined again. Work is by distinct text.
    """
    spark = texts.sparkSession
    own = texts.select(F.col(f"`{text_col}`").alias("_text")).where("_text is not null").distinct()
    plain = F.col("_text").rlike(PLAIN)
    key = ["_h", "_g"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # texts are dealt out by their key before they become characters, so that all that follows needs no other exchange
    keyed = own.where(~plain).select("_text", F.xxhash64("_text").alias("_h"), F.xxhash64(F.reverse("_text")).alias("_g")).repartition(n, *key)
    chars = keyed.select(*key, F.posexplode(F.split("_text", "")).alias("_pos", "_c")).where("_c <> ''")
    mapped = chars.join(F.broadcast(_mapping(spark)), "_c", "left").select(
        *key, "_pos", F.posexplode(F.coalesce("_new", F.array(F.struct(F.col("_c").alias("ch"), F.lit(0).alias("ccc"))))).alias("_i", "_x")
    )
    in_order = Window.partitionBy(*key).orderBy("_pos", "_i").rowsBetween(Window.unboundedPreceding, 0)
    numbered = mapped.withColumn("_cluster_no", F.sum((F.col("_x.ccc") == 0).cast("int")).over(in_order))
    clusters = numbered.groupBy(*key, "_cluster_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_x.ccc", "_pos", "_i", "_x.ch"))), lambda s: s["ch"]), "").alias("_cluster")
    )
    whole = clusters.join(F.broadcast(_composition(spark)), "_cluster", "left").withColumn("_whole", F.coalesce("_whole", "_cluster"))
    forms = whole.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_cluster_no", "_whole"))), lambda s: s["_whole"]), "").alias("form"))
    other = keyed.join(forms, key, "left").select(F.col("_text").alias(text_col), F.trim(F.coalesce("form", F.lit(""))).alias("form"))
    return own.where(plain).select(F.col("_text").alias(text_col), F.col("_text").alias("form")).unionByName(other)


def same_look_pairs(left: DataFrame, right: DataFrame, group: str, left_id: str, left_text: str, right_id: str, right_text: str) -> DataFrame:
    """(left_id, right_id): pairs of one group whose texts look the same but are not the same string.

    Null groups or texts have no pairs. Forms are found once for each different text; rows then meet by group and form,
    so there are as many pairs as the result has.
    """
    a = left.select(F.col(f"`{group}`").alias("_grp"), F.col(f"`{left_id}`").alias("_l"), F.col(f"`{left_text}`").alias("_text"))
    b = right.select(F.col(f"`{group}`").alias("_grp"), F.col(f"`{right_id}`").alias("_r"), F.col(f"`{right_text}`").alias("_text"))
    forms = consistent_forms(a.select("_text").unionByName(b.select("_text")), "_text")
    af = a.where("_grp is not null").join(forms, "_text").withColumnRenamed("_text", "_lt")
    bf = b.where("_grp is not null").join(forms, "_text").withColumnRenamed("_text", "_rt")
    return af.join(bf, ["_grp", "form"]).where("_lt <> _rt").select(F.col("_l").alias(left_id), F.col("_r").alias(right_id)).distinct()

"""What only Python can express, in Arrow batches; and the places where models plug in."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf


#: One character for each different word of two texts: letters of no meaning, in the order of the code points.
WORD_SIGNS = "".join(map(chr, range(33, 55_000)))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of words by the number of reference words, rounded to four places; null if one is null.

    Each different word of the two texts becomes one character, so that the distance of words is that of two short
    strings, which Spark has. Without a reference word it is 0 for no word and 1 for any. Texts of more than some 54,000
    different words have no rate (null).
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    r, h = words(reference), words(hypothesis)
    known = F.array_union(r, h)
    signs = lambda a: F.array_join(F.transform(a, lambda w: F.substring(F.lit(WORD_SIGNS), F.array_position(known, w).cast("int"), F.lit(1))), "")
    rate = F.round(F.levenshtein(signs(r), signs(h)) / F.size(r), 4)
    return F.when(reference.isNull() | hypothesis.isNull() | (F.size(known) > len(WORD_SIGNS)), None).when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).otherwise(rate)


def last_json_object(c: Column) -> Column:
    """The last balanced JSON object in a model's answer, thoughts and code fences aside; null if there is none."""

    @pandas_udf("string")
    def last(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            t = re.sub(r"<think>.*?</think>", "", t, flags=re.S)
            found, depth, start, quoted, escaped = None, 0, 0, False, False
            for i, ch in enumerate(t):
                if quoted:
                    quoted, escaped = (escaped or ch != '"'), (ch == "\\" and not escaped)
                elif ch == '"' and depth:
                    quoted = True
                elif ch == "{":
                    start, depth = (i if depth == 0 else start), depth + 1
                elif ch == "}" and depth:
                    depth -= 1
                    if depth == 0:
                        try:
                            found = json.dumps(json.loads(t[start : i + 1]), ensure_ascii=False)
                        except ValueError:
                            pass
            return found

        return s.map(one)

    return last(c)


def resolve_alias(c: Column, aliases: dict[str, str], least: float = 0.8) -> Column:
    """The code a name stands for: an exact alias, else the longest alias contained, else the most similar of at least `least`.

    `aliases` is a dimension of some dozens of names; it travels in the closure.
    """
    known = {k.lower(): v for k, v in aliases.items()}

    @pandas_udf("string")
    def resolve(s: pd.Series) -> pd.Series:
        def one(t):
            if not t or not t.strip():
                return None
            t = t.strip().lower()
            if t in known:
                return known[t]
            inside = [k for k in known if len(k) > 3 and (k in t or t in k and len(t) > 3)]
            if inside:
                return known[max(inside, key=lambda k: (len(k), k))]
            r, k = max((difflib.SequenceMatcher(None, t, k).ratio(), k) for k in known)
            return known[k] if r >= least else None

        seen = {v: one(v) for v in s.unique()}
        return s.map(seen)

    return resolve(c)


def greedy_same_law(df: DataFrame, law: str, doc: str, spine: str, size: str, share: float = 0.5) -> DataFrame:
    """(law, doc, kept): in each law, documents from the fullest on; one is kept unless it shares `share` of the smaller
    spine with one already kept. Greedy, so a law's documents are judged together; a law has few documents."""

    def judge(f: pd.DataFrame) -> pd.DataFrame:
        kept: list[set] = []
        out = []
        for r in f.sort_values(["n", "d"], ascending=[False, True]).itertuples():
            s = set(r.s if r.s is not None else ())
            dup = any(s and k and len(s & k) >= share * min(len(s), len(k)) for k in kept)
            if not dup:
                kept.append(s)
            out.append((r.l, r.d, not dup))
        return pd.DataFrame(out, columns=["law", "doc", "kept"])

    slim = df.select(F.col(law).alias("l"), F.col(doc).alias("d"), F.col(spine).alias("s"), F.col(size).alias("n"))
    return slim.groupBy("l").applyInPandas(judge, "law string, doc string, kept boolean")


@udtf(returnType="segment int, label string, text string")
class SplitProvisions:
    """Table function: a text and the pattern of its boundaries give numbered provisions; use with LATERAL."""

    def eval(self, text: str, pattern: str):
        if not text:
            return
        at = [m.start() for m in re.finditer(pattern, text, re.M)]
        edges = sorted({0, *at, len(text)})
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            yield i, text[a:b].split("\n")[0][:80], text[a:b]


def register(spark: SparkSession) -> None:
    spark.udtf.register("split_provisions", SplitProvisions)


#: Ways to grade and retrieve, by name; a deployment adds its own.
GRADERS: dict[str, Callable[[pd.Series, pd.Series], pd.DataFrame]] = {}
RETRIEVERS: dict[str, Callable[[DataFrame], DataFrame]] = {}
OCR_ENGINES: dict[str, Callable[[str], list[tuple[str, float]]]] = {}


def overlap_grader(query: pd.Series, text: pd.Series) -> pd.DataFrame:
    """The offline grader: share of the query's words that the text holds."""
    out = []
    for q, t in zip(query, text):
        words = {w for w in re.findall(r"\w{3,}", (q or "").lower())}
        hit = sum(w in (t or "").lower() for w in words)
        score = round(hit / len(words), 4) if words else 0.0
        out.append((score >= 0.5, score))
    return pd.DataFrame(out, columns=["relevant", "score"])


GRADERS["overlap"] = overlap_grader


def grade(df: DataFrame, query: str, text: str, grader: str = "overlap") -> DataFrame:
    """Adds `grade` (relevant, score, failed): a grader over Arrow batches; a batch that raises is failed, not rejected."""
    f = GRADERS[grader]

    @pandas_udf("relevant boolean, score double, failed boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for q, t in batches:
            try:
                out = f(q, t).assign(failed=False)
            except Exception:
                out = pd.DataFrame({"relevant": [None] * len(q), "score": [None] * len(q), "failed": True})
            yield out

    return df.withColumn("grade", run(F.col(query), F.col(text)))


# ---- retrievers: frames of candidates (run_id, indicator_id, doc_id, keyword, semantic, ...) gain a score ---------------


def _by(column: str) -> Callable[[DataFrame], DataFrame]:
    return lambda candidates: candidates.withColumn("score", F.coalesce(F.col(column).cast("double"), F.lit(0.0)))


def _hybrid(candidates: DataFrame) -> DataFrame:
    from lexloom.operators.retrieval import max_norm

    n = max_norm(candidates, ["run_id", "indicator_id"], ["keyword", "semantic"])
    score = 0.65 * F.coalesce("keyword_norm", F.lit(0.0)) + 0.35 * F.coalesce("semantic_norm", F.lit(0.0))
    return n.withColumn("score", score).drop("keyword_norm", "semantic_norm")


RETRIEVERS |= {"keyword": _by("keyword"), "semantic": _by("semantic"), "hybrid": _hybrid}


def choose_retriever(name: str, available: Callable[[str], bool] = lambda n: True) -> tuple[str, Callable[[DataFrame], DataFrame]]:
    """(name, retriever) of a strategy: auto takes the first that is there of hybrid, keyword and semantic; one that is
    not registered or not available falls back in that order. None at all is an error."""
    for n in ([] if name == "auto" else [name]) + ["hybrid", "keyword", "semantic"]:
        if n in RETRIEVERS and available(n):
            return n, RETRIEVERS[n]
    raise LookupError(f"no retriever for {name}")


# ---- readers of scans: a text or file content gives pages with confidences ----------------------------------------------


def mock_reader(text: str) -> list[tuple[str, float]]:
    """Pages of 1,800 characters, with a confidence from their share of letters."""
    pages = [text[i : i + 1800] for i in range(0, max(1, len(text)), 1800)]
    return [(t, 0.55 + 0.4 * (sum(map(str.isalpha, t)) / len(t) if t else 0.0)) for t in pages]


OCR_ENGINES["mock"] = mock_reader


def read_pages(df: DataFrame, id_col: str, content_col: str, engine: str = "mock") -> DataFrame:
    """(id, page, text, confidence, failed): pages of every row's content by a registered reader, over Arrow batches; content
    that a reader fails on is one row that says so."""
    f = OCR_ENGINES[engine]
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, content in zip(frame.iloc[:, 0], frame.iloc[:, 1]):
                if content is None:
                    continue
                try:
                    out += [(key, i + 1, t, c, False) for i, (t, c) in enumerate(f(content))]
                except Exception:
                    out.append((key, None, None, None, True))
            yield pd.DataFrame(out, columns=[id_col, "page", "text", "confidence", "failed"]).astype({"page": "Int32"})

    return df.select(id_col, content_col).mapInPandas(run, f"`{id_col}` {kind}, page int, text string, confidence double, failed boolean")


def availability(names: dict[str, list[str]], settings: dict[str, str]) -> dict[str, bool]:
    """Which providers can be used: those all of whose needed settings are there and not blank."""
    return {n: all((settings.get(k) or "").strip() for k in needs) for n, needs in names.items()}

"""Queries written once as SQL for Catalyst and for the engine that checks them: only the spelling of functions differs."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from lexloom.sources.tables import table

TABLES = ("corpus_law", "corpus_version", "corpus_run", "provisions", "ref_row", "label_row", "trace_target", "doc_rank", "ocr_result", "documents", "fetched_page", "body_file", "events", "embeddings")


@dataclass(frozen=True)
class Dialect:
    """How one engine writes what the queries need; patterns are read alike by both."""

    spark: bool

    def text(self, s: str) -> str:
        return f"r'{s}'" if self.spark else f"'{s}'"

    def has(self, c: str, pattern: str) -> str:
        return f"({c} RLIKE {self.text(pattern)})" if self.spark else f"regexp_matches({c}, '{pattern}')"

    def sub(self, c: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({c}, {self.text(pattern)}, '{by}')" if self.spark else f"regexp_replace({c}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"

    def one(self, c: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({c}, {self.text(pattern)}, {group})"

    def every(self, c: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({c}, {self.text(pattern)}, {group})"

    def split(self, c: str, pattern: str) -> str:
        return f"split({c}, {self.text(pattern)})" if self.spark else f"string_split_regex({c}, '{pattern}')"

    def rows(self, a: str) -> str:
        return f"explode({a})" if self.spark else f"unnest({a})"

    def size(self, a: str) -> str:
        return f"size({a})" if self.spark else f"len({a})"

    def join(self, a: str, by: str) -> str:
        return f"array_join({a}, '{by}')" if self.spark else f"array_to_string({a}, '{by}')"

    def keep(self, a: str, name: str, test: str) -> str:
        return f"filter({a}, {name} -> {test})" if self.spark else f"list_filter({a}, lambda {name}: {test})"

    def map(self, a: str, name: str, value: str) -> str:
        return f"transform({a}, {name} -> {value})" if self.spark else f"list_transform({a}, lambda {name}: {value})"

    def sort(self, a: str) -> str:
        return f"sort_array({a})" if self.spark else f"list_sort({a})"

    def distinct(self, a: str) -> str:
        """The different elements, sorted."""
        return f"sort_array(array_distinct({a}))" if self.spark else f"list_sort(list_distinct({a}))"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def shared(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})" if self.spark else f"list_intersect({a}, {b})"

    def field(self, c: str, name: str) -> str:
        """A text field of a JSON text, null where the text is not readable."""
        return f"get_json_object({c}, '$.{name}')" if self.spark else f"CASE WHEN json_valid({c}) THEN json_extract_string({c}, '$.{name}') END"

    def numbered(self, a: str, place: str, item: str) -> str:
        """Columns of the places (from 0) and items of an array, a row each."""
        return f"posexplode({a}) AS ({place}, {item})" if self.spark else f"unnest(range(len({a}))) AS {place}, unnest({a}) AS {item}"

    def utf8(self, c: str) -> str:
        """Bytes as text if they are UTF-8, else null."""
        return f"CASE WHEN is_valid_utf8(CAST({c} AS STRING)) THEN CAST({c} AS STRING) END" if self.spark else f"TRY(decode({c}))"

    def gather(self, value: str, order: str) -> str:
        """The values of a group as an array in an order."""
        return f"transform(sort_array(collect_list(struct({order} AS o, {value} AS v))), x -> x.v)" if self.spark else f"list({value} ORDER BY {order})"

    @property
    def string(self) -> str:
        return "STRING" if self.spark else "VARCHAR"

    @property
    def cross(self) -> str:
        return "`cross`" if self.spark else '"cross"'


SPARK, CHECK = Dialect(True), Dialect(False)


def run(spark, d: str, sql: str):
    """A query over the tables of a folder, as temporary views of their names; views bind when a query is made."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            table(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def registry() -> tuple[dict, dict, Callable]:
    """(QUERIES, ORACLE, decorator) of a module: a function of a dialect becomes a query and its twin."""
    queries: dict[str, Callable] = {}
    oracle: dict[str, str] = {}

    def add(f: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
        def made(spark, d):
            return run(spark, d, f(SPARK))

        made.__name__, made.__doc__ = f.__name__, f.__doc__
        queries[f.__name__] = made
        oracle[f.__name__] = f(CHECK)
        return f

    return queries, oracle, add

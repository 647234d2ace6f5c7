"""Files as tables and tables as files."""

from __future__ import annotations

import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, quoted line ends and all columns as text (codes such as 12.10 stay themselves)."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)


def pick_columns(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Columns found by key words in their headers: {name: words, any of which the header holds}. Missing ones are null."""
    out: list[Column] = []
    for name, words in wanted.items():
        hit = next((c for c in df.columns if any(w in c.lower() for w in words)), None)
        out.append((F.col(f"`{hit}`") if hit else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, kind, text): whole files with their content hash and the format their first bytes tell."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.substring(F.hex("content"), 1, 8)
    kind = F.when(head == "25504446", "pdf").when(head == "504B0304", "docx").when(F.lower(F.substring(F.col("content").cast("string"), 1, 200)).rlike("<(?:!doctype|html)"), "html").otherwise("text")
    return b.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), kind.alias("kind"), F.when(kind.isin("html", "text"), F.col("content").cast("string")).alias("text"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV of exactly these columns, every field quoted, nulls as empty fields; one file for each partition."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns)).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def csv_text(df: DataFrame, columns: list[str], limit: int = 100_000) -> str:
    """The submission form of a bounded report: byte order mark, CRLF, every field quoted. More than `limit` rows raise."""
    rows = df.select(*columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows; use write_csv")
    quote = lambda v: '"' + ("" if v is None else str(v)).replace('"', '""') + '"'
    return "﻿" + "".join(",".join(map(quote, r)) + "\r\n" for r in [columns, *rows])


def to_payload(df: DataFrame, key: str) -> DataFrame:
    """(key, payload): each row as JSON, nulls left out."""
    return df.select(F.col(key), F.to_json(F.struct(*df.columns)).alias("payload"))


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that the rows belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


class _Page(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _CatalogueReader(DataSourceReader):
    """Pages are stretches of bytes (`page_bytes`), or of so many records (`page_size`), for which the driver looks once
    where records begin; a task reads its own stretch only, up to the end of the line it ends in."""

    def __init__(self, options: dict):
        self.path, self.size, self.records = options["path"], int(options.get("page_bytes", str(8 << 20))), int(options.get("page_size", "0"))

    def partitions(self) -> list[InputPartition]:
        total = os.path.getsize(self.path)
        starts = list(range(0, max(total, 1), self.size))
        if self.records:
            starts, at, n = [0], 0, 0
            with open(self.path, "rb") as f:
                for line in f:
                    if line.strip():
                        if n and n % self.records == 0:
                            starts.append(at)
                        n += 1
                    at += len(line)
        return [_Page(a, b) for a, b in zip(starts, [*starts[1:], total])]

    def read(self, partition: _Page) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(max(0, partition.start - 1))
            if partition.start:
                f.readline()  # the line that began before belongs to the page before
            while f.tell() < partition.end and (line := f.readline()):
                if line.strip():
                    r = json.loads(line)
                    yield r.get("id"), r.get("title"), r.get("url"), bool(r.get("in_force", True))


class CatalogueSource(DataSource):
    """format("catalogue"): a portal's catalogue, page by page, one partition each. Offline: a file of JSON lines."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return "id string, title string, url string, in_force boolean"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _CatalogueReader(self.options)


ROBOTS_LINE = re.compile(r"^\s*([A-Za-z-]+)\s*:\s*(.*?)\s*(?:#.*)?$")


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, agent, pattern, allow, delay) of robots files given as (host, body); agents in a row share their group.

    Natively: lines, then a running count of groups by window, then a join of agents and rules of a group.
    """
    from pyspark.sql.window import Window

    ln = files.select("host", F.posexplode(F.split("body", "\r?\n")).alias("i", "line"))
    field, value = F.lower(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1)), F.trim(F.regexp_replace(F.regexp_extract("line", r"^\s*[A-Za-z-]+\s*:(.*)$", 1), r"\s+#.*$", ""))
    f = ln.select("host", "i", field.alias("field"), value.alias("value")).where("field in ('user-agent', 'allow', 'disallow', 'crawl-delay')")
    w = Window.partitionBy("host").orderBy("i")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    g = f.withColumn("opens", opens.cast("int")).withColumn("grp", F.sum("opens").over(w))
    agents = g.where("field = 'user-agent'").select("host", "grp", F.lower("value").alias("agent"))
    rules = g.where("field in ('allow', 'disallow') and value <> ''").select("host", "grp", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow"))
    delay = g.where("field = 'crawl-delay'").groupBy("host", "grp").agg(F.max(F.col("value").try_cast("double")).alias("delay"))
    return agents.join(rules, ["host", "grp"], "left").join(delay, ["host", "grp"], "left").select("host", "agent", "pattern", "allow", "delay")


def decide(pages: DataFrame, rules: DataFrame, readable: DataFrame, exceptions: DataFrame, agent: str) -> DataFrame:
    """(url, allowed, reason) of addresses, by rules (host, agent, pattern, allow) as `robots_rules` gives them.

    Of a host's groups the one counts whose agent is the longest within `agent`'s name, else that of *; a host without
    either permits all. Of its patterns that match path and query the longest wins, permission on ties; * stands for
    anything and a last $ for the end. Hosts not in `readable` permit nothing but by `exceptions` (host). Rules join
    addresses by host.
    """
    name = agent.lower()
    fits = rules.select("host", "agent", "pattern", "allow").where((F.col("agent") == "*") | F.contains(F.lit(name), F.col("agent")))
    best = fits.groupBy("host").agg(F.max(F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))).alias("size"))
    own = fits.join(best, "host").where(F.when(F.col("agent") == "*", 0).otherwise(F.length("agent")) == F.col("size")).where("pattern is not null")
    escaped = F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\])", r"\\$1")
    rule = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, r"\*", ".*"), r"\$(?!$)", r"\\\$"))
    patterns = own.select("host", rule.alias("rule"), F.struct(F.length("pattern").alias("n"), "allow").alias("r"))
    path = F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+(/[^#]*)", 1)
    p = pages.select("url", F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]+)", 1)).alias("host"), F.when(path == "", "/").otherwise(path).alias("path"))
    met = p.join(patterns, "host", "left").withColumn("r", F.when(F.expr("path RLIKE rule"), F.col("r"))).groupBy("url", "host").agg(F.max("r").alias("best"))
    known = met.join(readable.select("host", F.lit(True).alias("readable")), "host", "left").join(exceptions.select("host", F.lit(True).alias("excepted")), "host", "left")
    may = F.coalesce(F.col("best.allow"), F.lit(True))
    allowed = F.when(F.col("readable"), may).otherwise(F.coalesce("excepted", F.lit(False)))
    reason = F.when(F.col("readable"), F.when(may, "").otherwise("disallowed")).when(F.col("excepted"), "exception").otherwise("unreadable")
    return known.select("url", allowed.alias("allowed"), reason.alias("reason"))


_CELL = re.compile(r"([A-Z]+)([0-9]+)")


def _workbook(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row, cells) of a workbook in the open XML format, numbers and texts as text, gaps as null."""
    main, rel = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet"):
            at = targets[sheet.get(f"{rel}id")].lstrip("/")
            for row in ElementTree.fromstring(z.read(at if at.startswith("xl/") else f"xl/{at}")).iter(f"{main}row"):
                cells: list[str | None] = []
                for c in row.iter(f"{main}c"):
                    column = 0
                    for letter in _CELL.match(c.get("r"))[1]:
                        column = column * 26 + ord(letter) - 64
                    cells += [None] * (column - 1 - len(cells))
                    v = c.find(f"{main}v")
                    if c.get("t") == "s" and v is not None:
                        cells.append(shared[int(v.text)])
                    elif c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{main}t")))
                    else:
                        cells.append(v.text if v is not None else None)
                yield sheet.get("name"), int(row.get("r")), cells


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells ARRAY<STRING>) of the workbooks at a path; a file that can't be read gives a row with a null sheet."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[tuple] = []
            for name, content in zip(f["path"], f["content"]):
                try:
                    out += [(name, *r) for r in _workbook(bytes(content))]
                except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
                    out.append((name, None, None, None))
            yield pd.DataFrame(out, columns=["path", "sheet", "row", "cells"]).astype({"row": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sheet string, row int, cells array<string>")

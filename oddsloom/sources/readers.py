"""Readers: documents, logs, feeds, pages and sheets as typed rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest_documents(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """One JSON document a file; of those with one key the newest file's, then the last path's. Broken files are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = rows.select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_path").alias("_path")).where("_corrupt_record is null")
    order = Window.partitionBy(key).orderBy(F.desc("_at"), F.desc("_path"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_at", "_corrupt_record")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of one JSON object a line; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def plain(html: Column) -> Column:
    """Text of a piece of markup."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "(?s)<[^>]*>", " "), r"(?:\s|&nbsp;)+", " "))


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Cells of every table row: ``(key, row, cells)``."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), plain)
    return rows.select(key, "row", cells.alias("cells"))


def carry_forward(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Fills nulls with the last value before them, as dates that head several rows."""
    series = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(series))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Targets and texts of a page's links, by their place."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*\bhref=\"[^\"]*\"[^>]*>.*?</a>)"), F.lit(1))).alias("place", "a"))
    return found.select(key, "place", F.regexp_extract("a", r'(?i)\bhref="([^"]*)"', 1).alias("href"), plain(F.col("a")).alias("text"))


def price_triples(html: Column) -> Column:
    """Prices marked 3, 1 and 0 (home, draw, away) in a piece of markup, as a map."""
    pattern = r'data-value="([310])"[^>]*data-price="([0-9.]+)"'
    keys, values = F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    return F.map_from_arrays(F.transform(keys, lambda k: F.when(k == "3", "home").when(k == "1", "draw").otherwise("away")), F.transform(values, lambda v: v.cast("double")))


def script_arrays(pages: DataFrame, key: str, text: str, name: str = "A") -> DataFrame:
    """Rows of ``A[n]=['x','y, z',3];`` with commas inside quotes kept."""
    rows = pages.select(key, F.explode(F.regexp_extract_all(text, F.lit(rf"(?s)\b{re.escape(name)}\[\d+\]\s*=\s*\[(.*?)\];"), F.lit(1))).alias("body"))
    parts = F.regexp_extract_all("body", F.lit(r"('[^']*'|[^,']+|(?<=,)(?=,))"), F.lit(1))
    return rows.select(key, F.transform(parts, lambda p: F.regexp_replace(F.trim(p), "^'|'$", "")).alias("fields"))


def key_values(text: Column) -> Column:
    """``key: value`` lines as a map with lower-case keys; other lines are left out."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: x.rlike(r"^\s*[\w ]+:"))
    keys = F.transform(lines, lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))))
    return F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("k"), F.trim(F.element_at(F.filter(F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.regexp_replace(x, "^[^:]*:", "").alias("v"))), lambda e: e["k"] == k), -1)["v"]).alias("v"))))


def nested_fixtures(raw: DataFrame, outer: str, inner: str, columns: list[str]) -> DataFrame:
    """Fixtures of an API answer: a list of groups, each with a list of matches."""
    groups = raw.select(F.explode(outer).alias("g"))
    return groups.select(F.explode(f"g.{inner}").alias("m")).select(*[f"m.{c}" for c in columns])


def sheet_rows(spark: SparkSession, path: str, header_row: int = 1) -> DataFrame:
    """Rows of the first sheet of each workbook as ``(path, row, fields)``; the header row names the fields."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def parse(content: bytes) -> Iterator[tuple[int, dict[str, str]]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
            name = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]
            header: dict[str, str] = {}
            for row in ElementTree.fromstring(z.read(name)).iter(f"{ns}row"):
                number, values = int(row.get("r", "0")), {}
                for c in row.iter(f"{ns}c"):
                    v = c.find(f"{ns}v")
                    text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if v is None else v.text or ""
                    values[re.sub(r"\d", "", c.get("r", ""))] = shared[int(text)] if c.get("t") == "s" else text
                if number == header_row:
                    header = values
                elif number > header_row and any(values.values()):
                    yield number, {header[k]: v for k, v in values.items() if k in header}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"]):
                rows = [(p, n, f) for n, f in parse(content)]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "row", "fields"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row int, fields map<string,string>")

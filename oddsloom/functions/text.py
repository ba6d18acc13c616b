"""Scalar functions on names, lines, scores and texts; Spark expressions unless said."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a redacted secret leaves.
MASK = "[redacted]"


def normal_name(name: Column) -> Column:
    """Lower case; digits, a to z and Chinese characters only."""
    return F.regexp_replace(F.lower(name), "[^0-9a-z一-鿿]", "")


def pair_key(home: Column, away: Column) -> Column:
    return F.concat_ws("|", normal_name(home), normal_name(away))


def canonical_match_id(stamp: Column, home: Column, away: Column) -> Column:
    """A stable id from the kickoff's minute and the first ten digits of the names' digest."""
    return F.concat(F.lit("M-"), F.date_format(stamp, "yyyyMMddHHmm"), F.lit("-"), F.substring(F.sha1(pair_key(home, away)), 1, 10))


def canonical_line(text: Column) -> Column:
    """A line in one notation, as text: "2.5/3" and "2.750" are "2.75"; what is no number is its folded words.

    Numbers are decimals throughout, so no digit is lost; an empty line is "".
    """
    folded = F.regexp_replace(F.trim(text), "／", "/")
    parts = F.split(folded, "/")
    number = lambda k: F.trim(F.get(parts, F.lit(k))).try_cast("decimal(18,6)")
    value = F.when(F.size(parts) == 2, ((number(0) + number(1)) / 2).cast("decimal(18,7)")).when(F.size(parts) == 1, number(0).cast("decimal(18,7)"))
    plain = F.regexp_replace(F.regexp_replace(value.cast("string"), r"0+$", ""), r"\.$", "")
    plain = F.when(plain.isin("-0", ""), "0").otherwise(plain)
    return F.when(folded == "", "").otherwise(F.coalesce(plain, F.lower(F.regexp_replace(folded, r"\s+", " "))))


def parse_score(text: Column) -> Column:
    """Home and away goals of "2-1" or "2:1"."""
    home, away = F.regexp_extract(text, r"(\d+)\s*[-:：]\s*(\d+)", 1), F.regexp_extract(text, r"(\d+)\s*[-:：]\s*(\d+)", 2)
    return F.when(home != "", F.struct(home.cast("int").alias("home"), away.cast("int").alias("away")))


def event_minute(text: Column) -> Column:
    """"90+3" counts as 90."""
    return F.regexp_extract(text, r"^(\d+)", 1).try_cast("int")


def scaled_odds(raw: Column) -> Column:
    """Integer odds in units of 1e-5."""
    return F.round(raw.try_cast("double") / 100000, 5)


def redact(text: Column) -> Column:
    """Masks bearer tokens, web tokens, key=value secrets and e-mail addresses."""
    out = F.regexp_replace(text, r"(?i)\bbearer\s+[a-z0-9._~+/=-]+", f"bearer {MASK}")
    out = F.regexp_replace(out, r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", MASK)
    out = F.regexp_replace(out, r"(?i)\b(password|passwd|secret|token|api[_-]?key)(\s*[=:]\s*)[^\s,;]+", f"$1$2{MASK}")
    return F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", MASK)


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    """Letters without marks, other characters as spaces (Unicode decomposition is not in Spark)."""
    def one(x):
        if x is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c))
        return " ".join("".join(c if c.isalnum() else " " for c in plain).split())

    return text.map(one)

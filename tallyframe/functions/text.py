"""String expressions: blank handling, keys, basenames, page text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The characters of the Unicode property White_Space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def strip(col: Column) -> Column:
    """Trim every Unicode blank (``trim`` alone removes only U+0020); no pattern is run."""
    return F.btrim(col, F.lit(BLANKS))


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col.cast("string")), F.lit(""))


def collapse_key(col: Column) -> Column:
    """Comparison key of the merge: blanks collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(col, _BLANK, " ")))


@F.pandas_udf(T.StringType())
def _compatible_fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def compatible_fold(col: Column) -> Column:
    """NFKC and case folding; only texts beyond ASCII enter Python, in Arrow batches."""
    plain = col.rlike(r"^[\x00-\x7f]*\z")
    return F.coalesce(F.when(plain, F.lower(col)), _compatible_fold(F.when(~plain, col)))


def scored_text(col: Column) -> Column:
    """Comparison key of the scoring: NFKC, blanks collapsed, case folded."""
    return F.trim(F.regexp_replace(compatible_fold(col), _BLANK, " "))


def scored_identifier(col: Column) -> Column:
    """Comparison key of identifiers: NFKC, outer blanks off, case folded; inner blanks and hyphens count."""
    return strip(compatible_fold(col))


def redact(col: Column, secrets: list[str]) -> Column:
    """The text with each configured secret replaced by a mark; empty secrets are ignored."""
    for secret in sorted({x for x in secrets if x}, key=len, reverse=True):
        col = F.replace(col, F.lit(secret), F.lit("[redacted]"))
    return col


def basename(col: Column) -> Column:
    """Last path element with either separator; case is kept."""
    return F.substring_index(F.replace(col, F.lit("\\"), F.lit("/")), "/", -1)


def alnum_count(col: Column) -> Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(r"[\p{L}\p{N}]"))


def normalize_currency(col: Column) -> Column:
    """Euro and pound signs and any three letters become upper-case codes; other text is kept."""
    text = blank_to_null(col)
    return (
        F.when(text == "€", "EUR")
        .when(text == "£", "GBP")
        .when(text.rlike(r"^\p{L}{3}$"), F.upper(text))
        .otherwise(text)
    )


def strip_code_fence(col: Column) -> Column:
    return strip(F.regexp_replace(col, r"(?m)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def outer_braces(col: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; null when there is no such span."""
    first = F.instr(col, "{")
    last = F.length(col) - F.instr(F.reverse(col), "}") + 1
    found = (first > 0) & (F.instr(col, "}") > 0) & (last > first)
    return F.when(found, F.substring(col, first, last - first + 1))


def page_ranges(pages: Column) -> Column:
    """``[5, 1, 2, 2]`` becomes ``1-2,5``."""
    ordered = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull())))
    start = F.struct(F.lit("").alias("done"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))

    def close(acc: Column) -> Column:
        run = F.when(acc["lo"] == acc["hi"], acc["lo"].cast("string")).otherwise(
            F.concat_ws("-", acc["lo"].cast("string"), acc["hi"].cast("string"))
        )
        return F.when(acc["lo"].isNull(), acc["done"]).otherwise(
            F.when(acc["done"] == "", run).otherwise(F.concat_ws(",", acc["done"], run))
        )

    def step(acc: Column, page: Column) -> Column:
        return F.when(
            acc["hi"] + 1 == page, F.struct(acc["done"].alias("done"), acc["lo"].alias("lo"), page.alias("hi"))
        ).otherwise(F.struct(close(acc).alias("done"), page.cast("int").alias("lo"), page.cast("int").alias("hi")))

    return F.aggregate(ordered, start, step, close)


def flatten_truncate(col: Column, limit: int) -> Column:
    # The separators U+001C to U+001F are blanks to str.split, not to (?U)\s.
    flat = strip(F.regexp_replace(col, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("...[truncated]"))).otherwise(flat)


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _compatible(col: Column) -> Column:
    plain = col.rlike(r"^[\x00-\x7f]*\z")
    return F.coalesce(F.when(plain, col), _nfkc(F.when(~plain, col)))


def sanitize_filename(col: Column) -> Column:
    """Basename, safe characters, at most 80 of them, always a ``.pdf`` name."""
    stem = F.regexp_replace(basename(_compatible(col)), r"(?i)\.pdf$", "")
    safe = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.concat(F.left(F.when(safe == "", "file").otherwise(safe), F.lit(76)), F.lit(".pdf"))

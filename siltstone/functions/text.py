"""Scalar text functions as Column expressions: canonical form, tokens, extraction, classes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: Characters that canonicalization drops or maps, as regular-expression classes.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
INVISIBLE = r"[\u200B-\u200F\u2028\u2029\uFEFF\u00AD]"
WIDE_BLANK = r"[\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Composed form; of texts of ASCII alone only a null goes to Python."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


#: Canonicalization steps in order: the name that a record's history shows (fixed values) and the Column function.
STEPS = [
    ("nfc", nfc),
    ("crlf_to_lf", lambda c: F.regexp_replace(c, "\r\n?", "\n")),
    ("control_chars_removed", lambda c: F.regexp_replace(c, CONTROL, "")),
    ("zero_width_removed", lambda c: F.regexp_replace(c, INVISIBLE, "")),
    ("nbsp_normalized", lambda c: F.regexp_replace(c, WIDE_BLANK, " ")),
    ("trailing_ws_stripped", lambda c: F.regexp_replace(c, "(?md)[ \t]+$", "")),
    ("blank_lines_collapsed", lambda c: F.regexp_replace(c, "\n{3,}", "\n\n")),
    ("inner_spaces_collapsed", lambda c: F.regexp_replace(c, "[ \t]{2,}", " ")),
    ("edges_trimmed", lambda c: F.btrim(c, F.lit(" \t\n"))),
]


def canonical(df, text: str = "text", out: str = "canonical"):
    """Adds ``out`` and ``transforms``, the names of the steps that changed the text.

    Case, punctuation and stop words are left alone on purpose.
    """
    cur = df.withColumn("_c0", F.coalesce(F.col(text), F.lit("")))
    for i, (_, step) in enumerate(STEPS):
        cur = cur.withColumn(f"_c{i + 1}", step(F.col(f"_c{i}")))
    names = F.array_compact(F.array(*(F.when(F.col(f"_c{i}") != F.col(f"_c{i + 1}"), F.lit(n)) for i, (n, _) in enumerate(STEPS))))
    cur = cur.withColumn("transforms", names).withColumn(out, F.col(f"_c{len(STEPS)}"))
    return cur.drop(*(f"_c{i}" for i in range(len(STEPS) + 1)))


def words(c: Column) -> Column:
    """White-space tokens of a canonical text, without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def let(c: Column, body) -> Column:
    """``body`` over ``c`` as a lambda variable: ``c`` is evaluated once, however often ``body`` names it."""
    return F.transform(F.array(c), body)[0]


def ngrams(tokens: Column, k: int, least: int | None = None) -> Column:
    """Word k-grams in order, with repeats; none with fewer than ``least`` (or k) tokens."""

    def grams(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(F.size(t) >= max(k, least or k), every).otherwise(F.array().cast("array<string>"))

    return let(tokens, grams)


def shingles(tokens: Column, k: int = 5, least: int = 8) -> Column:
    """Distinct word k-grams; texts under ``least`` tokens have none."""
    return F.array_distinct(ngrams(tokens, k, least))


def weakness_ids(c: Column) -> Column:
    """Distinct upper-cased weakness identifiers of a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("(?i)CWE-[0-9]+"), F.lit(0)), F.upper)))


def norm_id(c: Column) -> Column:
    return F.upper(F.trim(c))


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def norm_enum(c: Column) -> Column:
    return F.upper(_filled(c))


def norm_vector(c: Column) -> Column:
    return F.replace(F.upper(_filled(c)), F.lit(" "), F.lit(""))


def folded(c: Column) -> Column:
    return F.lower(_filled(c))


def unfenced(c: Column) -> Column:
    """Model output without a surrounding code fence: the fence and a ``json`` tag go, text ends at the last fence.

    A fence that is never closed leaves the output as it is.
    """
    s = F.btrim(c, F.lit(" \t\n\r\f\u000b"))
    body = F.regexp_replace(F.substr(s, F.lit(4)), r"^(?i:json)", "")
    cut = F.length(body) - F.length(F.substring_index(body, "```", -1)) - 3
    inner = F.btrim(F.substr(body, F.lit(1), F.greatest(cut, F.lit(0))), F.lit(" \t\n\r\f\u000b"))
    return F.when(s.startswith("```") & body.contains("```"), inner).otherwise(s)


def letter(c: Column) -> Column:
    """The answer letter A to D: the first that stands alone, else the first character."""
    up = F.upper(F.trim(c))
    alone = F.regexp_extract(up, r"\b([ABCD])\b", 1)
    return F.when(alone != "", alone).when(F.substring(up, 1, 1).isin("A", "B", "C", "D"), F.substring(up, 1, 1))


def shape(c: Column) -> Column:
    """Class of a completion, the first that fits (labels are fixed values)."""
    s = F.btrim(c, F.lit(" \t\n\r"))
    return (
        F.when(s.rlike(r'(?s)^\{\s*"[^"]*"\s*:\s*"[^"]*"\s*\}$'), "bare JSON object, one key")
        .when(s.startswith("```"), "markdown fence around the JSON")
        .when(F.length(c) - F.length(F.replace(c, F.lit("{"), F.lit(""))) > 1, "more than one JSON object")
        .when(s.contains("\n"), "multi-line, JSON plus other text")
        .otherwise("single line, not a bare object")
    )


def bad_char_ratio(c: Column) -> Column:
    """Share of replacement and control characters; 1 for an empty text."""
    n = F.length(c)
    bad = n - F.length(F.regexp_replace(c, "[�\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]", ""))
    return F.when(n > 0, bad / n).otherwise(F.lit(1.0))


@F.pandas_udf(IntegerType())
def longest_repeat(texts: pd.Series) -> pd.Series:
    """Words in the longest run of an immediately repeated word n-gram, n up to 40."""

    def run(t: str | None) -> int:
        w = (t or "").split()
        best = 0
        for n in range(1, min(40, len(w) // 2) + 1):
            same = 0
            for i in range(n, len(w)):
                same = same + 1 if w[i] == w[i - n] else 0
                if same >= n:
                    best = max(best, (same // n + 1) * n)
        return best

    return texts.map(run)


def numbers(c: Column) -> Column:
    """Numeric literals of a document, outside comments, code, link targets, URLs and identifiers."""
    s = c
    for p in (r"(?s)<!--.*?-->", r"(?s)```.*?```", r"`[^`\n]*`", r"\]\([^)]*\)", r"https?://\S+", r"(?<![A-Za-z0-9._-])(?=[A-Za-z0-9._-]*[0-9])[A-Za-z][A-Za-z0-9._-]*"):
        s = F.regexp_replace(s, p, " ")
    return F.regexp_extract_all(s, F.lit(r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"), F.lit(0))

"""Text columns: normalisation, masking, control characters, and the attribute patterns of a caption."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Arabic-Indic and Persian digits, and the invisible characters that captions carry.
FOREIGN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "01234567890123456789"
INVISIBLE = "[​-‏‪-‮⁠-⁤⁦-⁩﻿­]"

# (?U) gives \s, \d, \w and \b their Unicode meaning.
U = "(?U)"


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Spark has no builtin; only rows with a non-ASCII character are sent to Python with their text,
    the others travel as nulls and keep their own value."""
    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")

    plain = ~text.rlike("[^\\x00-\\x7F]")
    return F.coalesce(F.when(plain, text), compose(F.when(~plain, text)))


def caption_form(text: Column) -> Column:
    """NFKC, single spaces, case-folded: the form in which two captions are equal. Folding and NFKC differ from `lower`
    only outside ASCII, so only such rows carry text to Python."""
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda v: " ".join(unicodedata.normalize("NFKC", v).split()).casefold(), na_action="ignore")

    plain = ~text.rlike("[^\\x00-\\x7F]")
    return F.coalesce(F.when(plain, F.lower(squeeze(text))), fold(F.when(~plain, text)))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`. Naming a column is not enough: the optimizer copies an expression
    into every place that mentions it, and a regex chain copied ten times runs ten times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, U + r"\s+", " "))


def clean_text(composed: Column) -> Column:
    """The native part of text normalisation, for text that is already NFKC."""
    ascii_digits = F.translate(composed, FOREIGN_DIGITS, ASCII_DIGITS)
    return squeeze(F.lower(F.regexp_replace(ascii_digits, INVISIBLE, "")))


def normalise_text(text: Column) -> Column:
    """NFKC, ASCII digits, no invisible characters, lower case, single spaces."""
    return clean_text(nfkc(text))


def mask_digits(text: Column) -> Column:
    """Every run of at least seven digits keeps its first two digits; the rest become `*`. Longer runs go first so a
    run that is part of a longer one is not replaced inside it."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d{7,}"), F.lit(0)))
    longest_first = F.array_sort(runs, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(
        longest_first, text,
        lambda acc, run: F.replace(acc, run, F.rpad(F.substring(run, 1, 2), F.length(run), F.lit("*"))))


def strip_controls(text: Column, keep_newlines: bool = True, replacement: str = "") -> Column:
    pattern = r"[\x00-\x09\x0b-\x1f\x7f]" if keep_newlines else r"[\x00-\x1f\x7f]"
    return F.regexp_replace(text, pattern, replacement)


def notification_text(text: Column, limit: int) -> Column:
    return F.substring(strip_controls(text, keep_newlines=False, replacement=" "), 1, limit)

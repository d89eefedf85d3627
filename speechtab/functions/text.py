"""Column expressions on text: normalisation, scripts, tokens, URLs, repairs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Punctuation that normalisation turns to spaces, and that tagging deletes; what ends and starts a word.
NORMAL_PUNCTUATION = r"[,.!?;:\"'()\[\]{}\-–—…]"
TAG_PUNCTUATION = r"[,.!?;:\"'()\[\]]"
WORD_TAIL = "।,!?;:.\"'-–—"
WORD_HEAD = "\"'"
DEVANAGARI = "[ऀ-ॿ꣠-ꣿ]"
SPACES = r"(?U)\s+"


def nfc(text: Column) -> Column:
    """Unicode composition, for which Spark has no built-in; null stays null."""
    return F.pandas_udf(_composed, "string")(text)


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalize_text(text: Column, composed: bool = False) -> Column:
    """Composed, lower-case text without punctuation, single-spaced; null gives "". ``composed``: it is NFC already."""
    text = F.coalesce(text, F.lit(""))
    text = text if composed else nfc(text)
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, NORMAL_PUNCTUATION, " ")), SPACES, " "))


def is_devanagari(char: Column) -> Column:
    return F.rlike(char, F.lit(f"^{DEVANAGARI}$"))


def count_class(text: Column, chars: str) -> Column:
    """The number of characters of ``text`` within a regex class given without brackets."""
    return F.length(F.regexp_replace(text, f"[^{chars}]", ""))


def is_devanagari_word(word: Column) -> Column:
    """More Devanagari characters than half of the letters (marks aren't letters); false without letters."""
    letters = count_class(word, r"\p{L}")
    return F.when(letters > 0, count_class(word, "ऀ-ॿ꣠-ꣿ") / letters > 0.5).otherwise(F.lit(False))


def is_roman_word(word: Column) -> Column:
    return F.rlike(word, F.lit("[A-Za-z]"))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, "[।.?!]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def words(text: Column) -> Column:
    """White-space separated tokens, without empty ones."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def normalize_word(word: Column) -> Column:
    """Without closing punctuation and opening quotes, in lower case."""
    word = F.regexp_replace(word, r"(?U)^\s+|\s+$", "")
    return F.lower(F.ltrim(F.rtrim(word, F.lit(WORD_TAIL)), F.lit(WORD_HEAD)))


def rewrite_url(url: Column, old: str, new: str) -> Column:
    return F.replace(url, F.lit(old), F.lit(new))


def recording_id(url: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"_(audio|transcription|metadata)\.\w+$", "")


def user_folder(url: Column) -> Column:
    parts = F.split(F.rtrim(url, F.lit("/")), "/")
    return F.get(parts, F.size(parts) - 2)


def repair(text: Column) -> Column:
    """The repair rules for typical model errors, then single spaces."""
    text = F.regexp_replace(text, "([कखगघ])([^ं])([पबमभ])", "$1ं$2$3")
    text = F.replace(text, F.lit("हे"), F.lit("है"))
    text = F.regexp_replace(text, r"(?U)(?<![\p{L}\p{N}_])अ\s", " ")
    text = F.regexp_replace(text, r"(?<![\p{L}\p{N}_])हम्म(?![\p{L}\p{N}_])", "")
    return F.trim(F.regexp_replace(text, SPACES, " "))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", 100.0 * part / whole)


def thousands(n: Column) -> Column:
    """A whole number with commas between its thousands."""
    return F.format_number(n, 0)


def register(spark: SparkSession) -> None:
    """Makes ``normalize_text`` known to SQL."""

    def normalized(texts: pd.Series) -> pd.Series:
        plain = _composed(texts.fillna("")).str.replace(NORMAL_PUNCTUATION, " ", regex=True).str.lower()
        return plain.str.replace(r"\s+", " ", regex=True).str.strip(" ")

    spark.udf.register("normalize_text", F.pandas_udf(normalized, "string"))

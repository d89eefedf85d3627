"""English words in Hindi text: detection and tagging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechtab import vocab
from speechtab.functions.text import TAG_PUNCTUATION, is_roman_word, words


def ends_with_any(word: Column, suffixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(word, F.lit(s)) for s in suffixes])


def method(token: Column) -> Column:
    """How a token shows as English: roman_script, dictionary or suffix_pattern; null if it doesn't."""
    clean = F.regexp_replace(token, TAG_PUNCTUATION, "")
    return (
        F.when(clean == "", F.lit(None).cast("string"))
        .when(is_roman_word(clean), "roman_script")
        .when(clean.isin(*vocab.LOANWORDS), "dictionary")
        .when((F.length(clean) > 3) & ends_with_any(clean, vocab.TAG_SUFFIXES), "suffix_pattern")
    )


def detect(text: Column) -> Column:
    """Array of (word, position, method) of the English words."""
    found = F.transform(words(text), lambda w, i: F.struct(w.alias("word"), i.alias("position"), method(w).alias("method")))
    return F.filter(found, lambda x: x["method"].isNotNull())


def tag(text: Column | str) -> Column:
    """English words within [EN] marks; text without any stays as it is."""
    text = F.col(text) if isinstance(text, str) else text
    marked = F.transform(words(text), lambda w: F.when(method(w).isNotNull(), F.concat(F.lit("[EN]"), w, F.lit("[/EN]"))).otherwise(w))
    return F.when(F.size(detect(text)) == 0, text).otherwise(F.array_join(marked, " "))


def is_english_in_devanagari(word: Column) -> Column:
    return word.isin(*vocab.LOANWORDS) | ((F.length(word) > 4) & ends_with_any(word, vocab.SPELL_SUFFIXES))

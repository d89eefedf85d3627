"""Spelling of Devanagari words: structural issues and the rule cascade."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechtab import vocab
from speechtab.functions.english import ends_with_any, is_english_in_devanagari
from speechtab.functions.text import DEVANAGARI, count_class, is_devanagari, is_devanagari_word

# Patterns of invalid words, as reported and as Java takes them (the same here).
INVALID_PATTERNS = [
    r"(.)\1{3,}",
    f"[{vocab.PLAIN_MATRAS}]{{3,}}",
    "्{2,}",
    f"^[{vocab.PLAIN_MATRAS}]",
    "[ंँ]{2,}",
]


def issues(word: Column) -> Column:
    """Array of the structural issues of a word, in order: patterns, foreign characters, a leading vowel sign."""
    patterns = [F.when(F.rlike(word, F.lit(p)), F.lit(f"Invalid pattern: {p}")) for p in INVALID_PATTERNS]
    odd = F.filter(F.split(word, ""), lambda c: (c != "") & ~F.rlike(c, F.lit(rf"^(?:{DEVANAGARI}|[{vocab.MATRAS}{vocab.HALANT}{vocab.NUKTA}.-]|\p{{Nd}}|[\x00-\x7F])$")))
    code = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0{1,4}", "")
    chars = F.transform(odd, lambda c: F.concat(F.lit("Non-Devanagari char: '"), c, F.lit("' (U+"), code(c), F.lit(")")))
    lead = F.when(F.rlike(word, F.lit(f"^[{vocab.MATRAS}]")), F.lit("Starts with a matra (vowel sign)"))
    return F.filter(F.concat(F.array(*patterns), chars, F.array(lead)), lambda x: x.isNotNull())


def classify(word: Column) -> Column:
    """Struct of classification, confidence and reason: the first rule that holds decides. Null counts as empty."""
    word = F.coalesce(word, F.lit(""))

    def verdict(good: bool, confidence: str, reason: Column | str) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(
            F.lit("correct" if good else "incorrect").alias("classification"),
            F.lit(confidence).alias("confidence"), reason.alias("reason"),
        )

    letters = F.regexp_replace(word, r"[^\p{L}]", "")
    suffix = ends_with_any(word, vocab.VALID_SUFFIXES)
    no_devanagari = count_class(word, "ऀ-ॿ꣠-ꣿ") == 0
    return (
        F.when(F.rlike(word, F.lit(r"(?U)^\s*$")), verdict(False, "high", "Empty or whitespace-only word"))
        .when(F.rlike(word, F.lit(r"^(?:\p{Nd}+|[.,;:!?-]+)$")), verdict(True, "high", "Number or punctuation"))
        .when((F.length(word) == 1) & is_devanagari(word), verdict(True, "medium", "Single Devanagari character (could be abbreviation or particle)"))
        .when(F.rlike(word, F.lit("^[A-Za-z]$")), verdict(True, "medium", "Single Latin character (abbreviation)"))
        .when(F.rlike(letters, F.lit("^[A-Za-z]+$")), verdict(True, "medium", "Roman script word (English in conversation - per guidelines, Devanagari form is expected)"))
        .when(~is_devanagari_word(word) & no_devanagari, verdict(False, "high", "Non-Devanagari script (potentially Urdu/Arabic script in Devanagari context)"))
        .when(is_english_in_devanagari(word), verdict(True, "high", "English word in Devanagari (correct per transcription guidelines)"))
        .when(F.size(issues(word)) > 0, verdict(False, "high", F.concat(F.lit("Invalid Devanagari structure: "), F.array_join(issues(word), "; "))))
        .when(word.isin(*vocab.COMMON_WORDS), verdict(True, "high", "Common Hindi word (high-frequency)"))
        .when((F.length(word) > 20) & ~F.contains(word, F.lit(vocab.HALANT)), verdict(False, "medium", "Unusually long word without conjuncts (possible word concatenation)"))
        .when(suffix, verdict(True, "medium", "Passes structural checks with valid Hindi suffix"))
        .otherwise(verdict(True, "low", "Passes structural checks; not in reference dictionary (low confidence)"))
    )


def analysis(word: Column) -> list[Column]:
    """The columns of a low-confidence review."""
    return [
        F.length(word).cast("long").alias("char_count"),
        F.contains(word, F.lit(vocab.HALANT)).alias("has_halant"),
        F.contains(word, F.lit(vocab.NUKTA)).alias("has_nukta"),
        (F.contains(word, F.lit("ं")) | F.contains(word, F.lit("ँ"))).alias("has_anusvara"),
        is_devanagari_word(word).alias("is_devanagari"),
    ]

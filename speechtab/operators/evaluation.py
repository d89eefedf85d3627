"""Evaluation: word error rates of models' transcripts, their comparison, and what the repair rules change.

Rates are unrounded here; the sheets at the end round them to four digits. A reference without words gives a rate of 0,
a null transcript counts as empty, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechtab.functions import edit
from speechtab.functions import text as T
from speechtab.operators import reports
from speechtab.operators.errors import category_table


def with_fallback(df: DataFrame) -> DataFrame:
    """``reference_normalized`` and ``hypothesis_normalized``; where one is missing, the plain text, else ""."""
    sides = ("reference", "hypothesis")
    return df.withColumns({f"{s}_normalized": F.coalesce(f"{s}_normalized", s, F.lit("")) for s in sides})


def word_rate(edits: Column, words: Column) -> Column:
    return F.when(words > 0, edits / words).otherwise(F.lit(0.0))


def evaluate(df: DataFrame) -> DataFrame:
    """Adds both normalised texts, edits, ref_words and wer to rows with reference and hypothesis."""
    out = df.withColumns({f"{s}_normalized": T.normalize_text(F.col(s)) for s in ("reference", "hypothesis")})
    ref, hyp = T.words(F.col("reference_normalized")), T.words(F.col("hypothesis_normalized"))
    out = out.withColumns({"edits": edit.word_distance(ref, hyp), "ref_words": F.size(ref).cast("long")})
    return out.withColumn("wer", word_rate(F.col("edits"), F.col("ref_words")))


def evaluate_models(df: DataFrame) -> DataFrame:
    """model, edits, ref_words, num_samples, wer over the whole corpus of each model."""
    return reports.corpus_wer(evaluate(df).select("model", "edits", "ref_words"), "model")


def improvement(corpus: DataFrame, before: str, after: str) -> DataFrame:
    """before, after, improvement: the rates of two models of ``evaluate_models`` and their difference."""
    rate = lambda m: F.max(F.when(F.col("model") == m, F.col("wer")))
    both = corpus.agg(rate(before).alias("before"), rate(after).alias("after"))
    return both.withColumn("improvement", F.col("before") - F.col("after"))


def repair_evaluation(samples: DataFrame) -> DataFrame:
    """Adds after (the repaired hypothesis), wer_before, wer_after and improved.

    The reference is ``reference_normalized`` where that column has a text, else the plain one; it is not normalised
    again, but the hypotheses are, before and after the repair.
    """
    ref = F.col("reference")
    if "reference_normalized" in samples.columns:
        ref = F.coalesce("reference_normalized", "reference")
    words = T.words(F.coalesce(ref, F.lit("")))
    out = samples.withColumn("after", T.repair(F.coalesce("hypothesis", F.lit(""))))
    n = F.size(words)
    rate = lambda c: word_rate(edit.word_distance(words, T.words(T.normalize_text(F.col(c)))), n)
    out = out.withColumns({"wer_before": rate("hypothesis"), "wer_after": rate("after")})
    return out.withColumn("improved", F.col("wer_after") < F.col("wer_before"))


def improved_count(repaired: DataFrame) -> DataFrame:
    return repaired.agg(F.count("*").alias("total"), F.count_if("improved").alias("improved"))


def taxonomy_rows(evidence: DataFrame, examples: int = 3) -> DataFrame:
    """rank, k, category, count, description, reference, hypothesis, evidence: of each category the first ``examples`` labels.

    ``evidence`` comes from ``errors.evidence_rows``. Categories stand by falling count, equal counts by first encounter.
    """
    counts = evidence.groupBy("category").agg(F.count("*").alias("count"), F.min("ord").alias("first_seen"))
    # One row per category, and categories are a fixed list: a window over all of them is small.
    counts = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "first_seen")))
    place = F.row_number().over(Window.partitionBy("category").orderBy("ord"))
    first = evidence.withColumn("k", place).where(F.col("k") <= examples)
    known = F.broadcast(category_table(evidence.sparkSession))
    return first.join(counts, "category").join(known, "category", "left").select(
        "rank", "k", F.coalesce("name", "category").alias("category"), "count", F.coalesce("description", F.lit("")).alias("description"),
        "reference", "hypothesis", "evidence",
    )


def taxonomy_sheet(rows: DataFrame) -> DataFrame:
    """The sheet of ``taxonomy_rows``, in its order and with its headings."""
    return rows.orderBy("rank", "k").select(
        F.col("category").alias("Category"), F.col("count").alias("Count"), F.col("description").alias("Description"),
        F.col("reference").alias("Example_Reference"), F.col("hypothesis").alias("Example_Hypothesis"), F.col("evidence").alias("Evidence"),
    )


def repair_sheet(repaired: DataFrame, order: str, rows: int = 15) -> DataFrame:
    """The first ``rows`` samples by ``order``, rates rounded to four digits."""
    return repaired.orderBy(order).limit(rows).select(
        F.col("reference").alias("Reference"), F.col("hypothesis").alias("Before_Fix"), F.col("after").alias("After_Fix"),
        F.round("wer_before", 4).alias("WER_Before"), F.round("wer_after", 4).alias("WER_After"), F.col("improved").alias("Improved"),
    )

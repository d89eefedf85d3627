"""Sinks: CSV and JSON reports. Reports are small results; writers keep Spark's distributed output folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """UTF-8 with a header, overwritten; one file for reports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, encoding="UTF-8", quoteAll=False, escape='"')


def write_json(df: DataFrame, path: str, single: bool = True) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path, encoding="UTF-8")


def wer_results(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("model").alias("Model"), F.format_string("%.4f", "wer").alias("Hindi WER"), F.col("num_samples").alias("Num Samples"))


def predictions_json(predictions: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object of arrays, keyed by model; meant for evaluation sets."""
    rows = predictions.groupBy("model").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    return rows.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "rows"))))).alias("value"))


def english_tagged(found: DataFrame, text: str) -> DataFrame:
    """The tagging sheet: methods are sorted, so the result is the same in every run."""
    said = F.array_join("found.word", ", ")
    how = F.array_join(F.array_sort(F.array_distinct("found.method")), ", ")
    none = F.size("found") == 0
    return found.select(
        F.col(text).alias("Original Transcript"), F.col("tagged").alias("Tagged Transcript"), F.when(none, "None").otherwise(said).alias("English Words Found"),
        F.col("english_words").alias("Count"), F.when(none, "N/A").otherwise(how).alias("Detection Methods"),
    )


def cleanup_sheet(examples: DataFrame) -> DataFrame:
    return examples.select(F.col("kind").alias("Type"), F.col("before").alias("Before (Raw ASR)"), F.col("after").alias("After (Normalized)"), F.col("reference").alias("Human Reference"), F.col("note").alias("Note/Reasoning"))


def report_json(summary: DataFrame, **parts: DataFrame) -> DataFrame:
    """One JSON object: the columns of the one-row ``summary`` and each part as an array (parts are bounded reports)."""
    out = summary
    for name, part in parts.items():
        out = out.crossJoin(part.agg(F.collect_list(F.struct(*part.columns)).alias(name)))
    return out.select(F.to_json(F.struct(*out.columns)).alias("value"))


def first_rows(df: DataFrame, order: str, rows: int, *columns: str) -> DataFrame:
    """The first ``rows`` rows by ``order`` (a report's feature), as ``columns``."""
    return df.orderBy(order).limit(rows).select(*columns)


def cleanup_results(pairs: DataFrame, examples: DataFrame, order: str, rows: int = 50) -> DataFrame:
    """The clean-up report: counts over all ``pairs`` (raw, normalized, reference), the examples and the first pairs."""
    summary = pairs.agg(F.count("*").alias("total_pairs"), F.count_if(F.col("raw") != F.col("normalized")).alias("modified_count"))
    return report_json(summary, examples=examples, all_pairs=first_rows(pairs, order, rows, "raw", "normalized", "reference"))


def english_results(found: DataFrame, text: str, order: str, rows: int = 100) -> DataFrame:
    """The tagging report: counts over all rows of ``reports.english_table``, and the first rows."""
    count = F.col("english_words")
    summary = found.agg(F.count("*").alias("total_transcripts"), F.count_if(count > 0).alias("transcripts_with_english"), F.coalesce(F.sum(count), F.lit(0)).alias("total_english_words_found"))
    return report_json(summary, results=first_rows(found, order, rows, text, "tagged", "english_words", "found"))

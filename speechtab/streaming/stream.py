"""Streaming twins of the row-wise operators, beyond the batch engine: tagging, and corpus WER per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab.functions import english
from speechtab.functions.numbers import convert_numbers


def cleaned(transcripts: DataFrame, text: str = "text") -> DataFrame:
    """Numbers converted and English words tagged; stateless, so it runs on batches and streams alike."""
    return transcripts.withColumn("normalized", convert_numbers(F.col(text))).withColumn("tagged", english.tag(F.col(text)))


def windowed_wer(scored: DataFrame, time: str, model: Column, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Corpus WER per window and model of a stream of rows (edits, ref_words)."""
    rows = scored.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), model.alias("model"))
    out = rows.agg(F.sum("edits").alias("edits"), F.sum("ref_words").alias("ref_words"))
    return out.withColumn("wer", F.when(F.col("ref_words") > 0, F.col("edits") / F.col("ref_words")).otherwise(0.0))

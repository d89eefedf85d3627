"""Aggregations behind the reports: WER, English words, spelling, manifests, clean-up examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab import vocab
from speechtab.functions import english, spelling
from speechtab.functions.english import ends_with_any


def corpus_wer(df: DataFrame, *keys: str) -> DataFrame:
    """edits, ref_words and their ratio over rows (edits, ref_words)."""
    out = df.groupBy(*keys).agg(F.sum("edits").alias("edits"), F.sum("ref_words").alias("ref_words"), F.count("*").alias("num_samples"))
    return out.withColumn("wer", F.when(F.col("ref_words") > 0, F.col("edits") / F.col("ref_words")).otherwise(0.0))


def manifest_stats(df: DataFrame, duration: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n"), (F.sum(duration) / 3600).alias("hours"), F.avg(duration).alias("avg_s"), F.min(duration).alias("min_s"), F.max(duration).alias("max_s"))


def english_table(df: DataFrame, text: Column) -> DataFrame:
    """Adds found (detections), tagged, english_words and total_words; rows without text are dropped."""
    from speechtab.functions.text import words

    rows = df.where(text.isNotNull() & (text != "")).withColumn("found", english.detect(text))
    return rows.withColumn("tagged", english.tag(text)).withColumn("english_words", F.size("found").cast("long")).withColumn("total_words", F.size(words(text)).cast("long"))


def english_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("transcripts"), F.count_if(F.col("english_words") > 0).alias("with_english"), F.coalesce(F.sum("english_words"), F.lit(0)).alias("english_words"))


def top_words(found: DataFrame, order: str, k: int = 10) -> DataFrame:
    """word, n of the ``k`` most frequent English words; ties in order of first sight."""
    rows = found.select(order, F.explode("found").alias("f"))
    counts = rows.groupBy("f.word").agg(F.count("*").alias("n"), F.min(F.struct(order, "f.position")).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(k).select("word", "n")


def spelled(words: DataFrame) -> DataFrame:
    """``words`` (word) with classification, confidence and reason."""
    return words.withColumn("_c", spelling.classify(F.col("word"))).select("*", "_c.*").drop("_c")


def spelling_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("classification", "confidence").agg(F.count("*").alias("n"))


def unreliable(classified: DataFrame) -> DataFrame:
    """category, total, low_confidence of the two kinds of words that the rules can't judge; empty kinds are left out."""
    low = F.col("confidence") == "low"
    nukta = classified.where(F.contains("word", F.lit(vocab.NUKTA))).agg(F.count("*").alias("total"), F.count_if(low).alias("low_confidence"))
    names = classified.where(low & (F.length("word") > 5) & ~ends_with_any(F.col("word"), vocab.VALID_SUFFIXES)).agg(F.count("*").alias("total"), F.count("*").alias("low_confidence"))
    nukta = nukta.select(F.lit("Words with nukta (़)").alias("category"), "*")
    return nukta.union(names.select(F.lit("Proper nouns and named entities").alias("category"), "*")).where("total > 0")


def labelled(spelled_words: DataFrame) -> DataFrame:
    """The spelling sheet's columns."""
    label = F.concat("classification", F.lit(" spelling"))
    return spelled_words.select(F.col("word").alias("Word"), label.alias("Classification"), F.col("confidence").alias("Confidence"), F.col("reason").alias("Reason"))


# Examples that fill up a report (kind, before, after, reference, note).
SYNTHETIC = [
    ("Correct Conversion", "मेरे पास दो किताबें हैं", "मेरे पास 2 किताबें हैं", "मेरे पास 2 किताबें हैं", "Simple number: दो → 2"),
    ("Correct Conversion", "तीन सौ चौवन रुपये लगे", "354 रुपये लगे", "354 रुपये लगे", "Compound number: तीन सौ चौवन → 354"),
    ("Correct Conversion", "पच्चीस लोग आए थे", "25 लोग आए थे", "25 लोग आए थे", "Direct compound: पच्चीस → 25"),
    ("Correct Conversion", "एक हज़ार रुपये दे दो", "1000 रुपये दे दो", "1000 रुपये दे दो", "Thousand: एक हज़ार → 1000"),
    ("Edge Case", "दो-चार बातें कर लो", "दो-चार बातें कर लो", "दो-चार बातें कर लो", "IDIOM: 'दो-चार' means 'a few', not literally 2-4. The hyphenated pattern signals idiomatic usage. Converting would change the meaning."),
    ("Edge Case", "एक-दो दिन में हो जाएगा", "एक-दो दिन में हो जाएगा", "एक-दो दिन में हो जाएगा", "APPROXIMATE EXPRESSION: 'एक-दो' means 'one or two' approximately. Hyphenated numbers typically indicate approximation, not exact counts."),
    ("Edge Case", "नौ दो ग्यारह हो गया", "नौ दो ग्यारह हो गया", "नौ दो ग्यारह हो गया", "IDIOM: 'नौ दो ग्यारह' is a Hindi idiom meaning 'to flee'. Converting to '9 2 11' would lose the idiomatic meaning entirely."),
]


def synthetic(spark: SparkSession) -> DataFrame:
    names = ("kind", "before", "after", "reference", "note")
    rows = [F.struct(F.lit(i).alias("ord"), *[F.lit(v).alias(k) for k, v in zip(names, r, strict=True)]) for i, r in enumerate(SYNTHETIC)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def cleanup_examples(pairs: DataFrame, order: str) -> DataFrame:
    """The first 5 changed rows of ``pairs`` (raw, normalized, reference), filled up to 4 with synthetic ones, and 3 edge cases."""
    changed = pairs.where(F.col("raw") != F.col("normalized")).orderBy(order).limit(5)
    real = changed.select(F.lit("Correct Conversion").alias("kind"), F.col("raw").alias("before"), F.col("normalized").alias("after"), "reference", F.lit("").alias("note"))
    fill = synthetic(pairs.sparkSession).crossJoin(F.broadcast(real.agg(F.count("*").alias("have"))))
    wanted = (F.col("kind") == "Edge Case") | (F.col("ord") < 4 - F.col("have"))
    return real.union(fill.where(wanted).select("kind", "before", "after", "reference", "note"))

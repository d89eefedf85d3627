"""Error analysis: multi-label classification of reference and hypothesis, taxonomy, fixes, repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechtab import vocab
from speechtab.functions import text as T
from speechtab.operators.sampling import SEVERITIES


def _swapped(r: Column, h: Column, swaps: list[str]) -> Column:
    pairs = [s.split(">") for s in swaps]
    return reduce(lambda a, b: a | b, [F.contains(r, F.lit(a)) & (F.replace(r, F.lit(a), F.lit(b)) == h) for a, b in pairs])


def _label(category: str, evidence: Column | str) -> Column:
    return F.struct(F.lit(category).alias("category"), (F.lit(evidence) if isinstance(evidence, str) else evidence).alias("evidence"))


def classify_error(reference: Column, hypothesis: Column) -> Column:
    """Array of (category, evidence) in rule order; ``other`` where no rule holds."""
    r, h = T.words(reference), T.words(hypothesis)
    diff = F.size(r) - F.size(h)
    whole = F.array(
        F.when(diff > 0, _label("insertion_deletion", F.format_string("Deletion: %d word(s) dropped", diff)))
        .when(diff < 0, _label("insertion_deletion", F.format_string("Insertion: %d extra word(s)", -diff))),
        F.when((F.array_join(r, "") == F.array_join(h, "")) & (r != h), _label("word_boundary_error", "Words merged or split differently")),
        F.when(F.exists(r, T.is_roman_word), _label("code_switching_error", F.concat(F.lit("English word in reference: "), F.get(F.filter(r, T.is_roman_word), F.lit(0))))),
    )
    n = F.least(F.size(r), F.size(h))
    pairs = F.filter(F.arrays_zip(F.slice(r, F.lit(1), n).alias("r"), F.slice(h, F.lit(1), n).alias("h")), lambda p: p["r"] != p["h"])

    def of_pair(p: Column) -> Column:
        said = F.concat(F.lit("'"), p["r"], F.lit("' → '"), p["h"], F.lit("'"))
        nasal = reduce(lambda a, b: a | b, [F.contains(p["r"], F.lit(c)) != F.contains(p["h"], F.lit(c)) for c in vocab.NASALS])
        return F.array(
            F.when(_swapped(p["r"], p["h"], vocab.VOWEL_SWAPS), _label("vowel_matra_error", said)),
            F.when(_swapped(p["r"], p["h"], vocab.CONSONANT_SWAPS), _label("consonant_confusion", said)),
            F.when(nasal, _label("visarga_anusvara", F.concat(said, F.lit(" (nasal mark)")))),
        )

    fillers = []
    for f in vocab.FILLERS:
        in_r, in_h = F.contains(reference, F.lit(f)), F.contains(hypothesis, F.lit(f))
        fillers.append(F.when(in_r & ~in_h, _label("punctuation_filler", f"Filler '{f}' missed")).when(~in_r & in_h, _label("punctuation_filler", f"Filler '{f}' inserted")))
    found = F.filter(F.concat(whole, F.flatten(F.transform(pairs, of_pair)), F.array(*fillers)), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(_label("other", "Unclassified error"))).otherwise(found)


def evidence_rows(samples: DataFrame, order: str) -> DataFrame:
    """One row per sample and label, with ord, the sample's rank by severity and ``order``, and the label's place."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    labels = F.posexplode(classify_error(F.col("reference"), F.col("hypothesis"))).alias("place", "label")
    return samples.withColumn("sev", rank).select("*", labels).select("*", F.struct("sev", order, "place").alias("ord"), "label.category", "label.evidence").drop("label")


def taxonomy(evidence: DataFrame, examples: int = 5) -> DataFrame:
    """category, n, first_seen and up to ``examples`` evidences, in encounter order."""
    counts = evidence.groupBy("category").agg(F.count("*").alias("n"), F.min("ord").alias("first_seen"))
    top = evidence.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("ord"))).where(F.col("k") <= examples)
    shown = top.groupBy("category").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "evidence"))), lambda x: x["evidence"]).alias("examples"))
    return counts.join(shown, "category")


def category_table(spark: SparkSession) -> DataFrame:
    rows = [F.struct(*[F.lit(v).alias(k) for k, v in zip(("category", "name", "description", "fix", "actionable"), c, strict=True)]) for c in vocab.CATEGORIES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def top_fixes(tax: DataFrame, k: int = 3) -> DataFrame:
    """rank, category, category_key, count, proposed_fix, actionable of the ``k`` most frequent categories."""
    top = tax.orderBy(F.desc("n"), "first_seen").limit(k)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first_seen")))  # at most k rows
    known = F.broadcast(category_table(tax.sparkSession))
    other = next(c for c in vocab.CATEGORIES if c[0] == "other")
    return top.join(known, "category", "left").select(
        "rank", F.coalesce("name", "category").alias("category"), F.col("category").alias("category_key"), F.col("n").alias("count"),
        F.coalesce("fix", F.lit(other[3])).alias("proposed_fix"), F.coalesce("actionable", F.lit(False)).alias("actionable"),
    )

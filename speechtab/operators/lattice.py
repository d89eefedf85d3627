"""Consensus lattices from several models' transcripts, and error rates against them.

Everything is keyed by segment: the long table of model transcripts is partitioned by it once, and votes, bins and
distances reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab.functions.edit import align, lattice_distance, word_distance
from speechtab.functions.text import normalize_word


def unpivot_models(wide: DataFrame, key: str, reference: str, models: list[str]) -> DataFrame:
    """segment, human, model, transcript of the filled transcripts of rows with a filled reference."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    rows = wide.where(filled(reference)).withColumnRenamed(reference, "human").withColumnRenamed(key, "segment")
    return rows.unpivot(["segment", "human"], models, "model", "transcript").where(filled("transcript"))


def steps(ops: Column, ref: Column, hyp: Column) -> Column:
    """Array of (op, pos, ref_word, word): each operation with its place in the reference (from 0)."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.array().cast("array<struct<op:string,pos:int,ref_word:string,word:string>>").alias("out"))

    def step(acc: Column, op: Column) -> Column:
        row = F.struct(
            op.alias("op"), acc["i"].alias("pos"), F.when(op != "I", F.get(ref, acc["i"])).otherwise("").alias("ref_word"),
            F.when(op != "D", F.get(hyp, acc["j"])).otherwise("").alias("word"),
        )
        return F.struct((acc["i"] + (op != "I").cast("int")).alias("i"), (acc["j"] + (op != "D").cast("int")).alias("j"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(F.filter(F.split(ops, ""), lambda o: o != ""), zero, step, lambda acc: acc["out"])


def chars(word: Column) -> Column:
    return F.array_distinct(F.filter(F.split(word, ""), lambda c: c != ""))


def similar(a: Column, b: Column) -> Column:
    """Whether the words share more than half of the larger one's distinct characters; false if one has none."""
    x, y = chars(a), chars(b)
    both = F.size(F.array_intersect(x, y))
    return (F.size(x) > 0) & (F.size(y) > 0) & (both / F.greatest(F.size(x), F.size(y), F.lit(1)) > 0.5)


def aligned(long: DataFrame) -> DataFrame:
    """segment, model, op, pos, ref_word, word from rows (segment, model, ref, hyp) of token arrays."""
    with_ops = long.withColumn("ops", align("ref", "hyp"))
    return with_ops.select("segment", "model", F.explode(steps(F.col("ops"), F.col("ref"), F.col("hyp"))).alias("s")).select("segment", "model", "s.*")


def votes(steps_table: DataFrame) -> DataFrame:
    """segment, pos, word, n, similar: the models' votes per place and normalised word, of matches and substitutions."""
    rows = steps_table.where(F.col("op").isin("M", "S")).select(
        "segment", "pos", normalize_word(F.col("word")).alias("word"),
        ((F.col("op") == "M") | similar(normalize_word(F.col("ref_word")), normalize_word(F.col("word")))).alias("similar"),
    )
    return rows.groupBy("segment", "pos", "word").agg(F.count("*").alias("n"), F.max("similar").alias("similar"))


def bins(long: DataFrame, voted: DataFrame) -> DataFrame:
    """segment, pos, words (sorted set): the reference word, similar ones, and those that enough models agree on."""
    backbone = long.groupBy("segment").agg(F.first("ref").alias("ref"), F.count("*").alias("models"))
    agree = F.greatest(F.lit(3), F.floor(F.col("models") / 2))
    accepted = voted.join(backbone.select("segment", "models"), "segment").where(F.col("similar") | (F.col("n") >= agree)).select("segment", "pos", "word")
    own = backbone.select("segment", F.posexplode("ref").alias("pos", "word")).select("segment", "pos", normalize_word(F.col("word")).alias("word"))
    return own.union(accepted).groupBy("segment", "pos").agg(F.array_sort(F.collect_set("word")).alias("words"))


def lattice_scores(long: DataFrame) -> DataFrame:
    """segment, model, ref_len, hyp_len, std_errors, lat_errors, std_wer, lat_wer; ratios are not rounded.

    ``long`` (segment, model, ref, hyp) is partitioned by segment once, which every step then reuses.
    """
    long = long.repartition("segment")
    lattice = bins(long, votes(aligned(long))).groupBy("segment").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"]).alias("bins")
    )
    norm = lambda c: F.transform(c, normalize_word)
    joined = long.join(lattice, "segment", "left").withColumn("r", norm(F.col("ref"))).withColumn("h", norm(F.col("hyp")))
    empty = F.array().cast("array<array<string>>")
    scored = joined.select(
        "segment", "model", F.size("r").cast("long").alias("ref_len"), F.size("h").cast("long").alias("hyp_len"),
        word_distance(F.col("r"), F.col("h")).alias("std_errors"), lattice_distance(F.coalesce("bins", empty), F.col("h")).alias("lat_errors"),
    )
    n, some = F.col("ref_len"), F.col("ref_len") > 0
    return scored.withColumn("std_wer", F.when(some, F.col("std_errors") / n).when(F.col("hyp_len") == 0, 0.0).otherwise(1.0)).withColumn(
        "lat_wer", F.when(some, F.col("lat_errors") / n).otherwise(0.0)
    )


def model_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(
        F.avg("std_wer").alias("avg_standard_wer"), F.avg("lat_wer").alias("avg_lattice_wer"),
        (F.sum(F.col("std_wer") - F.col("lat_wer")) / F.count("*")).alias("avg_improvement"), F.count("*").alias("num_segments"),
    )


def wide_report(scores: DataFrame, models: list[str]) -> DataFrame:
    """Segment_URL and three columns per model; N/A where a model has no transcript."""
    pct = lambda c: F.format_string("%.4f", c)
    cells = scores.groupBy("segment").pivot("model", models).agg(
        F.first(pct(F.col("std_wer"))).alias("Standard_WER"), F.first(pct(F.col("lat_wer"))).alias("Lattice_WER"),
        F.first(pct(F.col("std_wer") - F.col("lat_wer"))).alias("Improvement"),
    )
    names = [f"{m}_{c}" for m in models for c in ("Standard_WER", "Lattice_WER", "Improvement")]
    return cells.select(F.col("segment").alias("Segment_URL"), *[F.coalesce(F.col(f"`{n}`"), F.lit("N/A")).alias(n) for n in names])

"""Systematic and stratified sampling, top-k and ordered splits: by explicit order, without randomness.

Places within a stratum come from window functions over slices of the order column's range (``numbered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ["low", "medium", "high", "supplemental"]


def severity(wer: Column) -> Column:
    return F.when(wer <= 0.3, "low").when(wer <= 0.6, "medium").otherwise("high")


def numbered(df: DataFrame, order: list[str], keys: list[str], name: str = "rn", buckets: int = 256) -> DataFrame:
    """Adds ``name``, the place of each row within ``keys`` in the given order, from 0.

    Where the first order column is a number, rows are counted by equal slices of its range first and numbered within a
    slice, so no task sorts a whole table; the slices depend on nothing but the least and the greatest value.
    """
    first = order[0]
    if dict(df.dtypes)[first] in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        ends = df.agg(F.min(first).alias("_lo"), F.max(first).alias("_hi"))
        width = F.col("_hi") - F.col("_lo") + 1
        slice_ = F.floor((F.col(first) - F.col("_lo")) * F.lit(float(buckets)) / width)
        df = df.crossJoin(F.broadcast(ends)).withColumn("_p", F.coalesce(slice_, F.lit(-1))).drop("_lo", "_hi")
    else:
        df = df.withColumn("_p", F.lit(0))
    sizes = df.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_p").orderBy(*order)
    placed = df.withColumn("_rn", F.row_number().over(inside)).join(sizes, [*keys, "_p"])
    return placed.withColumn(name, (F.col("_off") + F.col("_rn") - 1).cast("long")).drop("_p", "_rn", "_off")


def systematic(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Every k-th row in order, k = max(1, rows // n), the first n of them."""
    placed = numbered(df, order, [])
    total = df.agg(F.count("*").alias("_c"))
    step = F.greatest(F.lit(1), F.floor(F.col("_c") / n))
    return placed.crossJoin(F.broadcast(total)).where((F.col("rn") % step == 0) & (F.floor(F.col("rn") / step) < n)).drop("rn", "_c")


def sample_errors(predictions: DataFrame, order: list[str], min_samples: int = 25) -> DataFrame:
    """Errors (wer > 0), stratified by severity, in proportion and systematic; then a systematic top-up.

    Adds severity. ``order`` must tell rows apart. An empty input gives an empty sample.
    """
    target = max(min_samples, 25)
    # Read several times; persisted, so the scores are not computed again (a lost block is recomputed).
    errors = predictions.where(F.col("wer") > 0).withColumn("severity", severity(F.col("wer"))).persist()
    sizes = errors.groupBy("severity").agg(F.count("*").alias("_c"))
    total = errors.agg(F.count("*").alias("_t"))
    n = F.greatest(F.lit(1), F.floor(F.lit(target) * F.col("_c") / F.col("_t")))
    step = F.greatest(F.lit(1), F.floor(F.col("_c") / n))
    placed = numbered(errors, order, ["severity"]).join(F.broadcast(sizes), "severity").crossJoin(F.broadcast(total))
    first = placed.where((F.col("rn") % step == 0) & (F.floor(F.col("rn") / step) < n)).drop("rn", "_c", "_t")
    rest = numbered(errors.join(first.select(*order), order, "left_anti"), order, [])
    counts = first.agg(F.greatest(F.lit(min_samples) - F.count("*"), F.lit(0)).alias("_need")).crossJoin(rest.agg(F.count("*").alias("_r")))
    stride = F.greatest(F.lit(1), F.floor(F.col("_r") / F.greatest(F.col("_need"), F.lit(1))))
    extra = rest.crossJoin(F.broadcast(counts)).where((F.col("rn") % stride == 0) & (F.floor(F.col("rn") / stride) < F.col("_need")))
    return first.unionByName(extra.drop("rn", "_need", "_r").withColumn("severity", F.lit("supplemental")))


def first_per_group(df: DataFrame, keys: list[str], order: list[str | Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group (a partial limit per group runs before the shuffle)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def split_first(df: DataFrame, order: list[str], share: float = 0.9) -> DataFrame:
    """Adds part: train for the first int(share * rows) rows in order, eval for the others."""
    total = df.agg(F.count("*").alias("_c"))
    part = F.when(F.col("rn") < F.floor(F.lit(share) * F.col("_c")), "train").otherwise("eval")
    return numbered(df, order, []).crossJoin(F.broadcast(total)).withColumn("part", part).drop("rn", "_c")

"""Benchmark decontamination through a distributed positional inverted index.

Words are runs of digits, lower-case ASCII letters and non-ASCII characters, after A-Z are lower-cased. A benchmark item
gives windows of ``size`` consecutive words (a shorter item is one window). Corpus-wide counts of the benchmark's terms
pick each window's two rarest terms; a window with a term that no document has cannot occur. The index stores postings
(term, document, position) of the picked terms, the rarest ones with the words around them. The lists of a window's
two terms, each less the term's place in the window, are intersected on (document, window, start); what is left is
compared word by word, which gives exact matches, and proximity matches where all words of the window stand within
``slop`` words of its place.

The picked terms reach the scan, and the windows the postings, by broadcast only up to ``broadcast_terms`` of them (a
checked count); beyond, by a shuffle join. The second terms' lists are joined by shuffle. Rows are told apart by doc_id and a hash of the text; identical rows get the same
result. Null texts have no words and match nothing; repeated items count by their distinct item_ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import materialize

#: One or more characters but ASCII ones that are no digit or lower-case letter. Named by what it holds, which Java
#: matches several times faster than the complement.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"
#: The same words before lower-casing.
CASED_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased; ASCII texts take the faster way."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """Distinct windows: win (array of words), items (sorted distinct item_ids as strings)."""
    w = items.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
    last = F.greatest(F.size("w") - size, F.lit(0))
    w = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, size))).alias("win"))
    return w.groupBy("win").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def _picked(tokens: DataFrame, terms: DataFrame, broadcast_terms: int) -> DataFrame:
    small = terms.count() <= broadcast_terms
    return tokens.join(F.broadcast(terms) if small else terms, "term")


def anchors(docs: DataFrame, windows: DataFrame, broadcast_terms: int) -> DataFrame:
    """win, items, t1, o1, t2, o2: each window with its two rarest terms and their places (counted from 0)."""
    placed = windows.select("win", "items", F.posexplode("win").alias("o", "term"))
    terms = materialize(placed.select("term").distinct(), "terms")
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    df = _picked(tokens, terms, broadcast_terms).groupBy("term").agg(F.count("*").alias("df"))
    ranked = placed.join(df, "term", "left").groupBy("win", "items").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "o"))).alias("r")
    )
    first = F.col("r")[0]
    # The second term is another word where the window has one.
    other = F.coalesce(F.get(F.filter("r", lambda x: x["term"] != first["term"]), F.lit(0)), first)
    return ranked.where(first["df"] > 0).select(
        "win", "items", first["term"].alias("t1"), first["o"].alias("o1"), other["term"].alias("t2"), other["o"].alias("o2")
    )


def matches(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 2, broadcast_terms: int = 200_000) -> DataFrame:
    """doc_id, h, start, n, items, exact: every window's exact and proximity matches in the documents.

    ``start`` (from 0) and ``n`` are the words that an exact match covers; h is the text's hash.
    """
    found = materialize(anchors(docs, windows_of(items, size), broadcast_terms), "anchors")
    reach = size - 1 + slop
    roles = found.select(F.col("t1").alias("term"), F.lit(True).alias("main"), F.lit(False).alias("second")).union(
        found.select(F.col("t2").alias("term"), F.lit(False).alias("main"), F.lit(True).alias("second"))
    )
    terms = materialize(roles.groupBy("term").agg(F.max("main").alias("main"), F.max("second").alias("second")), "terms")
    tokens = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), words_of(F.col("text")).alias("w"))
    tokens = tokens.select("doc_id", "h", "w", F.posexplode("w").alias("pos", "term"))
    low = F.greatest(F.col("pos") - reach, F.lit(0))
    near = F.when(F.col("main"), F.slice("w", low + 1, F.col("pos") - low + 1 + reach))
    index = _picked(tokens, terms, broadcast_terms).select("doc_id", "h", "term", "pos", "main", "second", (F.col("pos") - low).alias("at"), near.alias("near"))
    index = materialize(index, "postings")

    lists = found.select("win", "items", "o1", "t2", "o2", F.col("t1").alias("term")).withColumn("len", F.size("win"))
    few = found.count() <= broadcast_terms  # a checked size; windows are short
    one = index.where("main").join(F.broadcast(lists) if few else lists, "term").withColumn("start", F.col("pos") - F.col("o1"))
    # Where the second term stands around its place: read off the posting's own neighbourhood first, which thins the list.
    one = one.where(F.array_contains(_cut("near", F.col("at") - F.col("o1") + F.col("o2") - slop, F.lit(2 * slop + 1)), F.col("t2")))
    # The lists meet in cells of the documents' positions: each place looks into the one or two cells around it.
    cell = 64
    two = index.where("second").select("doc_id", "h", F.col("term").alias("t2"), "pos", F.floor(F.col("pos") / cell).alias("cell"))
    one = one.withColumn("p2", F.col("start") + F.col("o2"))
    reach_2 = F.sequence(F.floor((F.col("p2") - slop) / cell), F.floor((F.col("p2") + slop) / cell))
    a, b = one.withColumn("cell", F.explode(reach_2)).alias("a"), two.alias("b")
    both = a.join(
        b,
        F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.t2") == F.col("b.t2"))
        & (F.col("a.cell") == F.col("b.cell")) & (F.abs(F.col("a.p2") - F.col("b.pos")) <= slop),
        "left_semi",
    )
    first = F.col("at") - F.col("o1")
    exact = (first >= 0) & (_cut("near", first, F.col("len")) == F.col("win"))
    close = F.size(F.array_except("win", _cut("near", first - slop, F.col("len") + 2 * slop))) == 0
    return both.withColumn("exact", exact).where(F.col("exact") | close).select("doc_id", "h", "start", F.col("len").alias("n"), "items", "exact")


def _cut(array: str, start: Column, n: Column) -> Column:
    """``n`` elements from ``start`` (from 0) on; what lies before the array is left out."""
    low = F.greatest(start, F.lit(0))
    return F.slice(array, low + 1, F.greatest(n - (low - start), F.lit(0)))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 2, broadcast_terms: int = 200_000) -> DataFrame:
    """doc_id, h, n_words, n_hit, n_items, items_sha256, contaminated, n_near of every row of ``docs`` (doc_id, text).

    ``n_near`` counts proximity matches that are not exact.
    """
    found = matches(docs, items, size, slop, broadcast_terms)
    covered = F.when(F.col("exact"), F.sequence(F.col("start"), F.col("start") + F.col("n") - 1))
    # A word's hits meet in one row per document and word, then a document's rows; repeats are gone before that.
    hits = found.groupBy("doc_id", "h").agg(
        F.array_distinct(F.flatten(F.collect_set(covered))).alias("hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("exact"), F.col("items")))))).alias("items"),
        F.size(F.collect_set(F.when(~F.col("exact"), F.struct("start", "n", "items")))).alias("n_near"),
    )
    hits = hits.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.size("hit").cast("long").alias("n_hit"), "items", "n_near")
    rows = docs.select(
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(CASED_WORD)).cast("long").alias("n_words"),
    )
    joined = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    items_in = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "h", "n_words", n_hit.alias("n_hit"), F.size(items_in).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_in, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 2, broadcast_terms: int = 200_000) -> DataFrame:
    """The rows of ``docs`` without an exact match, with all their columns. The rows to drop are few; only they are joined."""
    hits = matches(docs.select("doc_id", "text"), items, size, slop, broadcast_terms).where("exact")
    hits = hits.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).distinct()
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("__d")) & (h == F.col("__h")), "left_anti")

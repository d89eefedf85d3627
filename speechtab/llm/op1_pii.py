"""Personal data: base spans by pattern, and information-theoretic sanitisation of the terms around them.

Protected entities are the distinct base values. Over the whole corpus, a term's disclosure of an entity is their
pointwise mutual information, log2(N * n(t near e) / (n(t) * n(e))), with n counted in documents; it is at most the
entity's information log2(N / n(e)), which it reaches where the term never occurs without the entity. A term that
discloses at least ``share`` of an entity's information, and at least ``least_bits`` (or all of it, for entities of
less information), is a span of kind ``term`` wherever it stands in a document that holds the entity: removed where it
discloses all, generalised otherwise. Where ``reach`` is None, as in the query and the pipeline, near is anywhere in the
document, so every position of every text that holds an entity is scored; a number of characters scores terms within
them only, on the same side of the next span of the kind. A term must stand near the entity in ``support`` different
texts, so chance neighbours are left alone; near an entity that only one text holds, it must never occur without the
entity instead. Documents without base spans are never changed.

Scoring whole texts makes no pair that cannot pass: entities of the same documents have the same scores and are one
class, and a term in more than n(e) * (N / n(e)) ** (1 - share) documents cannot disclose ``share`` of e.

Patterns are written for linear time: a match starts where no earlier start could have matched. Only documents that hold
a candidate take part in joins. Null text counts as empty; rows are told apart by doc_id and a hash of the text, and
identical rows get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechtab.llm.common import materialize
from speechtab.llm.op8_decontaminate import lower_ascii

KINDS = ["email", "ip", "card", "phone", "term"]
_LOCAL = "A-Za-z0-9._%+-"
#: Leftmost matches of the base patterns; of digit chains only those of 13 digits and over, as others fail anyway.
PATTERNS = [
    rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12}(?:[ -]?[0-9])*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
HINTS = ["@", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9](?:[ -]?[0-9]){12}", r"\+[0-9]"]
TERM = r"[a-z\x{80}-\x{10FFFF}][0-9a-z\x{80}-\x{10FFFF}]{2,}+"
REACH = 80


def hints(text: Column) -> list[Column]:
    return [F.contains(text, F.lit(HINTS[0])), *(F.rlike(text, F.lit(h)) for h in HINTS[1:])]


def valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    ip = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    card = (F.length(digits) >= 13) & (F.length(digits) <= 19) & F.call_function("luhn_check", digits)
    phone = (F.length(digits) >= 9) & (F.length(digits) <= 15)
    return F.when(kind == 0, True).when(kind == 1, ip).when(kind == 2, card).otherwise(phone)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))


def base_spans(rows: DataFrame, reach: int | None = REACH) -> DataFrame:
    """doc_id, h, kind, start, stop, value of every valid base match of ``rows`` (doc_id, h, text).

    With a ``reach``, left and right too: the words within so many characters of the match, up to the kind's next one.
    """
    text = F.col("text")
    found = []
    for k, (pattern, hint) in enumerate(zip(PATTERNS, hints(text), strict=True)):
        parts = F.struct(F.lit(k).alias("kind"), F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"))
        found.append(F.when(hint, parts))
    x = rows.select("doc_id", "h", F.explode(F.array(*found)).alias("x")).where("size(x.m) > 0")
    n = F.size("x.m")
    zipped = F.arrays_zip(F.slice("x.p", F.lit(1), n).alias("before"), F.col("x.m").alias("value"), F.slice("x.p", F.lit(2), n).alias("after"))
    x = x.select("doc_id", "h", F.col("x.kind").alias("kind"), F.posexplode(zipped).alias("i", "z"))
    z = F.col("z")
    sides = []
    if reach is not None:
        left, right = F.right(z["before"], F.lit(reach)), F.left(z["after"], F.lit(reach))
        cut = lambda side, whole, where: F.when(F.length(whole) > F.length(side), F.regexp_replace(side, where, "")).otherwise(side)
        sides = [
            cut(left, z["before"], r"^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").alias("left"),
            cut(right, z["after"], r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$").alias("right"),
        ]
    x = x.select("doc_id", "h", "kind", "i", z["value"].alias("value"), F.length(z["before"]).alias("gap"), *sides).distinct()
    run = Window.partitionBy("doc_id", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("stop", F.sum(F.col("gap") + F.length("value")).over(run).cast("long"))
    x = x.withColumn("start", F.col("stop") - F.length("value")).where(valid(F.col("kind"), F.col("value")))
    return x.drop("i", "gap")


def _terms(side: str) -> Column:
    return F.regexp_extract_all(lower_ascii(F.col(side)), F.lit(TERM), 0)


def _rows_of(docs: DataFrame, some: DataFrame) -> DataFrame:
    """Distinct rows of ``docs`` (doc_id, h, text) that ``some`` (doc_id, h and any columns) has, with its columns."""
    more = [c for c in some.columns if c not in ("doc_id", "h")]
    some = some.select(F.col("doc_id").alias("__td"), F.col("h").alias("__th"), *more)
    rows = docs.join(some, F.col("doc_id").eqNullSafe(F.col("__td")) & (F.col("h") == F.col("__th")))
    return rows.dropDuplicates(["__td", "__th"]).drop("__td", "__th")


def _held(base: DataFrame, classes: bool) -> DataFrame:
    """doc_id, h, e, n_e, e_texts: the entities of each document, with the numbers of documents and texts that hold them.

    With ``classes``, entities that the same documents hold are one.
    """
    held = base.select("doc_id", "h", F.struct("kind", F.lower("value").alias("entity")).alias("e")).distinct()
    # 128 bits of a set of documents
    same = [F.bit_xor(F.xxhash64("doc_id", "h")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "h", "doc_id")).alias("b")]
    by_text = held.groupBy("e", "h").agg(F.count("*").alias("n"), *same)
    counts = by_text.groupBy("e").agg(F.sum("n").alias("n_e"), F.count("*").alias("e_texts"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    held = held.join(counts, "e")
    if classes:
        held = held.withColumn("e", F.struct("n_e", "a", "b")).distinct()
    return held.select("doc_id", "h", "e", "n_e", "e_texts")


def _counts(docs: DataFrame, terms: DataFrame, broadcast_terms: int) -> DataFrame:
    """term, n_t: the number of ``docs`` with each of ``terms`` (distinct)."""
    tokens = docs.select(F.explode(F.array_distinct(_terms("text"))).alias("term"))
    if terms.count() <= broadcast_terms:  # a checked size
        return tokens.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n_t"))
    # counted in each task first, so the shuffle has a row for each task and word
    return tokens.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term")


def disclosures(
    docs: DataFrame, hinted: DataFrame, base: DataFrame, reach: int | None, share: float = 0.8, least_bits: float = 3.0, support: int = 2, broadcast_terms: int = 200_000
) -> DataFrame:
    """doc_id, h, term, full: the terms that disclose an entity of the document beyond the thresholds.

    ``full``: the term never occurs in a document without the entity near it.
    """
    total = float(docs.count())
    held = materialize(_held(base, reach is None), "held")
    if reach is None:
        words = _rows_of(hinted, held.select("doc_id", "h").distinct())
        words = materialize(words.select("doc_id", "h", F.array_distinct(_terms("text")).alias("terms")), "words")
        words = words.select("doc_id", "h", F.explode("terms").alias("term"))
    else:
        e = F.struct("kind", F.lower("value").alias("entity")).alias("e")
        words = base.select("doc_id", "h", e, F.explode(F.array_distinct(F.concat(_terms("left"), _terms("right")))).alias("term"))
        words = materialize(words.distinct(), "words")
    n_t = materialize(_counts(docs, materialize(words.select("term").distinct(), "terms"), broadcast_terms), "counts")
    if reach is None:
        # The most documents of a term that may disclose e; where too few texts hold e, only a full one may.
        most = F.when(F.col("e_texts") < support, F.col("n_e")).otherwise(F.col("n_e") * F.pow(F.lit(total) / F.col("n_e"), F.lit(1 - share)))
        able = held.where(F.col("n_e") < total).withColumn("most", most * (1 + 1e-9))
        bound = able.agg(F.max("most")).first()[0] or 0.0
        words = words.join(n_t.where(F.col("n_t") <= bound), "term")
        able = able.withColumnsRenamed({"doc_id": "__td", "h": "__th"})
        near = words.join(able, F.col("doc_id").eqNullSafe(F.col("__td")) & (F.col("h") == F.col("__th")) & (F.col("n_t") <= F.col("most")))
        near = near.select("doc_id", "h", "e", "n_e", "e_texts", "term", "n_t")
    else:
        near = words.join(held.select("e", "n_e", "e_texts").distinct(), "e").join(n_t, "term")
    near = materialize(near, "near")
    by_text = near.groupBy("e", "term", "n_e", "e_texts", "n_t", "h").agg(F.count("*").alias("n"))
    pairs = by_text.groupBy("e", "term", "n_e", "e_texts", "n_t").agg(F.count("*").alias("texts"), F.sum("n").alias("n_te"))
    info = F.log2(F.lit(total) / F.col("n_e"))
    bits = F.log2(F.col("n_te") * F.lit(total) / (F.col("n_t") * F.col("n_e")))
    full = F.col("n_te") >= F.col("n_t")
    known = (F.col("texts") >= support) | ((F.col("e_texts") == 1) & full)
    enough = known & (bits > 0) & (bits >= share * info) & ((bits >= least_bits) | full)
    scored = materialize(pairs.where(enough).select("e", "term", full.alias("full")), "scores")
    # A text that holds e and the term has them near each other where near is anywhere.
    told = near.join(scored, ["e", "term"]) if reach is None else held.join(scored, "e")
    return told.groupBy("doc_id", "h", "term").agg(F.max("full").alias("full"))


def disclosing_terms(docs: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, h, start, stop, full: every occurrence in ``docs`` of the terms ``told`` of each (doc_id, h, term, full)."""
    hit = told.groupBy("doc_id", "h").agg(F.map_from_entries(F.collect_list(F.struct("term", "full"))).alias("__told"))
    low = lower_ascii(F.col("text"))
    rows = _rows_of(docs, hit).select("doc_id", "h", "__told", F.split(low, TERM, -1).alias("gaps"), _terms("text").alias("terms"))
    words = F.arrays_zip(F.slice("gaps", F.lit(1), F.size("terms")).alias("gap"), F.col("terms").alias("term"))
    rows = rows.select("doc_id", "h", "__told", F.posexplode(words).alias("i", "w"))
    part = Window.partitionBy("doc_id", "h").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.length("w.gap") + F.length("w.term")).over(part).cast("long"))
    rows = rows.withColumn("full", F.try_element_at("__told", F.col("w.term"))).where(F.col("full").isNotNull())
    return rows.select("doc_id", "h", (F.col("stop") - F.length("w.term")).alias("start"), "stop", "full")


def spans(docs: DataFrame, reach: int | None = REACH, **thresholds: float) -> DataFrame:
    """__fd (doc_id), __fh (h), __fbase and __fterms (sorted arrays of kind, start, stop, full) of documents with a base span."""
    rows = keyed(docs)
    some = hints(F.col("text"))
    hinted = rows.where(some[0] | some[1] | some[2] | some[3])
    base = materialize(base_spans(hinted, reach), "spans")
    terms = disclosing_terms(hinted, disclosures(rows, hinted, base, reach, **thresholds))
    every = base.select("doc_id", "h", "kind", "start", "stop", F.lit(True).alias("full")).union(
        terms.select("doc_id", "h", F.lit(4).alias("kind"), "start", "stop", "full")
    )
    got = every.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "stop", "full"))).alias("s"))
    got = got.select("doc_id", "h", F.filter("s", lambda s: s["kind"] < 4).alias("base"), F.filter("s", lambda s: s["kind"] == 4).alias("terms"))
    clear = lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"]))
    # A term may be disclosed by two entities; one span of it stays, a full one if there is one.
    best = F.filter("terms", lambda t: clear(t) & (t["full"] | ~F.exists("terms", lambda u: u["full"] & (u["start"] == t["start"]))))
    return got.select(F.col("doc_id").alias("__fd"), F.col("h").alias("__fh"), F.col("base").alias("__fbase"), best.alias("__fterms"))


def _with_spans(docs: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with base and terms; only rows with a hint are joined."""
    text = F.coalesce("text", F.lit(""))
    some = hints(text)
    any_hint = some[0] | some[1] | some[2] | some[3]
    none = F.array().cast("array<struct<kind:int,start:bigint,stop:bigint,full:boolean>>")
    rows = docs.select(*columns, F.xxhash64(text).alias("__h"), any_hint.alias("__hint"), F.col("doc_id").alias("__d"))
    plain = rows.where("not __hint").select(*columns, none.alias("__base"), none.alias("__terms"))
    joined = rows.where("__hint").join(found, F.col("__d").eqNullSafe(F.col("__fd")) & (F.col("__h") == F.col("__fh")), "left")
    return plain.union(joined.select(*columns, F.coalesce("__fbase", none), F.coalesce("__fterms", none)))


def report(docs: DataFrame, **thresholds: float | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans of every row of ``docs`` (doc_id, text)."""
    rows = _with_spans(docs, spans(docs, **thresholds), ["doc_id"])
    names = F.array(*map(F.lit, KINDS))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select(
        "doc_id", *map(count, range(4)), F.size("__terms").cast("long").alias("n_term"),
        F.sha2(said(F.col("__base")).cast("binary"), 256).alias("base_sha256"), said(F.concat("__base", "__terms")).alias("spans"),
    )


def sanitise(docs: DataFrame, **thresholds: float | None) -> DataFrame:
    """``docs`` with base spans replaced by [KIND], removed terms gone and generalised ones [TERM]; null texts stay."""
    columns = docs.columns
    rows = _with_spans(docs, spans(docs, **thresholds), [F.col(f"`{c}`") for c in columns])
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    every = F.sort_array(F.transform(F.concat("__base", "__terms"), lambda s: F.struct(s["start"].alias("a"), s["stop"].alias("b"), s["kind"].alias("k"), s["full"].alias("full"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        label = F.when((s["k"] == 4) & s["full"], "").otherwise(F.get(names, s["k"]))
        piece = F.substring("text", acc["at"].cast("int") + 1, (s["a"] - acc["at"]).cast("int"))
        more = F.concat(acc["out"], F.array(piece, label))
        return F.struct(F.greatest(acc["at"], s["b"]).alias("at"), F.when(s["a"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring("text", acc["at"].cast("int") + 1, F.length("text")))
    changed = F.when(F.size("__base") > 0, F.aggregate(every, zero, step, rest)).otherwise(F.col("text"))
    return rows.withColumn("text", changed).select(*[F.col(f"`{c}`") for c in columns])

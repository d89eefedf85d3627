"""The registered queries and their DuckDB oracles.

The driver's tables hold no Hindi, so three bridges, the same in both engines, make inputs of them: a transliteration to
Devanagari, numbers spelled out in Hindi, and corrupted copies of texts that stand for models' transcripts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab import vocab
from speechtab.functions import edit, numbers
from speechtab.functions import text as T
from speechtab.functions.spelling import analysis
from speechtab.operators import errors, evaluation, lattice, reports, sampling
from speechtab.sources import ingest

ROMAN = "abcdefghijklmnopqrstuvwxyz"
DEVA = "ाबचदेफगहिजकलमनोप्रसतुवं़ीश"
MODELS = [1, 2, 3, 4, 5, 6]
BASES = ("https://old.example/", "https://new.example/v2/")
LOAN = vocab.LOANWORDS[:20]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def corrupt(ref: Column, seed: Column, k: int) -> Column:
    def one(w: Column, i: Column) -> Column:
        return F.when((i + seed) % (k + 6) == 0, "").when((i + seed) % (k + 4) == 0, F.concat(w, F.lit("x"))).otherwise(w)

    return F.filter(F.transform(ref, one), lambda w: w != "")


def utterances(spark: SparkSession, d: str) -> DataFrame:
    """seg, role, ref, hyp of every turn of every conversation."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seg"), "role", tokens(F.col("text")).alias("ref"))
    return c.withColumn("hyp", corrupt(F.col("ref"), F.col("seg"), 1))


UTT = """t as (select conv_id * 1000 + turn as seg, role, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') as ref from conversations),
u as (select seg, role, ref, list_filter(list_transform(ref, lambda w, i: case when (i - 1 + seg) % 7 = 0 then '' when (i - 1 + seg) % 5 = 0 then w || 'x' else w end), lambda w: w <> '') as hyp from t)"""

DIST = """list_extract(list_reduce(list_transform(ref, lambda w: [w]), lambda prev, b: list_reduce(range(1, len(hyp) + 1), lambda cur, j: list_append(cur,
 case when list_contains(b, hyp[j]) then prev[j] else least(prev[j + 1] + 1, cur[j] + 1, prev[j] + 1) end), [prev[1] + 1]), range(0, len(hyp) + 1)), -1)"""

OPS = """list_extract(list_reduce(list_transform(ref, lambda w: [w]), lambda prev, b: list_reduce(range(1, len(hyp) + 1), lambda cur, j: list_append(cur,
 case when b[1] = hyp[j] then {'c': prev[j].c, 'o': prev[j].o || 'M'}
 when prev[j + 1].c <= cur[j].c and prev[j + 1].c <= prev[j].c then {'c': prev[j + 1].c + 1, 'o': prev[j + 1].o || 'D'}
 when cur[j].c <= prev[j].c then {'c': cur[j].c + 1, 'o': cur[j].o || 'I'}
 else {'c': prev[j].c + 1, 'o': prev[j].o || 'S'} end), [{'c': prev[1].c + 1, 'o': prev[1].o || 'D'}]), list_transform(range(0, len(hyp) + 1), lambda j: {'c': j, 'o': repeat('I', j)})), -1).o"""


def wer_utterance(spark: SparkSession, d: str) -> DataFrame:
    u = utterances(spark, d)
    return u.select("seg", edit.word_distance(F.col("ref"), F.col("hyp")).alias("edits"), F.size("ref").cast("long").alias("ref_words"))


def wer_by_role(spark: SparkSession, d: str) -> DataFrame:
    u = utterances(spark, d)
    scored = u.select("role", edit.word_distance(F.col("ref"), F.col("hyp")).alias("edits"), F.size("ref").cast("long").alias("ref_words"))
    return reports.corpus_wer(scored, "role")


def wer_corpus_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", "doc_id", tokens(F.col("text")).alias("ref"))
    docs = docs.withColumn("hyp", corrupt(F.col("ref"), F.col("doc_id"), 1))
    scored = docs.select("lang", edit.word_distance(F.col("ref"), F.col("hyp")).alias("edits"), F.size("ref").cast("long").alias("ref_words"))
    return reports.corpus_wer(scored, "lang")


def cer_utterance(spark: SparkSession, d: str) -> DataFrame:
    u = utterances(spark, d)
    return u.select("seg", edit.char_error_rate(F.array_join("ref", " "), F.array_join("hyp", " ")).alias("cer"))


def align_ops(spark: SparkSession, d: str) -> DataFrame:
    return model_rows(spark, d).select("segment", "model", edit.align("ref", "hyp").alias("ops"))


def align_counts(spark: SparkSession, d: str) -> DataFrame:
    ops = align_ops(spark, d).select(F.explode(F.filter(F.split("ops", ""), lambda o: o != "")).alias("op"))
    return ops.groupBy("op").agg(F.count("*").alias("n"))


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    """segment, model, ref, hyp: six pseudo-models over every benchmark item, unpivoted from a wide table."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("segment"), tokens(F.col("text")).alias("ref"))
    wide = b.select("segment", F.array_join("ref", " ").alias("human"), *[F.array_join(corrupt(F.col("ref"), F.col("segment"), k), " ").alias(f"m{k}") for k in MODELS])
    long = lattice.unpivot_models(wide, "segment", "human", [f"m{k}" for k in MODELS])
    return long.select("segment", "model", T.words(F.col("human")).alias("ref"), T.words(F.col("transcript")).alias("hyp"))


MODEL_SQL = """b as (select item_id as segment, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') as ref from benchmark),
p as (select segment, 'm' || k as model, ref, list_filter(list_transform(ref, lambda w, i: case when (i - 1 + segment) % (k + 6) = 0 then '' when (i - 1 + segment) % (k + 4) = 0 then w || 'x' else w end), lambda w: w <> '') as hyp
 from b, (select unnest([1, 2, 3, 4, 5, 6]) as k)),
q as (select * from p where len(ref) > 0 and len(hyp) > 0),
a as (select segment, model, ref, hyp, """ + OPS + """ as ops from q),
s as (select segment, model, ref, hyp, ops, unnest(range(1, len(ops) + 1)) as i from a),
st as (select segment, model, substr(ops, i, 1) as op, length(replace(substr(ops, 1, i - 1), 'I', '')) as pos,
 ref[length(replace(substr(ops, 1, i - 1), 'I', '')) + 1] as rw, hyp[length(replace(substr(ops, 1, i - 1), 'D', '')) + 1] as hw from s),
v as (select segment, pos, hw as word, count(*) as n, max(case when op = 'M' then true else len(list_intersect(list_distinct(string_split(rw, '')), list_distinct(string_split(hw, '')))) * 1.0
 / greatest(len(list_distinct(string_split(rw, ''))), len(list_distinct(string_split(hw, '')))) > 0.5 end) as "similar" from st where op in ('M', 'S') group by all),
m as (select segment, count(*) as models, any_value(ref) as ref from q group by segment),
w as (select segment, i - 1 as pos, ref[i] as word from (select segment, ref, unnest(range(1, len(ref) + 1)) as i from m)
 union select v.segment, v.pos, v.word from v join m using (segment) where v."similar" or v.n >= greatest(3, m.models // 2)),
bins as (select segment, pos, list_sort(list(distinct word)) as words from w group by segment, pos),
lat as (select segment, list(words order by pos) as bins from bins group by segment),
sc as (select q.segment, q.model, len(ref) as ref_len, len(hyp) as hyp_len, """ + DIST + """ as std_errors,
 list_extract(list_reduce(bins, lambda prev, b: list_reduce(range(1, len(hyp) + 1), lambda cur, j: list_append(cur,
 case when list_contains(b, hyp[j]) then prev[j] else least(prev[j + 1] + 1, cur[j] + 1, prev[j] + 1) end), [prev[1] + 1]), range(0, len(hyp) + 1)), -1) as lat_errors
 from q join lat using (segment))"""


def lattice_votes(spark: SparkSession, d: str) -> DataFrame:
    return lattice.votes(lattice.aligned(model_rows(spark, d)))


def lattice_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = model_rows(spark, d).repartition("segment")
    return lattice.bins(rows, lattice.votes(lattice.aligned(rows))).select("segment", "pos", F.array_join("words", " ").alias("words"))


def lattice_wer(spark: SparkSession, d: str) -> DataFrame:
    return lattice.lattice_scores(model_rows(spark, d))


def lattice_model_summary(spark: SparkSession, d: str) -> DataFrame:
    return lattice.model_summary(lattice_wer(spark, d)).select("model", "num_segments", F.round("avg_standard_wer", 9).alias("avg_standard_wer"), F.round("avg_lattice_wer", 9).alias("avg_lattice_wer"), F.round("avg_improvement", 9).alias("avg_improvement"))


def lattice_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide sheet as error counts per model, so that no rounding stands in the comparison."""
    scores = lattice_wer(spark, d)
    wide = scores.groupBy("segment").pivot("model", [f"m{k}" for k in MODELS]).agg(F.first("std_errors").alias("std"), F.first("lat_errors").alias("lat"))
    return wide


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))
    return docs.select("doc_id", F.length("norm").cast("long").alias("chars"), F.md5(F.col("norm").cast("binary")).alias("norm_md5"))


def normalize_word(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "conversations").select(F.explode(T.words(F.col("text"))).alias("word"))
    return w.groupBy(T.normalize_word(F.col("word")).alias("word")).agg(F.count("*").alias("n"))


def token_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(T.words(F.col("text"))).cast("long").alias("tokens"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("sentences"), F.md5(F.array_join("s", "|").cast("binary")).alias("sentences_md5"))


def deva(text: Column) -> Column:
    return F.translate(F.lower(text), ROMAN, DEVA)


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """seg, words, text: turns in which words are loanwords, Roman or transliterated by turns."""
    loans = F.array(*map(F.lit, LOAN))

    def one(w: Column, i: Column) -> Column:
        at = i + F.col("seg")
        return F.when(at % 7 == 0, F.get(loans, (at % 20).cast("int"))).when(at % 3 == 0, w).otherwise(F.translate(w, ROMAN, DEVA))

    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seg"), tokens(F.col("text")).alias("ref"))
    return c.select("seg", F.transform("ref", one).alias("words")).withColumn("text", F.array_join("words", " "))


def _sql_list(items: list) -> str:
    return "[" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + "]"


MIXED = f"""t as (select conv_id * 1000 + turn as seg, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') as ref from conversations),
mx as (select seg, list_transform(ref, lambda w, i: case when (i - 1 + seg) % 7 = 0 then {_sql_list(LOAN)}[((i - 1 + seg) % 20 + 1)::int] when (i - 1 + seg) % 3 = 0 then w else translate(w, '{ROMAN}', '{DEVA}') end) as words from t)"""


def script_profile(spark: SparkSession, d: str) -> DataFrame:
    m = mixed(spark, d)
    count = lambda f: F.size(F.filter("words", f)).cast("long")
    return m.select("seg", F.size("words").cast("long").alias("words"), count(T.is_devanagari_word).alias("devanagari"), count(T.is_roman_word).alias("roman"))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.rewrite_url(u, "https://", BASES[1]).alias("rewritten"), T.recording_id(u).alias("rec_id"), T.user_folder(u).alias("folder"))


def spelled_number(n: Column) -> Column:
    """``n`` below 100000 in Hindi words: thousands, hundreds and the rest, without zero parts."""
    words = F.array(*[F.lit(w.split("/")[0]) for w in vocab.UNIT_WORDS.split()])
    word = lambda k: F.get(words, k.cast("int"))
    thousands, hundreds, rest = F.floor(n / 1000), F.floor(n / 100) % 10, n % 100
    return F.concat_ws(" ", F.when(thousands > 0, F.concat(word(thousands), F.lit(" हज़ार"))), F.when(hundreds > 0, F.concat(word(hundreds), F.lit(" सौ"))), F.when(rest > 0, word(rest)))


def number_parse(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 100000).alias("n"))
    text = F.concat(F.lit("मेरे पास "), spelled_number(F.col("n")), F.lit(" रुपये"))
    return o.select("o_orderkey", numbers.convert_numbers(text).alias("compat"), numbers.convert_numbers(text, "additive").alias("additive"))


def number_prefix(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.split(F.concat(spelled_number(F.col("p_partkey") % 100000), F.lit(" लोग आए")), " ").alias("w"))
    got = numbers.parse_number(F.col("w"), "additive")
    return p.select("p_partkey", got["value"].alias("value"), got["consumed"].cast("long").alias("consumed"))


# Sentences with numbers, idioms and English words.
SENTENCES = [
    "मेरे पास दो सौ रुपये हैं", "तीन सौ चौवन लोग आए", "पच्चीस दिन बाद मिलो", "एक हज़ार रुपये चाहिए", "दो-चार बातें कर लो",
    "नौ दो ग्यारह हो गया", "सौ रुपये दो", "दो लाख तीस हज़ार", "एक हज़ार दो सौ", "दस तीस", "हज़ार सौ", "दो, दस।", "कंप्यूटर पर hello! लिखो",
]


def number_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every nation with every sentence: idiom flag, the sentence as converted both ways, whether conversion changes it."""
    s = F.explode(F.array(*map(F.lit, SENTENCES))).alias("text")
    rows = table(spark, d, "nation").select("n_nationkey", s)
    rows = rows.withColumns({m: numbers.convert_numbers("text", m) for m in ("compat", "additive")})
    return rows.select("n_nationkey", "text", "compat", "additive", (F.col("compat") != F.col("text")).alias("changed"), numbers.is_idiomatic(F.col("text")).alias("idiomatic"))


def number_changed_count(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select(F.concat(spelled_number(F.col("l_quantity").cast("long")), F.lit(" "), F.col("l_returnflag")).alias("raw"))
    changed = line.withColumn("normalized", numbers.convert_numbers(F.col("raw")))
    return changed.agg(F.count("*").alias("total"), F.count_if(F.col("raw") != F.col("normalized")).alias("changed"))


def cleanup_examples(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", spelled_number(F.col("o_orderkey") % 100).alias("raw"))
    pairs = o.withColumn("normalized", numbers.convert_numbers(F.col("raw"))).withColumn("reference", F.col("normalized"))
    return reports.cleanup_examples(pairs, "o_orderkey")


def english_found(spark: SparkSession, d: str) -> DataFrame:
    return reports.english_table(mixed(spark, d), F.col("text"))


def english_detect(spark: SparkSession, d: str) -> DataFrame:
    f = english_found(spark, d)
    return f.select("seg", "english_words", "total_words", F.array_join("found.word", " ").alias("words"), F.array_join("found.method", " ").alias("methods"))


def english_tag(spark: SparkSession, d: str) -> DataFrame:
    return english_found(spark, d).select("seg", "tagged")


def english_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.english_summary(english_found(spark, d))


def english_top_words(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_words(english_found(spark, d), "seg")


ENGLISH = MIXED + f""",
e as (select seg, words, list_filter(list_transform(words, lambda w, i: {{'w': w, 'i': i - 1, 'm': case when regexp_matches(w, '[A-Za-z]') then 'roman_script' when list_contains({_sql_list(vocab.LOANWORDS)}, w) then 'dictionary'
 when length(w) > 3 and regexp_matches(w, '({"|".join(vocab.TAG_SUFFIXES)})$') then 'suffix_pattern' end}}), lambda x: x.m is not null) as found from mx where len(words) > 0)"""


def spelled_words(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("w")).select(deva(F.col("w")).alias("word")).distinct()
    return reports.spelled(w)


def spelling_classify(spark: SparkSession, d: str) -> DataFrame:
    return spelled_words(spark, d)


def spelling_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.spelling_summary(spelled_words(spark, d))


def spelling_low_review(spark: SparkSession, d: str) -> DataFrame:
    low = spelled_words(spark, d).where("confidence = 'low'").select("word")
    return sampling.systematic(low, ["word"], 50).select("word", *analysis(F.col("word")))


def spelling_unreliable(spark: SparkSession, d: str) -> DataFrame:
    return reports.unreliable(spelled_words(spark, d))


_D = "ऀ-ॿ꣠-ꣿ"
SPELL = f"""w0 as (select distinct translate(lower(w), '{ROMAN}', '{DEVA}') as word from (select unnest(string_split_regex(text, '\\s+')) as w from documents) where w <> ''),
w1 as (select word, string_split(word, '') as ch, regexp_replace(word, '[^\\p{{L}}]', '', 'g') as letters, length(regexp_replace(word, '[^{_D}]', '', 'g')) as dev from w0),
w2 as (select *, list_filter(list_concat([
 case when len(list_filter(range(1, len(ch) - 2), lambda i: ch[i] = ch[i + 1] and ch[i] = ch[i + 2] and ch[i] = ch[i + 3] and ch[i] <> chr(10))) > 0 then 'Invalid pattern: (.)\\1{{3,}}' end,
 case when regexp_matches(word, '[{vocab.PLAIN_MATRAS}]{{3,}}') then 'Invalid pattern: [{vocab.PLAIN_MATRAS}]{{3,}}' end,
 case when regexp_matches(word, '्{{2,}}') then 'Invalid pattern: ्{{2,}}' end,
 case when regexp_matches(word, '^[{vocab.PLAIN_MATRAS}]') then 'Invalid pattern: ^[{vocab.PLAIN_MATRAS}]' end,
 case when regexp_matches(word, '[ंँ]{{2,}}') then 'Invalid pattern: [ंँ]{{2,}}' end],
 list_transform(list_filter(ch, lambda c: not regexp_matches(c, '^([{_D}]|[{vocab.MATRAS}{vocab.HALANT}{vocab.NUKTA}.-]|\\p{{Nd}}|[\\x00-\\x7F])$')), lambda c: 'Non-Devanagari char: ''' || c || ''' (U+' || printf('%04X', unicode(c)) || ')'),
 [case when regexp_matches(word, '^[{vocab.MATRAS}]') then 'Starts with a matra (vowel sign)' end]), lambda x: x is not null) as iss from w1),
sp as (select word, case when regexp_matches(word, '^\\s*$') then ['incorrect', 'high', 'Empty or whitespace-only word']
 when regexp_matches(word, '^(\\p{{Nd}}+|[.,;:!?-]+)$') then ['correct', 'high', 'Number or punctuation']
 when length(word) = 1 and dev = 1 then ['correct', 'medium', 'Single Devanagari character (could be abbreviation or particle)']
 when regexp_matches(word, '^[A-Za-z]$') then ['correct', 'medium', 'Single Latin character (abbreviation)']
 when regexp_matches(letters, '^[A-Za-z]+$') then ['correct', 'medium', 'Roman script word (English in conversation - per guidelines, Devanagari form is expected)']
 when dev = 0 then ['incorrect', 'high', 'Non-Devanagari script (potentially Urdu/Arabic script in Devanagari context)']
 when list_contains({_sql_list(vocab.LOANWORDS)}, word) or (length(word) > 4 and regexp_matches(word, '({"|".join(vocab.SPELL_SUFFIXES)})$')) then ['correct', 'high', 'English word in Devanagari (correct per transcription guidelines)']
 when len(iss) > 0 then ['incorrect', 'high', 'Invalid Devanagari structure: ' || array_to_string(iss, '; ')]
 when list_contains({_sql_list(vocab.COMMON_WORDS)}, word) then ['correct', 'high', 'Common Hindi word (high-frequency)']
 when length(word) > 20 and not contains(word, '्') then ['incorrect', 'medium', 'Unusually long word without conjuncts (possible word concatenation)']
 when regexp_matches(word, '({"|".join(vocab.VALID_SUFFIXES)})$') then ['correct', 'medium', 'Passes structural checks with valid Hindi suffix']
 else ['correct', 'low', 'Passes structural checks; not in reference dictionary (low confidence)'] end as v from w2),
s as (select word, v[1] as classification, v[2] as confidence, v[3] as reason from sp)"""


def scored_predictions(spark: SparkSession, d: str) -> DataFrame:
    u = wer_utterance(spark, d)
    return u.select("seg", F.when(F.col("ref_words") > 0, F.col("edits") / F.col("ref_words")).otherwise(0.0).alias("wer"))


def error_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_errors(scored_predictions(spark, d), ["seg"]).select("seg", "severity")


def stratum_sizes(spark: SparkSession, d: str) -> DataFrame:
    errors_ = scored_predictions(spark, d).where("wer > 0")
    return errors_.groupBy(sampling.severity(F.col("wer")).alias("severity")).agg(F.count("*").alias("n"))


def error_pairs(spark: SparkSession, d: str) -> DataFrame:
    """seg, severity, reference, hypothesis of the sampled errors, in mixed script with confused signs."""

    def one(w: Column, i: Column) -> Column:
        at = i + F.col("seg")
        return (
            F.when(at % 13 == 0, "").when(at % 5 == 0, F.replace(w, F.lit("ा"), F.lit("ो"))).when(at % 4 == 0, F.replace(w, F.lit("ब"), F.lit("व")))
            .when(at % 11 == 0, F.concat(w, F.lit("ं"))).otherwise(w)
        )

    m = mixed(spark, d).withColumn("hyp", F.filter(F.transform("words", one), lambda w: w != ""))
    pairs = m.select("seg", F.col("text").alias("reference"), F.array_join("hyp", " ").alias("hypothesis"))
    return pairs.join(error_sample(spark, d), "seg")


def error_evidence(spark: SparkSession, d: str) -> DataFrame:
    return errors.evidence_rows(error_pairs(spark, d), "seg")


def error_classify(spark: SparkSession, d: str) -> DataFrame:
    return error_evidence(spark, d).groupBy("seg", "category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("evidence")), "|").alias("evidence"))


def error_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return errors.taxonomy(error_evidence(spark, d)).select("category", "n", F.array_join("examples", "|").alias("examples"))


def error_top3_fixes(spark: SparkSession, d: str) -> DataFrame:
    return errors.top_fixes(errors.taxonomy(error_evidence(spark, d))).drop("proposed_fix")


def repair_before_after(spark: SparkSession, d: str) -> DataFrame:
    """Every turn in Devanagari: words changed by the repair rules, and word errors before and after them."""
    m = mixed(spark, d).select("seg", "text", T.repair(F.col("text")).alias("fixed"))
    ref, new = T.words(F.col("text")), T.words(F.col("fixed"))
    return m.select("seg", "fixed", (F.size(ref) == F.size(new)).alias("same_length"), F.size(F.filter(F.arrays_zip(ref.alias("a"), new.alias("b")), lambda p: p["a"] != p["b"])).cast("long").alias("changed"))


_SEV = "case when wer <= 0.3 then 'low' when wer <= 0.6 then 'medium' else 'high' end"
SAMPLE = UTT + f""",
er as (select seg, wer, {_SEV} as severity from (select seg, case when len(ref) > 0 then {DIST} / len(ref) else 0 end as wer from u) where wer > 0),
nb as (select *, row_number() over (partition by severity order by seg) - 1 as rn, count(*) over (partition by severity) as c, count(*) over () as t from er),
ns as (select *, greatest(1, 25 * c // t) as n from nb),
f as (select seg, severity from (select *, greatest(1, c // n) as step from ns) where rn % step = 0 and rn // step < n),
rest as (select seg, row_number() over (order by seg) - 1 as rn, count(*) over () as r, (select greatest(25 - count(*), 0) from f) as need from er where seg not in (select seg from f)),
smp as (select seg, severity from f union all select seg, 'supplemental' from rest where rn % greatest(1, r // greatest(need, 1)) = 0 and rn // greatest(1, r // greatest(need, 1)) < need)"""


def _swap_sql(swaps: list[str]) -> str:
    return " or ".join(f"(contains(p.r, '{a}') and replace(p.r, '{a}', '{b}') = p.h)" for a, b in (s.split(">") for s in swaps))


_NASAL = " or ".join(f"(contains(p.r, '{c}') <> contains(p.h, '{c}'))" for c in vocab.NASALS)
EVIDENCE = SAMPLE + ",\n" + MIXED.replace("t as (", "t2 as (", 1).replace("from t)", "from t2)") + f""",
ep as (select m.seg, smp.severity, words as r, list_filter(list_transform(words, lambda w, i: case when (i - 1 + m.seg) % 13 = 0 then '' when (i - 1 + m.seg) % 5 = 0 then replace(w, 'ा', 'ो') when (i - 1 + m.seg) % 4 = 0 then replace(w, 'ब', 'व')
 when (i - 1 + m.seg) % 11 = 0 then w || 'ं' else w end), lambda w: w <> '') as h from mx m join smp using (seg)),
pr as (select seg, severity, unnest(range(1, least(len(r), len(h)) + 1)) as k, r, h from ep),
p as (select seg, severity, k, r[k] as r, h[k] as h from pr where r[k] <> h[k]),
ev0 as (select seg, severity, 0 as g, 0 as k, 0 as j, 'insertion_deletion' as category, case when len(r) > len(h) then 'Deletion: ' || (len(r) - len(h)) || ' word(s) dropped' else 'Insertion: ' || (len(h) - len(r)) || ' extra word(s)' end as evidence from ep where len(r) <> len(h)
 union all select seg, severity, 0, 0, 1, 'word_boundary_error', 'Words merged or split differently' from ep where array_to_string(r, '') = array_to_string(h, '') and r <> h
 union all select seg, severity, 0, 0, 2, 'code_switching_error', 'English word in reference: ' || list_filter(r, lambda w: regexp_matches(w, '[A-Za-z]'))[1] from ep where len(list_filter(r, lambda w: regexp_matches(w, '[A-Za-z]'))) > 0
 union all select seg, severity, 1, k, 0, 'vowel_matra_error', '''' || r || ''' → ''' || h || '''' from p where {_swap_sql(vocab.VOWEL_SWAPS)}
 union all select seg, severity, 1, k, 1, 'consonant_confusion', '''' || r || ''' → ''' || h || '''' from p where {_swap_sql(vocab.CONSONANT_SWAPS)}
 union all select seg, severity, 1, k, 2, 'visarga_anusvara', '''' || r || ''' → ''' || h || ''' (nasal mark)' from p where {_NASAL}
 union all select seg, severity, 2, i, 0, 'punctuation_filler', 'Filler ''' || f || case when a then ''' missed' else ''' inserted' end
 from (select seg, severity, i, {_sql_list(vocab.FILLERS)}[i] as f, contains(array_to_string(r, ' '), {_sql_list(vocab.FILLERS)}[i]) as a, contains(array_to_string(h, ' '), {_sql_list(vocab.FILLERS)}[i]) as b from ep, (select unnest(range(1, {len(vocab.FILLERS) + 1})) as i)) where a <> b),
ev as (select * from ev0 union all select seg, severity, 3, 0, 0, 'other', 'Unclassified error' from ep where seg not in (select seg from ev0)),
evo as (select *, row_number() over (order by list_position(['low', 'medium', 'high', 'supplemental'], severity), seg, g, k, j) as ord from ev)"""


def manifest_stats(spark: SparkSession, d: str) -> DataFrame:
    got = reports.manifest_stats(table(spark, d, "events"), F.col("value"))
    return got.select("n", F.round("hours", 6).alias("hours"), F.round("avg_s", 6).alias("avg_s"), "min_s", "max_s")


def segments_from_json(spark: SparkSession, d: str) -> DataFrame:
    """Turns written as JSON in six shapes by turn, and parsed back."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.trim("text").alias("text"))
    seg = F.array(F.struct(F.col("text"), F.lit(1.5).alias("start"), F.lit(2.5).alias("end")))
    shape = F.col("turn") % 6
    json = (
        F.when(shape == 0, F.to_json(seg)).when(shape == 1, F.to_json(F.array("text")))
        .when(shape == 2, F.to_json(F.struct(seg.alias("segments")))).when(shape == 3, F.to_json(F.struct(F.col("text").alias("transcription"), F.lit(9.0).alias("duration"))))
        .when(shape == 4, F.to_json(F.struct(F.col("text"), F.lit(9.0).alias("duration")))).otherwise(F.lit("{broken"))
    )
    return c.select("conv_id", "turn", F.inline(ingest.parse_transcription(json)))


def chunk_explode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.inline(ingest.chunk_bounds(F.col("n_chars"), 1000)))


def duration_filter_split(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(ingest.usable(F.col("value"))).select("event_id", "value")
    return sampling.split_first(e, ["event_id"]).groupBy("part").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def recordings_join_files(spark: SparkSession, d: str) -> DataFrame:
    """Orders as recordings, line flags as files: those with both an audio (A) and a transcript (R) file."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("rec_id"), "o_orderstatus")
    kind = F.when(F.col("l_returnflag") == "A", "audio").when(F.col("l_returnflag") == "R", "transcription").otherwise("metadata")
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rec_id"), kind.alias("kind"))
    return ingest.with_files(orders, files)


def prediction_choice(spark: SparkSession, d: str) -> DataFrame:
    """Per conversation: the assistant's turns stand for fine-tuned predictions, the user's for pretrained ones."""
    c = table(spark, d, "conversations")
    row = F.struct(F.col("turn").cast("int").alias("id"), F.col("text").alias("reference"), F.col("text").alias("hypothesis"), F.lit(None).cast("string").alias("reference_normalized"), F.lit(None).cast("string").alias("hypothesis_normalized"), F.lit(0.0).alias("wer"))
    both = c.groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "user", row)).alias("pretrained"), F.collect_list(F.when(F.col("role") == "assistant", row)).alias("finetuned"))
    chosen = ingest.choose_predictions(both, "conv_id")
    return chosen.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The corpus error counts of the first and second pseudo-model side by side."""
    scored = model_rows(spark, d).where(F.col("model").isin("m1", "m2")).select("model", edit.word_distance(F.col("ref"), F.col("hyp")).alias("edits"), F.size("ref").cast("long").alias("ref_words"))
    wide = scored.groupBy().pivot("model", ["m1", "m2"]).agg(F.sum("edits").alias("edits"), F.sum("ref_words").alias("words"))
    return wide.select("m1_edits", "m2_edits", "m1_words", (F.col("m1_edits") - F.col("m2_edits")).alias("improvement"))


def normalized_wer_delta(spark: SparkSession, d: str) -> DataFrame:
    """Word errors of each turn against a corrupted copy in capitals, raw and with both texts normalised."""
    e = evaluation.evaluate(transcripts(spark, d).where("model = 'pretrained'"))
    raw = edit.word_distance(T.words(F.col("reference")), T.words(F.col("hypothesis")))
    return e.select("seg", raw.alias("raw_edits"), "edits", "ref_words")


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """seg, model, reference, hypothesis: every turn and its corrupted copies by two models, which write capitals and commas."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seg"), F.col("text").alias("reference"))
    words = F.transform(T.words(F.col("reference")), lambda w: F.concat(w, F.lit(",")))
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.translate(F.array_join(corrupt(words, F.col("seg"), k), " "), ROMAN, ROMAN.upper()).alias("hypothesis")) for m, k in (("pretrained", 1), ("finetuned", 3))])
    return c.select("seg", "reference", F.inline(models))


def wer_results(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluate_models(transcripts(spark, d))


def wer_predictions(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluate(transcripts(spark, d)).select("seg", "model", "reference_normalized", "hypothesis_normalized", "wer")


def wer_improvement(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.improvement(wer_results(spark, d), "pretrained", "finetuned")


def prediction_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Turns of which every third has no normalised reference and every fourth no normalised hypothesis."""
    e = evaluation.evaluate(transcripts(spark, d).where("model = 'finetuned'"))
    e = e.withColumn("reference_normalized", F.when(F.col("seg") % 3 != 0, F.col("reference_normalized")))
    e = e.withColumn("hypothesis_normalized", F.when(F.col("seg") % 4 != 0, F.col("hypothesis_normalized")))
    return evaluation.with_fallback(e).select("seg", "reference_normalized", "hypothesis_normalized")


def repaired(spark: SparkSession, d: str) -> DataFrame:
    """seg, reference, hypothesis of every turn in mixed script, with fillers and confused signs, and their repair."""

    def one(w: Column, i: Column) -> Column:
        at = i + F.col("seg")
        return F.when(at % 6 == 0, F.concat(F.lit("अ "), w)).when(at % 8 == 2, F.concat(w, F.lit(" हम्म"))).when(at % 5 == 0, F.concat(w, F.lit(" हे"))).otherwise(w)

    m = mixed(spark, d).select("seg", F.col("text").alias("reference"), F.array_join(F.transform("words", one), " ").alias("hypothesis"))
    return evaluation.repair_evaluation(m)


def repair_wer(spark: SparkSession, d: str) -> DataFrame:
    return repaired(spark, d).select("seg", "after", "wer_before", "wer_after", "improved")


def repair_improved(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.improved_count(repaired(spark, d))


def taxonomy_sheet(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.taxonomy_rows(error_evidence(spark, d))


_NORM = r"trim(regexp_replace(lower(regexp_replace(nfc_normalize(text), '[,.!?;:\"''()\[\]{}\-–—…]', ' ', 'g')), '\s+', ' ', 'g'))"
_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
_UNITS = _sql_list([w.split("/")[0] for w in vocab.UNIT_WORDS.split()])


def _num(n: str, additive: bool) -> str:
    rest = f"{n} % 100"
    value = f"{n}" if additive else f"case when {rest} > 0 then {n} // 1000 * 1000 + {rest} else {n} end"
    return f"({value})"


def _normal(c: str) -> str:
    return _NORM.replace("(text)", f"({c})")


def _split(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


TRANSCRIPTS = f"""c as (select conv_id * 1000 + turn as seg, text as reference, list_transform({_WORDS}, lambda w: w || ',') as w from conversations),
tr as (select seg, model, reference, translate(array_to_string(list_filter(list_transform(w, lambda x, i: case when (i - 1 + seg) % (k + 6) = 0 then '' when (i - 1 + seg) % (k + 4) = 0 then x || 'x' else x end), lambda x: x <> ''), ' '), '{ROMAN}', '{ROMAN.upper()}') as hypothesis
 from c, (values ('pretrained', 1), ('finetuned', 3)) m(model, k)),
nm as (select *, {_normal("reference")} as rn, {_normal("hypothesis")} as hn from tr),
ut as (select *, {_split("rn")} as ref, {_split("hn")} as hyp from nm),
ed as materialized (select *, {DIST} as edits, len(ref) as ref_words from ut),
cw as materialized (select model, sum(edits)::bigint as edits, sum(ref_words)::bigint as ref_words, count(*) as num_samples, sum(edits) / sum(ref_words) as wer from ed group by model)"""

_NOT_IN_WORD = r"[^\p{L}\p{N}_]"
REPAIRED = f"""{MIXED},
hy as (select seg, array_to_string(words, ' ') as reference, array_to_string(list_transform(words, lambda w, i: case when (i - 1 + seg) % 6 = 0 then 'अ ' || w when (i - 1 + seg) % 8 = 2 then w || ' हम्म' when (i - 1 + seg) % 5 = 0 then w || ' हे' else w end), ' ') as hypothesis from mx),
f1 as (select *, replace(regexp_replace(hypothesis, '([कखगघ])([^ं])([पबमभ])', '\\1ं\\2\\3', 'g'), 'हे', 'है') as s1 from hy),
f2 as (select *, regexp_replace(regexp_replace(s1, '(^|{_NOT_IN_WORD})अ\\s', '\\1 ', 'g'), '(^|{_NOT_IN_WORD})हम्म($|{_NOT_IN_WORD})', '\\1\\2', 'g') as s2 from f1),
f3 as (select seg, reference, hypothesis, trim(regexp_replace(s2, '\\s+', ' ', 'g')) as after from f2),
f4 as (select *, {_split("reference")} as ref, {_split(_normal("hypothesis"))} as h0, {_split(_normal("after"))} as h1 from f3),
f5 as (select *, {DIST.replace("hyp", "h0")} as e0, {DIST.replace("hyp", "h1")} as e1 from f4),
rp as materialized (select seg, after, case when len(ref) > 0 then e0 / len(ref) else 0 end as wer_before, case when len(ref) > 0 then e1 / len(ref) else 0 end as wer_after, len(ref) > 0 and e1 < e0 as improved from f5)"""

# SENTENCES as numbers in figures, by both ways of reading.
CONVERTED = [
    ("मेरे पास 200 रुपये हैं", "मेरे पास 200 रुपये हैं"), ("54 लोग आए", "354 लोग आए"), ("25 दिन बाद मिलो", "25 दिन बाद मिलो"), ("1000 रुपये चाहिए", "1000 रुपये चाहिए"),
    ("दो-चार बातें कर लो", "दो-चार बातें कर लो"), ("नौ दो ग्यारह हो गया", "नौ दो ग्यारह हो गया"), ("100 रुपये 2", "100 रुपये 2"),
    ("230000", "230000"), ("1200", "1200"), ("30", "30"), ("1100", "1100"), ("दो, दस।", "दो, दस।"), ("कंप्यूटर पर hello! लिखो", "कंप्यूटर पर hello! लिखो"),
]


QUERIES = {
    f.__name__: f
    for f in (
        wer_utterance, wer_by_role, wer_corpus_by_lang, cer_utterance, align_ops, align_counts, lattice_votes, lattice_bins, lattice_wer,
        lattice_model_summary, lattice_wide, normalize_text, normalize_word, token_count, sentence_split, script_profile, url_parts,
        number_parse, number_prefix, number_sentences, number_changed_count, cleanup_examples, english_detect, english_tag, english_summary,
        english_top_words, spelling_classify, spelling_summary, spelling_low_review, spelling_unreliable, error_sample, stratum_sizes,
        error_classify, error_taxonomy, error_top3_fixes, repair_before_after, manifest_stats, segments_from_json, chunk_explode,
        duration_filter_split, recordings_join_files, prediction_choice, model_comparison, normalized_wer_delta,
        wer_results, wer_predictions, wer_improvement, prediction_fallback, repair_wer, repair_improved, taxonomy_sheet,
    )
}

ORACLES = {
    "wer_utterance": f"with {UTT} select seg, {DIST} as edits, len(ref) as ref_words from u",
    "wer_by_role": f"with {UTT}, x as (select role, {DIST} as edits, len(ref) as n from u) select role, sum(edits)::bigint as edits, sum(n)::bigint as ref_words, count(*) as num_samples, sum(edits) / sum(n) as wer from x group by role",
    "cer_utterance": f"with {UTT} select seg, levenshtein(array_to_string(ref, ''), array_to_string(hyp, '')) / length(array_to_string(ref, '')) as cer from u",
    "align_ops": f"with {MODEL_SQL} select segment, model, ops from a",
    "align_counts": f"with {MODEL_SQL} select op, count(*) as n from st group by op",
    "lattice_votes": f"with {MODEL_SQL} select segment, pos, word, n, \"similar\" from v",
    "lattice_bins": f"with {MODEL_SQL} select segment, pos, array_to_string(words, ' ') as words from bins",
    "lattice_wer": f"with {MODEL_SQL} select segment, model, ref_len, hyp_len, std_errors, lat_errors, std_errors / ref_len as std_wer, lat_errors / ref_len as lat_wer from sc",
    "lattice_model_summary": f"with {MODEL_SQL} select model, count(*) as num_segments, round(avg(std_errors / ref_len), 9) as avg_standard_wer, round(avg(lat_errors / ref_len), 9) as avg_lattice_wer, round(avg(std_errors / ref_len - lat_errors / ref_len), 9) as avg_improvement from sc group by model",
    "lattice_wide": f"with {MODEL_SQL} select segment, " + ", ".join(f"any_value(case when model = 'm{k}' then std_errors end) as m{k}_std, any_value(case when model = 'm{k}' then lat_errors end) as m{k}_lat" for k in MODELS) + " from sc group by segment",
    "normalize_text": f"with x as (select doc_id, {_NORM} as norm from documents) select doc_id, length(norm) as chars, md5(norm) as norm_md5 from x",
    "normalize_word": r"with w as (select unnest(" + _WORDS + r") as w from conversations) select lower(ltrim(rtrim(w, '।,!?;:.""''-–—'), '""''')) as word, count(*) as n from w group by 1".replace('""', '"'),
    "token_count": f"select conv_id, turn, len({_WORDS}) as tokens from conversations",
    "sentence_split": r"with x as (select doc_id, list_filter(list_transform(string_split_regex(text, '[।.?!]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') as s from documents) select doc_id, len(s) as sentences, md5(array_to_string(s, '|')) as sentences_md5 from x",
    "script_profile": f"with {MIXED} select seg, len(words) as words, len(list_filter(words, lambda w: length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) > 0 and length(regexp_replace(w, '[^{_D}]', '', 'g')) / length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) > 0.5)) as devanagari, len(list_filter(words, lambda w: regexp_matches(w, '[A-Za-z]'))) as roman from mx",
    "url_parts": f"select page_id, replace(url, 'https://', '{BASES[1]}') as rewritten, regexp_replace(string_split(url, '/')[-1], '_(audio|transcription|metadata)\\.\\w+$', '') as rec_id, string_split(rtrim(url, '/'), '/')[-2] as folder from pages",
    "number_parse": f"with x as (select o_orderkey, o_orderkey % 100000 as n from orders) select o_orderkey, 'मेरे पास ' || case when n = 0 then '' else {_num('n', False)}::varchar || ' ' end || 'रुपये' as compat, 'मेरे पास ' || case when n = 0 then '' else {_num('n', True)}::varchar || ' ' end || 'रुपये' as additive from x",
    "number_prefix": "with x as (select p_partkey, p_partkey % 100000 as n from part) select p_partkey, case when n > 0 then n end as value, ((n >= 1000)::int * 2 + (n // 100 % 10 > 0)::int * 2 + (n % 100 > 0)::int)::bigint as consumed from x",
    "number_sentences": f"with c as (select unnest({_sql_list(SENTENCES)}) as text, unnest({_sql_list([c[0] for c in CONVERTED])}) as compat, unnest({_sql_list([c[1] for c in CONVERTED])}) as additive) select n_nationkey, text, compat, additive, compat <> text as changed, regexp_matches(text, '{'|'.join(i.replace(' ', chr(92) + 's+') for i in vocab.IDIOMS)}') as idiomatic from nation, c",
    "number_changed_count": "select count(*) as total, count(*) filter (where l_quantity::bigint % 100000 > 0) as changed from lineitem",
    "cleanup_examples": f"with x as (select o_orderkey, o_orderkey % 100 as n from orders where o_orderkey % 100 > 0 order by o_orderkey limit 5), r as (select 'Correct Conversion' as kind, {_UNITS}[n + 1] as before, n::varchar as after, n::varchar as reference, '' as note from x), y as (select * from (values " + ", ".join(f"({i}, " + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for i, row in enumerate(reports.SYNTHETIC)) + ") v(ord, kind, before, after, reference, note)) select * from r union all select kind, before, after, reference, note from y where kind = 'Edge Case' or ord < 4 - (select count(*) from r)",
    "english_detect": f"with {ENGLISH} select seg, len(found) as english_words, len(words) as total_words, array_to_string(list_transform(found, lambda x: x.w), ' ') as words, array_to_string(list_transform(found, lambda x: x.m), ' ') as methods from e",
    "english_tag": f"with {ENGLISH} select seg, array_to_string(list_transform(words, lambda w, i: case when list_contains(list_transform(found, lambda x: x.i), i - 1) then '[EN]' || w || '[/EN]' else w end), ' ') as tagged from e",
    "english_summary": f"with {ENGLISH} select count(*) as transcripts, count(*) filter (where len(found) > 0) as with_english, sum(len(found))::bigint as english_words from e",
    "english_top_words": f"with {ENGLISH}, x as (select seg, unnest(found) as f from e) select f.w as word, count(*) as n from x group by f.w order by n desc, min((seg, f.i)) limit 10",
    "spelling_classify": f"with {SPELL} select * from s",
    "spelling_summary": f"with {SPELL} select classification, confidence, count(*) as n from s group by all",
    "spelling_low_review": f"with {SPELL}, l as (select word, row_number() over (order by word) - 1 as rn, count(*) over () as c from s where confidence = 'low') select word, length(word) as char_count, contains(word, '्') as has_halant, contains(word, '़') as has_nukta, contains(word, 'ं') or contains(word, 'ँ') as has_anusvara, length(regexp_replace(word, '[^\\p{{L}}]', '', 'g')) > 0 and length(regexp_replace(word, '[^{_D}]', '', 'g')) / length(regexp_replace(word, '[^\\p{{L}}]', '', 'g')) > 0.5 as is_devanagari from l where rn % greatest(1, c // 50) = 0 and rn // greatest(1, c // 50) < 50",
    "spelling_unreliable": f"with {SPELL}, x as (select 'Words with nukta (़)' as category, count(*) as total, count(*) filter (where confidence = 'low') as low_confidence from s where contains(word, '़') union all select 'Proper nouns and named entities', count(*), count(*) from s where confidence = 'low' and length(word) > 5 and not regexp_matches(word, '({'|'.join(vocab.VALID_SUFFIXES)})$')) select * from x where total > 0",
    "error_sample": f"with {SAMPLE} select * from smp",
    "stratum_sizes": f"with {SAMPLE} select severity, count(*) as n from er group by severity",
    "error_classify": f"with {EVIDENCE} select seg, category, count(*) as n, array_to_string(list_sort(list(evidence)), '|') as evidence from evo group by seg, category",
    "error_taxonomy": f"with {EVIDENCE}, x as (select *, row_number() over (partition by category order by ord) as kk from evo) select category, count(*) as n, string_agg(evidence, '|' order by ord) filter (where kk <= 5) as examples from x group by category",
    "error_top3_fixes": f"with {EVIDENCE}, x as (select category as category_key, count(*) as n, min(ord) as o from evo group by category), k as (select * from (values " + ", ".join(f"('{c[0]}', '{c[1]}', {str(c[4]).lower()})" for c in vocab.CATEGORIES) + ") k(category_key, name, actionable)) select row_number() over (order by n desc, o)::int as rank, name as category, category_key, n as count, actionable from x join k using (category_key) qualify rank <= 3",
    "repair_before_after": f"with {MIXED}, x as (select seg, array_to_string(words, ' ') as text, trim(regexp_replace(replace(regexp_replace(array_to_string(words, ' '), '([कखगघ])([^ं])([पबमभ])', '\\1ं\\2\\3', 'g'), 'हे', 'है'), '\\s+', ' ', 'g')) as fixed from mx), y as (select seg, fixed, list_filter(string_split(text, ' '), lambda w: w <> '') as a, list_filter(string_split(fixed, ' '), lambda w: w <> '') as b from x) select seg, fixed, len(a) = len(b) as same_length, len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) as changed from y",
    "manifest_stats": "select count(*) as n, round(sum(value) / 3600, 6) as hours, round(avg(value), 6) as avg_s, min(value) as min_s, max(value) as max_s from events",
    "segments_from_json": 'select conv_id, turn, trim(text) as text, case when turn % 6 in (0, 2) then 1.5 else 0.0 end::double as start, case when turn % 6 in (0, 2) then 2.5 when turn % 6 in (3, 4) then 9.0 else 0.0 end::double as "end" from conversations where turn % 6 < 5 and (trim(text) <> \'\' or turn % 6 > 2)',
    "chunk_explode": "select doc_id, i * 1000 as start, least((i + 1) * 1000, n_chars) as stop from (select doc_id, n_chars, unnest(range(0, (n_chars + 999) // 1000)) as i from documents)",
    "duration_filter_split": "with x as (select event_id, row_number() over (order by event_id) - 1 as rn, count(*) over () as c from events where value between 0.5 and 30) select case when rn < floor(0.9 * c) then 'train' else 'eval' end as part, count(*) as n, min(event_id) as first, max(event_id) as last from x group by 1",
    "recordings_join_files": "select o_orderkey as rec_id, o_orderstatus from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag in ('A', 'R') group by 1 having count(distinct l_returnflag) = 2)",
    "prediction_choice": "with x as (select conv_id, turn, role, max((role = 'assistant')::int) over (partition by conv_id) as fine from conversations) select conv_id, count(*) as n, sum(turn)::bigint as ids from x where role = case when fine = 1 then 'assistant' else 'user' end group by conv_id",
    "model_comparison": f"with {MODEL_SQL}, x as (select sum(std_errors) filter (where model = 'm1')::bigint as a, sum(std_errors) filter (where model = 'm2')::bigint as b, sum(ref_len) filter (where model = 'm1')::bigint as n from sc) select a as m1_edits, b as m2_edits, n as m1_words, a - b as improvement from x",
    "normalized_wer_delta": f"with {TRANSCRIPTS}, raw as (select seg, edits, ref_words, {_split("regexp_replace(reference, '\\s+', ' ', 'g')")} as ref, {_split("hypothesis")} as hyp from ed where model = 'pretrained') select seg, {DIST} as raw_edits, edits, ref_words from raw",
    "wer_results": f"with {TRANSCRIPTS} select * from cw",
    "wer_predictions": f"with {TRANSCRIPTS} select seg, model, rn as reference_normalized, hn as hypothesis_normalized, case when ref_words > 0 then edits / ref_words else 0 end as wer from ed",
    "wer_improvement": f"with {TRANSCRIPTS}, b as (select max(wer) filter (where model = 'pretrained') as before, max(wer) filter (where model = 'finetuned') as after from cw) select *, before - after as improvement from b",
    "prediction_fallback": f"with {TRANSCRIPTS} select seg, case when seg % 3 = 0 then reference else rn end as reference_normalized, case when seg % 4 = 0 then hypothesis else hn end as hypothesis_normalized from nm where model = 'finetuned'",
    "repair_wer": f"with {REPAIRED} select * from rp",
    "repair_improved": f"with {REPAIRED} select count(*) as total, count(*) filter (where improved) as improved from rp",
    "taxonomy_sheet": f"with {EVIDENCE}, n as (select category, count(*) as n, min(ord) as o from evo group by category), rk as (select *, row_number() over (order by n desc, o)::int as rank from n), x as (select category, seg, evidence, row_number() over (partition by category order by ord)::int as place from evo), cat as (select * from (values " + ", ".join("('" + "', '".join(str(v).replace("'", "''") for v in c[:3]) + "')" for c in vocab.CATEGORIES) + ") q(category, name, description)) select rank, place as k, coalesce(name, category) as category, rk.n as count, coalesce(description, '') as description, array_to_string(ep.r, ' ') as reference, array_to_string(ep.h, ' ') as hypothesis, evidence from x join rk using (category) join ep using (seg) left join cat using (category) where place <= 3",
}

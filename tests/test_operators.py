"""Operators, sources, sinks, the runner and streams."""

import json

import pytest
from pyspark.sql import functions as F

from speechtab.operators import errors, lattice, reports, sampling
from speechtab.plans.runner import Runner
from speechtab.sources import ingest, sinks
from speechtab.streaming import stream


def plain_sample(rows, least=25):
    """rows: (id, wer) in order of id."""
    bad = [r for r in rows if r[1] > 0]
    strata = [("low", [r for r in bad if r[1] <= 0.3]), ("medium", [r for r in bad if 0.3 < r[1] <= 0.6]), ("high", [r for r in bad if r[1] > 0.6])]
    out = []
    for name, s in strata:
        if s:
            n = max(1, max(least, 25) * len(s) // len(bad))
            out += [(i, name) for i, _ in s[:: max(1, len(s) // n)][:n]]
    if len(out) < least:
        rest = [r for r in bad if r[0] not in {i for i, _ in out}]
        need = least - len(out)
        out += [(i, "supplemental") for i, _ in rest[:: max(1, len(rest) // need)][:need]]
    return sorted(out)


@pytest.mark.parametrize("n,least", [(0, 25), (5, 25), (40, 25), (333, 25), (333, 60), (90, 10)])
def test_sample(spark, n, least):
    rows = [(i * 3, [0.0, 0.1, 0.25, 0.3, 0.45, 0.6, 0.9, 0.31][i * i % 8]) for i in range(n)]
    got = sampling.sample_errors(spark.createDataFrame(rows, "id long, wer double"), ["id"], least)
    assert sorted((r.id, r.severity) for r in got.collect()) == plain_sample(rows, least)


def test_systematic_and_split(spark):
    df = spark.range(103).withColumn("name", F.format_string("w%05d", "id"))
    assert sorted(r.id for r in sampling.systematic(df, ["id"], 10).collect()) == list(range(103))[::10][:10]
    assert sampling.systematic(df, ["name"], 500).count() == 103
    parts = {r.part: r.n for r in sampling.split_first(df, ["id"]).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"train": 92, "eval": 11}


def test_lattice(spark):
    ref = "the cat sat".split()
    hyps = {"a": "the kat sat", "b": "the kat sat down", "c": "the kat sad", "d": "cat sat"}
    long = spark.createDataFrame([(1, m, ref, h.split()) for m, h in hyps.items()] + [(2, "a", ["x"], ["y"])], "segment long, model string, ref array<string>, hyp array<string>")
    got = {(r.segment, r.model): r for r in lattice.lattice_scores(long).collect()}
    # three models say "kat", and it shares most letters with "cat"; "sad" shares two of three with "sat"
    assert [(got[1, m].std_errors, got[1, m].lat_errors) for m in "abcd"] == [(1, 0), (2, 1), (2, 0), (1, 1)]
    assert (got[2, "a"].std_wer, got[2, "a"].lat_wer) == (1.0, 1.0)
    assert all(r.lat_wer <= r.std_wer for r in got.values())
    wide = lattice.wide_report(lattice.lattice_scores(long), ["a", "b", "c", "d"]).where("Segment_URL = 2").first()
    assert wide["b_Standard_WER"] == "N/A" and wide["a_Improvement"] == "0.0000"


def test_unpivot(spark):
    wide = spark.createDataFrame([("u1", "ref", "h", " "), ("u2", "", "h", "k"), ("u3", "r", None, "k")], "url string, Human string, A string, B string")
    got = sorted((r.segment, r.model) for r in lattice.unpivot_models(wide, "url", "Human", ["A", "B"]).collect())
    assert got == [("u1", "A"), ("u3", "B")]


def test_errors(spark):
    rows = [("a b", "ab"), ("की", "कि"), ("बस", "वस"), ("हैं ok", "है ok"), ("x", "x"), ("हम्म क", "क"), ("क ख", "क ख ग"), ("", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r string, h string").orderBy("i")
    got = [[x["category"] for x in r[0]] for r in df.select(errors.classify_error(F.col("r"), F.col("h"))).collect()]
    assert got == [
        ["insertion_deletion", "word_boundary_error", "code_switching_error"], ["vowel_matra_error"], ["consonant_confusion"], ["code_switching_error", "visarga_anusvara"],
        ["code_switching_error"], ["insertion_deletion", "punctuation_filler"], ["insertion_deletion"], ["other"],
    ]


def test_taxonomy(spark):
    rows = [(i, "medium", "क ख", "क") for i in range(7)] + [(9, "low", "की", "कि")]
    ev = errors.evidence_rows(spark.createDataFrame(rows, "id long, severity string, reference string, hypothesis string"), "id")
    tax = {r.category: r for r in errors.taxonomy(ev).collect()}
    assert tax["insertion_deletion"].n == 7 and len(tax["insertion_deletion"].examples) == 5
    fixes = errors.top_fixes(errors.taxonomy(ev)).orderBy("rank").collect()
    assert [(f["rank"], f["category_key"], f["actionable"]) for f in fixes] == [(1, "insertion_deletion", True), (2, "vowel_matra_error", True)]


def test_transcription_shapes(spark):
    shapes = {
        '[{"text": " a ", "start": "1.5", "end": 2}, {"transcription": "b", "start_time": 3, "end_time": 4}, {"text": ""}]': [("a", 1.5, 2.0), ("b", 3.0, 4.0)],
        '["a", " ", "b"]': [("a", 0.0, 0.0), ("b", 0.0, 0.0)],
        '{"segments": [{"text": "a", "start": 1, "end": 2}]}': [("a", 1.0, 2.0)],
        '{"transcription": "a", "duration": 7}': [("a", 0.0, 7.0)],
        '{"text": "a", "duration": 7.5}': [("a", 0.0, 7.5)],
        '"a"': [("a", 0.0, 0.0)],
        "{broken": [],
        "[]": [],
    }
    df = spark.createDataFrame([(k,) for k in shapes], "j string")
    for r in df.select("j", ingest.parse_transcription(F.col("j")).alias("s")).collect():
        assert [tuple(x) for x in r.s] == shapes[r.j], r.j


def test_sources(spark, tmp_path):
    (tmp_path / "w.csv").write_text("word\n क \n\nख\nक\n", encoding="utf-8")
    assert [r.word for r in ingest.read_words(spark, str(tmp_path / "w.csv")).collect()] == ["क", "ख", "क"]
    (tmp_path / "m.csv").write_text("segment_url_link,Human,A,B\nu,r,h,\n", encoding="utf-8")
    long, models = ingest.read_models(spark, str(tmp_path / "m.csv"))
    assert models == ["A", "B"] and long.count() == 1
    row = {"id": 1, "reference": "a", "hypothesis": "b", "wer": 1.0}
    (tmp_path / "p.json").write_text(json.dumps({"pretrained": [row], "finetuned": []}))
    assert ingest.read_predictions(spark, str(tmp_path / "p.json")).count() == 1
    (tmp_path / "u.json").write_text(json.dumps([{"audio_path": "x", "text": "t", "duration": 2.0}]))
    assert ingest.read_utterances(spark, str(tmp_path / "u.json")).where(ingest.usable(F.col("duration"))).count() == 1
    (tmp_path / "r.csv").write_text("user_id,recording_id,language,duration,rec_url_gcp,transcription_url_gcp,metadata_url_gcp\n1,2,hi,443,o/9/2_audio.wav,o/9/2_transcription.json,o/9/2_metadata.json\n")
    manifest = ingest.rewritten(ingest.read_manifest(spark, str(tmp_path / "r.csv"), 5), "o/", "n/")
    assert manifest.first().rec_id == "2" and manifest.first().folder == "9"
    got = ingest.fetch_all(manifest, lambda url: b"" if "audio" in url else None)
    assert [tuple(r) for r in got.collect()] == [("2", False)]
    assert ingest.read_pairs(spark, None, str(tmp_path / "none.json"), [("a", "b", "c")]).count() == 1


def test_chunks(spark):
    df = spark.createDataFrame([(0,), (5,), (10,), (11,), (None,)], "n int")
    got = [r[0] and [tuple(x) for x in r[0]] for r in df.select(ingest.chunk_bounds(F.col("n"), 5)).collect()]
    assert got == [[], [(0, 5)], [(0, 5), (5, 10)], [(0, 5), (5, 10), (10, 11)], []]


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "दो", "2", "2")], "i int, raw string, normalized string, reference string")
    sheet = sinks.cleanup_sheet(reports.cleanup_examples(pairs, "i"))
    sinks.write_csv(sheet, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 7
    found = reports.english_table(spark.createDataFrame([("मेरा फोन",), ("कुछ",), (None,)], "t string"), F.col("t"))
    assert [r["Detection Methods"] for r in sinks.english_tagged(found, "t").collect()] == ["dictionary", "N/A"]
    doc = json.loads(sinks.report_json(reports.english_summary(found), results=found.select("t")).first().value)
    assert doc["transcripts"] == 2 and len(doc["results"]) == 2


def test_runner(spark):
    r = Runner()
    r.step("one")(lambda s, done: s.range(1))
    r.step("bad")(lambda s, done: 1 / 0)
    r.step("two")(lambda s, done: done["one"].union(s.range(2)))
    results, summary = r.run(spark, continue_on_error=True)
    assert results["two"].count() == 3 and [x["ok"] for x in summary] == [True, False, True]
    with pytest.raises(ZeroDivisionError):
        r.run(spark)
    with pytest.raises(KeyError):
        r.run(spark, ["none"])


def test_stream(spark, tmp_path):
    spark.createDataFrame([("दो सौ फोन",)], "text string").write.parquet(str(tmp_path / "in"))
    q = stream.cleaned(spark.readStream.schema("text string").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("cleaned").start()
    try:
        q.processAllAvailable()
        assert spark.table("cleaned").first().normalized == "200 फोन"
    finally:
        q.stop()


def test_catalogue_oracles(spark):
    """Every query against its oracle on the smallest tables."""
    import duckdb

    from speechtab.plans.catalogue import ORACLES, QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "nation part orders lineitem events documents pages benchmark conversations".split():
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    import pandas as pd

    def shown(v):
        if pd.isna(v):
            return ""
        return str(v) if isinstance(v, (bool, str)) or not hasattr(v, "__float__") else str(round(float(v), 9))

    for name, sql in ORACLES.items():
        a, b = QUERIES[name](spark, d).toPandas(), con.sql(sql).df()
        assert sorted(a.columns) == sorted(b.columns), name
        rows = lambda x: sorted(tuple(map(shown, r)) for r in x[sorted(x.columns)].astype(object).itertuples(index=False))
        assert rows(a) == rows(b), name


def test_wer_by_language(spark):
    """The query without an oracle, against plain distances."""
    from speechtab.functions.edit import distance
    from speechtab.plans import catalogue as c

    d = "/root/testdata/sf0.001"
    docs = c.table(spark, d, "documents").select("lang", "doc_id", c.tokens(F.col("text")).alias("ref")).withColumn("hyp", c.corrupt(F.col("ref"), F.col("doc_id"), 1))
    want = {}
    for r in docs.collect():
        e, n = want.get(r.lang, (0, 0))
        want[r.lang] = (e + distance(r.ref, r.hyp), n + len(r.ref))
    assert {r.lang: (r.edits, r.ref_words) for r in c.wer_corpus_by_lang(spark, d).collect()} == want

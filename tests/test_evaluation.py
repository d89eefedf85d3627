"""Evaluation, repair and taxonomy sheets, and the seams of the sources."""

import json

import pytest
from pyspark.sql import functions as F

from speechtab.functions import english, numbers
from speechtab.functions import text as T
from speechtab.operators import errors, evaluation
from speechtab.sources import ingest, sinks

# A published sample's texts and its rates before and after the repair.
REFERENCE = "टेलीविजन रिपोर्टों में प्लांट से निकलने वाला सफेद धुआं दिखाया गया है"
HYPOTHESIS = " तेलीविशन रिपोटो में प्लाँट से निकलने वाला सबे दूए दूए गया हैर।"
RATE = 0.5833


def test_evaluate(spark):
    rows = [(1, "m", "a b, c", "A b x"), (2, "m", "", "x"), (3, "m", None, None), (4, "m", "a b", None)]
    df = spark.createDataFrame(rows, "id int, model string, reference string, hypothesis string")
    assert {r.id: (r.edits, r.ref_words, r.wer) for r in evaluation.evaluate(df).collect()} == {1: (1, 3, 1 / 3), 2: (1, 0, 0.0), 3: (0, 0, 0.0), 4: (2, 2, 1.0)}
    got = evaluation.evaluate_models(df.union(df.withColumn("model", F.lit("n")).where("id = 1")))
    assert {r.model: (r.edits, r.ref_words, r.num_samples) for r in got.collect()} == {"m": (4, 5, 4), "n": (1, 3, 1)}
    assert evaluation.improvement(got, "m", "n").first().improvement == pytest.approx(0.8 - 1 / 3)
    assert evaluation.evaluate_models(df.where("false")).count() == 0


def test_repair(spark):
    df = spark.createDataFrame([(1, REFERENCE, HYPOTHESIS), (2, "क है", "क हे"), (3, None, "x")], "id int, reference string, hypothesis string")
    got = evaluation.repair_evaluation(df)
    sheet = evaluation.repair_sheet(got, "id").collect()
    assert [(r.WER_Before, r.WER_After, r.Improved) for r in sheet] == [(RATE, RATE, False), (0.5, 0.0, True), (0.0, 0.0, False)]
    assert sheet[0].After_Fix == HYPOTHESIS.strip()
    assert tuple(evaluation.improved_count(got).first()) == (3, 1)
    # a normalised reference goes first
    assert evaluation.repair_evaluation(df.where("id = 2").withColumn("reference_normalized", F.lit("क हे"))).first().wer_before == 0.0


def test_fallback(spark):
    df = spark.createDataFrame([("a", "b", "c", None), ("a", None, None, None)], "reference string, hypothesis string, reference_normalized string, hypothesis_normalized string")
    assert [(r.reference_normalized, r.hypothesis_normalized) for r in evaluation.with_fallback(df).collect()] == [("c", "b"), ("a", "")]


def test_taxonomy_rows(spark):
    rows = [(i, "low", "a b c", "a") for i in range(4)] + [(9, "high", REFERENCE, REFERENCE)]
    df = spark.createDataFrame(rows, "id int, severity string, reference string, hypothesis string")
    got = evaluation.taxonomy_rows(errors.evidence_rows(df, "id")).collect()
    assert all(r.k <= 3 for r in got) and len({r["rank"] for r in got}) == len({r.category for r in got})
    top = sorted((r["rank"], r.k, r["count"]) for r in got)
    assert [t[2] for t in top] == sorted((t[2] for t in top), reverse=True)
    dropped = [r for r in got if r.category == "Insertion / Deletion"]
    assert [(r["count"], r.reference, r.evidence) for r in dropped] == [(4, "a b c", "Deletion: 2 word(s) dropped")] * 3


def test_manifest_head(spark, tmp_path):
    head = "user_id,recording_id,language,duration,rec_url_gcp,transcription_url_gcp,metadata_url_gcp\n"
    (tmp_path / "m.csv").write_text(head + "".join(f"u,{i},hi,1.5,a,b,c\n" for i in range(50)))
    assert [r.recording_id for r in ingest.read_manifest(spark, str(tmp_path / "m.csv"), 4).collect()] == ["0", "1", "2", "3"]


def test_transcripts(spark, tmp_path):
    def model(audio):
        if audio == "bad":
            raise ValueError("no sound")
        return audio.upper()

    utterances = spark.createDataFrame([("a", "x", 1.0), ("bad", "y", 1.0)], ingest.UTTERANCES)
    made = ingest.raw_transcripts(utterances, model)
    good, failures = ingest.split_failures(made)
    assert [tuple(r) for r in good.collect()] == [("a", "A", "x")]
    assert [tuple(r) for r in failures.collect()] == [("ValueError: no sound", 1)]
    pairs = ingest.read_pairs(spark, None, str(tmp_path / "none"), [("f", "f", "f")], lambda: good)
    assert [r.audio_path for r in pairs.collect()] == ["a"]
    assert ingest.read_pairs(spark, None, None, [("f", "f", "f")], lambda: good.where("false")).first().audio_path == "f"


def test_fetch_rules(spark):
    def fetch(url):
        if url == "down":
            raise OSError
        return None if url == "404" else b"x"

    rows = [("1", "a", "b", "404"), ("2", "404", "b", "c"), ("3", "down", "b", None), ("4", "kept", "b", "c")]
    df = spark.createDataFrame(rows, "rec_id string, rec_url_gcp string, transcription_url_gcp string, metadata_url_gcp string")
    got = ingest.fetch_all(df, lambda u: None if u == "kept" else fetch(u), have=lambda u: u == "kept", pause=0.0)
    assert {r.rec_id: (r.ok, r.failed) for r in got.collect()} == {"1": (True, ["metadata"]), "2": (False, ["audio"]), "3": (False, ["audio", "metadata"]), "4": (True, [])}


def test_reports(spark):
    pairs = spark.createDataFrame([(i, "a", "a" if i % 2 else "b", "r") for i in range(80)], "id int, raw string, normalized string, reference string")
    got = json.loads(sinks.cleanup_results(pairs, spark.createDataFrame([("k", "v")], "kind string, note string"), "id").first().value)
    assert (got["total_pairs"], got["modified_count"], len(got["all_pairs"]), got["examples"]) == (80, 40, 50, [{"kind": "k", "note": "v"}])


def test_registered(spark):
    T.register(spark)
    text = " Hello, — दुनिया!  X y"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(F.expr("normalize_text(t)").alias("a"), T.normalize_text(F.col("t")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
    assert spark.range(1).select(T.thousands(F.lit(177508))).first()[0] == "177,508"


def test_columns_by_name(spark):
    df = spark.createDataFrame([("नौ दो ग्यारह हो गया", "घर"), ("दस घर", "घर car")], "t string, e string")
    got = df.select(numbers.convert_numbers("t").alias("n"), english.tag("e").alias("e")).collect()
    assert [tuple(r) for r in got] == [("नौ दो ग्यारह हो गया", "घर"), ("10 घर", "घर [EN]car[/EN]")]

"""Sources: manifests, word lists, multi-model sheets, predictions, transcription JSON, recordings and chunks.

``fetch`` is a seam: the network and audio are outside the analytic core, so callers hand in the function.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab.functions import text as T
from speechtab.operators.lattice import unpivot_models

MANIFEST = "user_id string, recording_id string, language string, duration double, rec_url_gcp string, transcription_url_gcp string, metadata_url_gcp string"
UTTERANCES = "audio_path string, text string, duration double"
PAIRS = "audio_path string, raw_asr string, human_reference string"
_PREDICTION = "array<struct<id:int,reference:string,hypothesis:string,reference_normalized:string,hypothesis_normalized:string,wer:double>>"
PREDICTIONS = f"pretrained {_PREDICTION}, finetuned {_PREDICTION}"


def read_manifest(spark: SparkSession, path: str, max_samples: int | None = None) -> DataFrame:
    """The manifest, or its first ``max_samples`` rows in the order of the file."""
    df = spark.read.csv(path, schema=MANIFEST, header=True, encoding="UTF-8")
    if not max_samples:
        return df
    at = [F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row")]
    return df.select("*", *at).orderBy("__path", "__block", "__row").limit(max_samples).select(*df.columns)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """The column ``word``, stripped, without empty ones; repeats stay."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)
    return df.select(F.regexp_replace("word", r"(?U)^\s+|\s+$", "").alias("word")).where("word <> ''")


def read_models(spark: SparkSession, path: str, key: str = "segment_url_link", reference: str = "Human") -> tuple[DataFrame, list[str]]:
    """The long table of model transcripts, and the models: every other filled header."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    models = [c for c in df.columns if c not in (key, reference) and c.strip() and not c.startswith("_c")]
    return unpivot_models(df, key, reference, models), models


def choose_predictions(df: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, and the rows of the fine-tuned predictions if there are any, else of the pretrained ones."""
    none = F.array().cast(_PREDICTION)
    return df.select(*keep, F.inline(F.coalesce(F.nullif(F.col("finetuned"), none), F.nullif(F.col("pretrained"), none))))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return choose_predictions(spark.read.json(path, schema=PREDICTIONS, multiLine=True))


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=UTTERANCES, multiLine=True)


def read_pairs(spark: SparkSession, path: str | None, cached: str | None, fallback: list[tuple], generate: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Pairs of raw and human transcripts: the given file, else the cached one, else generated ones, else the fallback rows.

    ``generate`` gives pairs (columns of PAIRS), for example by ``raw_transcripts`` over a manifest's utterances; where it
    gives no row, the fallback stands. Generated pairs are read twice, so callers write costly ones first.
    """
    for p in (path, cached):
        if p and exists(spark, p):
            return spark.read.json(p, schema=PAIRS, multiLine=True)
    made = generate() if generate else None
    if made is not None and not made.isEmpty():
        return made.select("audio_path", "raw_asr", "human_reference")
    return spark.createDataFrame(fallback, PAIRS)


def raw_transcripts(utterances: DataFrame, transcribe: Callable[[str], str]) -> DataFrame:
    """audio_path, raw_asr, human_reference, error of every utterance (columns of UTTERANCES).

    ``transcribe`` is the seam for a speech model. Where it fails, raw_asr is null and error names the failure;
    ``split_failures`` drops and counts such rows.
    """

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def said(audio: str) -> tuple[str | None, str | None]:
            try:
                return transcribe(audio), None
            except Exception as e:  # any failure of the model costs its row only
                return None, f"{type(e).__name__}: {e}"

        for pdf in it:
            got = [said(a) for a in pdf["audio_path"]]
            yield pd.DataFrame({"audio_path": pdf["audio_path"], "raw_asr": [g[0] for g in got], "human_reference": pdf["text"], "error": [g[1] for g in got]})

    return utterances.select("audio_path", "text").mapInPandas(batches, f"{PAIRS}, error string")


def split_failures(transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``raw_transcripts`` that have no error, and the number of failures by error."""
    good = transcripts.where("error is null").drop("error")
    return good, transcripts.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_text(*candidates: Column) -> Column:
    """The first present candidate (null: missing; an empty one counts)."""
    return F.coalesce(*candidates)


def rewritten(manifest: DataFrame, old: str, new: str) -> DataFrame:
    """The manifest with rewritten URLs, rec_id and folder."""
    urls = ["rec_url_gcp", "transcription_url_gcp", "metadata_url_gcp"]
    out = manifest.withColumns({u: T.rewrite_url(F.col(u), old, new) for u in urls})
    return out.withColumn("rec_id", T.recording_id(F.col(urls[0]))).withColumn("folder", T.user_folder(F.col(urls[0])))


def with_files(recordings: DataFrame, files: DataFrame) -> DataFrame:
    """Recordings of which both the audio and the transcript are among ``files`` (rec_id, kind)."""
    have = files.where(F.col("kind").isin("audio", "transcription")).groupBy("rec_id").agg(F.count_distinct("kind").alias("n"))
    return recordings.join(have.where("n = 2").select("rec_id"), "rec_id", "left_semi")


def fetch_all(
    records: DataFrame, fetch: Callable[[str], bytes | None], retries: int = 3, have: Callable[[str], bool] | None = None, pause: float = 2.0
) -> DataFrame:
    """rec_id, ok, failed: each record's audio and transcript are fetched, and its metadata, which may fail.

    A URL that ``have`` knows is not fetched again. Each other one gets up to ``retries`` attempts: an OSError is followed
    by ``pause`` seconds, an answer of None costs an attempt without a pause. ``failed`` lists the kinds that were not got.
    """
    kinds = {"audio": "rec_url_gcp", "transcription": "transcription_url_gcp", "metadata": "metadata_url_gcp"}

    def got(url: str | None) -> bool:
        if url and have and have(url):
            return True
        for _ in range(retries if url else 0):
            try:
                if fetch(url) is not None:
                    return True
            except OSError:
                time.sleep(pause)
        return False

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            failed = [[k for k, c in kinds.items() if not got(row[c])] for _, row in pdf.iterrows()]
            ok = [not {"audio", "transcription"} & set(f) for f in failed]
            yield pd.DataFrame({"rec_id": pdf["rec_id"], "ok": ok, "failed": failed})

    return records.select("rec_id", *kinds.values()).mapInPandas(batches, "rec_id string, ok boolean, failed array<string>")


def parse_transcription(json: Column) -> Column:
    """Array of (text, start, end) from any of the transcription shapes; invalid JSON gives an empty array.

    A list of objects or of strings, an object with segments, with transcription or text (and duration), or a string.
    Segments with empty text are left out of lists.
    """
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(v)
    get = lambda path, t: F.try_variant_get(v, path, t)
    segment = "array<struct<text:string,transcription:string,start:string,start_time:string,end:string,end_time:string>>"
    number = lambda c: F.coalesce(F.expr("1").cast("double") * 0 + c.cast("double"), F.lit(0.0))

    def item(x: Column) -> Column:
        said = F.coalesce(x["text"], x["transcription"], F.lit(""))
        return F.struct(F.trim(said).alias("text"), number(F.coalesce(x["start"], x["start_time"])).alias("start"), number(F.coalesce(x["end"], x["end_time"])).alias("end"))

    def plain(c: Column, end: Column) -> Column:
        return F.struct(F.trim(c).alias("text"), F.lit(0.0).alias("start"), end.alias("end"))

    full = lambda a: F.filter(a, lambda s: s["text"] != "")
    objects = lambda path: full(F.transform(get(path, segment), item))
    strings = full(F.transform(get("$", "array<string>"), lambda s: plain(s, F.lit(0.0))))
    duration = F.coalesce(get("$.duration", "double"), F.lit(0.0))
    none = F.array().cast("array<struct<text:string,start:double,end:double>>")
    said = F.coalesce(get("$.transcription", "string"), get("$.text", "string"))
    return F.coalesce(
        F.when(F.startswith(kind, F.lit("ARRAY<OBJECT")), objects("$")).when(F.startswith(kind, F.lit("ARRAY<STRING")), strings)
        .when(F.startswith(kind, F.lit("OBJECT")), F.coalesce(objects("$.segments"), F.when(said.isNotNull(), F.array(plain(said, duration)))))
        .when(kind == "STRING", full(F.array(plain(get("$", "string"), F.lit(0.0))))),
        none,
    )


def chunk_bounds(length: Column, size: int) -> Column:
    """Array of (start, stop): consecutive chunks of ``size``, the last one short; none of nothing."""
    starts = F.when(length > 0, F.sequence(F.lit(0).cast("long"), F.floor((length - 1) / size))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda i: F.struct((i * size).alias("start"), F.least((i + 1) * size, length.cast("long")).alias("stop")))


def usable(duration: Column) -> Column:
    return duration.between(0.5, 30)

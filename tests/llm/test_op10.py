import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from speechtab.llm.graph import components
from speechtab.llm.op10_similar import drop_near_copies
from speechtab.llm.op10_simhash import hex16, near_duplicates


def fp(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    g = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(docs):
    f = np.array([fp(t) for _, t in docs], dtype=np.uint64)
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4):
            root[find(i)] = find(int(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{int(f[i]):016x}", least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def check(spark, docs, **kw):
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), **kw)
    got = got.select("doc_id", hex16(F.col("fp")), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)


def texts(n, seed):
    r = random.Random(seed)
    base = [[r.choice("abcdefghijklmnop") * r.randint(1, 4) for _ in range(r.randint(1, 120))] for _ in range(n // 8)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = r.choice("xyz") * 3
        out.append((i, " ".join(w)))
    return out


def test_links(spark):
    docs = texts(300, 3) + [(1000, None), (1001, ""), (1002, " \t"), (None, "a b"), (7, "A b C d e"), (7, "A b C d e"), (1003, "word " * 100_000)]
    check(spark, docs)
    check(spark, docs, run_limit=3)  # long runs through the full balls


def test_dense_fingerprints(spark):
    """Chains and balls of fingerprints, fed to the search as they are."""
    from speechtab.llm.op10_simhash import links

    r = random.Random(1)
    start = [r.getrandbits(64) for _ in range(6)]
    fps = {s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for s in start for _ in range(80)}
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    a = np.array(fps, dtype=np.int64).view(np.uint64)
    want = {(fps[i], fps[j]) for i in range(len(a)) for j in range(i) if np.bitwise_count(a[i] ^ a[j]) <= 4}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")

    def groups(edges):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in edges:
            root[find(u)] = find(v)
        by = {}
        for x in fps:
            by.setdefault(find(x), set()).add(x)
        return {frozenset(s) for s in by.values()}

    for limit in (100_000, 10):
        got = {(r.u, r.v) for r in links(df, run_limit=limit).collect()}
        assert all(np.bitwise_count(np.uint64(u & (2**64 - 1)) ^ np.uint64(v & (2**64 - 1))) <= 4 for u, v in got)
        assert groups(got) == groups(want)


def test_empty(spark):
    check(spark, [])


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(25)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    for u, v in edges:
        if u != v:
            assert got[u] == got[v] <= min(u, v)
    assert got[60] == 0 and got[539] == 500


def test_drop_near_copies(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    docs = []
    for i in range(30):
        w = [word() for _ in range(r.randint(60, 200))]
        docs.append((len(docs), " ".join(w)))
        for _ in range(r.randint(0, 6)):
            v = list(w)
            for _ in range(r.randint(0, 2)):
                v[r.randrange(len(v))] = word()
            docs.append((len(docs), " ".join(v)))
    docs += [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a c"), (None, "null id"), (905, "null id"), (906, "same row"), (906, "same row")]
    df = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id long, text string, h long")
    want = grouped([(1 << 62 if d is None else d, t or "") for d, t in docs])
    for kw in ({}, {"group_rows": 4, "heads": 2}):
        got = drop_near_copies(df, **kw)
        assert got.columns == df.columns
        ids = [1 << 62 if x.doc_id is None else x.doc_id for x in got.collect()]
        assert len(ids) == len(set(ids)) and set(ids) == want
    assert drop_near_copies(df.limit(0)).count() == 0


def test_null_ids(spark):
    """Null ids beside large ones: the ids stay exact, and a copy with a null id goes."""
    r = random.Random(11)
    base = [f"w{r.getrandbits(40)}" for _ in range(300)]
    big = 2**53 + 1
    rows = [(big + 2, " ".join(changed(r, base, 2))), (None, " ".join(changed(r, base, 2))), (big, " ".join(base)), (None, "by itself"), (None, "by itself")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((x.doc_id for x in drop_near_copies(df).collect()), key=str) == [big, None]
    assert {x.doc_id for x in near_duplicates(df).collect()} == {big, big + 2, None}


def test_hot_group(spark):
    """Groups far larger than a task's bound, runs longer than the bound on pairs, and a shingle that most texts have."""
    r = random.Random(12)
    word = lambda: f"w{r.getrandbits(40)}"
    base, line = [word() for _ in range(120)], [word() for _ in range(30)]
    rows = [changed(r, base, r.randint(0, 5)) for _ in range(150)] + [line + [word() for _ in range(r.randint(0, 12))] for _ in range(60)]
    docs = [(i, " ".join(w)) for i, w in enumerate(rows)]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for kw in ({}, {"group_rows": 8, "heads": 5, "run_rows": 4, "run_block": 16}):
        assert {x.doc_id for x in drop_near_copies(df, **kw).collect()} == grouped(sorted(docs))


def grouped(docs):
    """The least doc_id of each group that chains of exact links reach."""
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    words = [t.lower().split() for _, t in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda k: docs[k][0])
                root[b] = a
    return {d for i, (d, _) in enumerate(docs) if find(i) == i}


def changed(r, words, n):
    v = list(words)
    for i in r.sample(range(len(v)), n):
        v[i] = f"new{r.getrandbits(40)}"
    return v


def test_near_copies_by_reachability(spark):
    """Copies before their base, and chains: links through a text that goes still count."""
    r = random.Random(6)
    rows = []
    for _ in range(6):
        base = [f"w{r.getrandbits(40)}" for _ in range(300)]
        rows += [changed(r, base, 5) for _ in range(5)] + [base]
    chain = [f"w{r.getrandbits(40)}" for _ in range(300)]
    for _ in range(8):
        rows.append(chain)
        chain = changed(r, chain, 4)
    docs = [(i, " ".join(w)) for i, w in enumerate(rows)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for kw in ({}, {"group_rows": 3, "heads": 2}):
        assert {x.doc_id for x in drop_near_copies(df, **kw).collect()} == grouped(docs)


def test_near_copies_at_the_threshold(spark):
    """Subsets of exactly 0.8 of the shingles: no pair may be lost in the search for candidates."""
    r = random.Random(8)
    docs = []
    for i in range(80):
        w = [f"w{r.getrandbits(40)}" for _ in range(304)]
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:244]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id for x in drop_near_copies(df).collect()} == set(range(0, 160, 2))

def test_near_copies_with_repeats(spark):
    """The same set of shingles with other repeat counts is the same set."""
    r = random.Random(9)
    docs = []
    for i in range(20):
        w = [f"w{r.getrandbits(40)}" for _ in range(300)]
        docs += [(2 * i, " ".join(w + w[:4])), (2 * i + 1, " ".join(w[:30] * 8 + w + w[:4]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id for x in drop_near_copies(df).collect()} == grouped(docs)


def nothing(it, least, run_rows):
    import pandas as pd

    for _ in it:
        pass
    yield pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64), "long": np.zeros(0, bool)})


def test_near_copies_by_simhash(spark, monkeypatch):
    """Without the filters behind it, SimHash alone brings the links of fingerprints within four bits to the exact check."""
    from speechtab.llm import op10_similar

    r = random.Random(14)
    docs = []
    for i in range(12):
        base = [f"w{r.getrandbits(40)}" for _ in range(900)]
        for k in (0, 1, 1, 2, 3, 20):
            docs.append((len(docs), " ".join(changed(r, base, k))))
        docs.append((len(docs), " ".join(base[: 600 + 20 * i])))
    docs += [(500, "a b"), (501, "a c"), (502, ""), (503, None)]
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for _, t in docs]
    h = [[xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in s] for s in sets]
    f = [sum(1 << b for b in range(64) if sum(x >> b & 1 for x in hs) * 2 > len(hs)) for hs in h]

    def left(ok):
        root = list(range(len(docs)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(docs)):
            for j in range(i):
                if ok(i, j):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        return [find(i) for i in range(len(docs))]

    sim = left(lambda i, j: (f[i] ^ f[j]).bit_count() <= 4)
    close = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    found = left(lambda i, j: sim[i] == sim[j] and close(i, j))
    want = {docs[i][0] for i in range(len(docs)) if found[i] == i}
    every = {docs[i][0] for i, x in enumerate(left(close)) if x == i}
    assert len(every) < len(want) < len(docs) - 12  # SimHash finds many links, and not all
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id for x in drop_near_copies(df).collect()} == every
    monkeypatch.setattr(op10_similar, "meet", nothing)
    monkeypatch.setattr(op10_similar, "MOST_FREQUENT", 0)
    assert {x.doc_id for x in drop_near_copies(df).collect()} == want

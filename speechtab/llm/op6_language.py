"""Language identification: the family first, then one-versus-one linear support vector machines within it.

Features are hashed byte trigrams of the text and its words' edges, after A-Z and the Latin-1 capitals are lower-cased
and runs of anything but letters become one space; counts are square-rooted and scaled to unit length. The family model
is one linear machine per family against the rest; within the winning family every pair of languages has a machine, and
the language with the most pairwise wins (then the greatest sum of margins) is predicted. Languages that the fixed
family table doesn't name form families of their own.

Models are fitted on the driver by averaged stochastic subgradient steps over at most ``per_language`` documents of
each language and ``total`` of all, those of least hash; held-out rows (crc32 of the doc_id as text, modulo 4, is 2) are never learnt from. Whole
texts are used, in training and prediction.

Text that is null or has no letter gets ``und`` and score 0; so does every text where nothing could be learnt. The score
is the logistic of the smaller of the family's and the language's margins, times the share of pairwise wins. Each row is
predicted on its own, repeated ones and null doc_ids too; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import map_texts

BITS = 14
SIZE = 1 << BITS
# Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indic": "hi mr ne bn pa gu or as ur sa",
    "turkic": "tr az kk ky uz tk",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _i in [*range(0, 65), *range(91, 97), *range(123, 128)]:
    _FOLD[_i] = 32
_LETTER = regex.compile(r"\p{L}")


def features(raw: bytes) -> np.ndarray:
    """Hashed trigram counts (SIZE of them), square-rooted and of unit length."""
    x = _FOLD[np.frombuffer(b" " + raw + b" ", dtype=np.uint8)]
    # Capitals of the Latin-1 block: the byte after 0xC3 from 0x80 to 0x9E.
    second = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E)) + 1
    x[second] += 32
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    x = x[keep].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(SIZE, dtype=np.float32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    out = np.sqrt(np.bincount(slot, minlength=SIZE).astype(np.float32))
    return out / max(float(np.sqrt((out * out).sum())), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, epochs: int = 12, reg: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights (the last one the bias) of a linear machine for y in -1, 1: hinge loss, averaged steps, balanced classes."""
    rng, n = np.random.default_rng(seed), len(y)
    x = np.concatenate([x, np.ones((n, 1), dtype=x.dtype)], axis=1)
    weight = np.where(y > 0, n / max(1, 2 * (y > 0).sum()), n / max(1, 2 * (y < 0).sum()))
    w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, 32):
            rows = order[i : i + 32]
            t += 1
            rate = 1 / (1 + reg * 100 * t)
            short = rows[y[rows] * (x[rows] @ w) < 1]
            w *= 1 - rate * reg
            if len(short):
                w += rate * (weight[short] * y[short]) @ x[short] / len(rows)
            if epoch >= epochs // 2:
                mean += w
    return (mean / max(1, t - t * (epochs // 2) // epochs)).astype(np.float32)


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    #: Rows of weights: one per family (none if there is only one), then one per pair of languages of a family.
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, SIZE + 1), dtype=np.float32))
    pairs: list[tuple[str, str]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        k = len(self.families) if len(self.families) > 1 else 0
        row_of = {p: k + i for i, p in enumerate(self.pairs)}
        out = []
        for m in margins:
            fam = self.families[int(m[:k].argmax())] if k else self.families[0]
            least = float(m[:k].max()) if k else 1.0
            names = self.members[fam]
            wins, total = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
            for a, b in combinations(names, 2):
                v = float(m[row_of[a, b]])
                wins[a if v >= 0 else b] += 1
                total[a] += v
                total[b] -= v
            best = max(names, key=lambda n: (wins[n], total[n], n))
            if len(names) > 1:
                least = min(least, total[best] / (len(names) - 1))
            share = wins[best] / (len(names) - 1) if len(names) > 1 else 1.0
            out.append((best, float(share / (1 + np.exp(-np.clip(least, -30, 30))))))
        return out


def train(x: np.ndarray, lang: list[str]) -> Model:
    names = sorted(set(lang))
    family = {n: FAMILY_OF.get(n.lower().split("-")[0], f"own:{n}") for n in names}
    families = sorted(set(family.values()))
    members = {f: [n for n in names if family[n] == f] for f in families}
    of, fam = np.array(lang), np.array([family[n] for n in lang])
    rows = [svm(x, np.where(fam == f, 1, -1)) for f in families] if len(families) > 1 else []
    pairs = [p for f in families for p in combinations(members[f], 2)]
    for a, b in pairs:
        use = (of == a) | (of == b)
        rows.append(svm(x[use], np.where(of[use] == a, 1, -1)))
    return Model(families, members, np.array(rows, dtype=np.float32).reshape(-1, SIZE + 1), pairs)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, per_language: int = 400, total: int = 4000) -> Model:
    """Fits on at most ``per_language`` doc_ids of each language, and about ``total`` of all of them (both are bounds).

    Every language is learnt, from one doc_id at least. Rows without doc_id teach nothing; of rows of one doc_id and
    language one does.
    """
    usable = ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    usable = docs.where(usable)
    rows = usable.select("lang", F.struct(F.xxhash64("doc_id", F.lit(11)).alias("r"), "doc_id").alias("k"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return Model()
    each = max(1, min(per_language, total // languages))
    # The least hashes of each language, by a bounded aggregate rather than a sort of all its rows.
    share = F.least(F.lit(1.0), F.lit(3.0 * each + 20) / F.col("n"))
    bound = share * F.lit(2.0**64) - F.lit(2.0**63)
    few = F.broadcast(counts) if languages <= 100_000 else counts  # a checked size
    some = rows.join(few, "lang").where(F.col("k.r").cast("double") <= bound).distinct()
    chosen = some.groupBy("lang").agg(F.slice(F.sort_array(F.collect_set("k")), 1, each).alias("k"))
    chosen = F.broadcast(chosen.select("lang", F.explode("k.doc_id").alias("doc_id")))  # about ``total`` rows

    def make(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([features(t.encode("utf-8", "replace")).astype(np.float16).tobytes() if _LETTER.search(t) else None for t in texts], pa.binary())]

    wanted = usable.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"])
    got = map_texts(wanted, ["lang", "doc_id"], make, "x binary", 64).where("x is not null")
    got = got.groupBy("lang", "doc_id").agg(F.min("x").alias("x")).collect()  # about ``total`` rows
    got.sort(key=lambda r: (r["lang"], r["doc_id"]))
    if not got:
        return Model()
    x = np.stack([np.frombuffer(r["x"], dtype=np.float16) for r in got]).astype(np.float32)
    return train(x, [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list[str | None]) -> list[pa.Array]:
        m, texts = sent.value, [t or "" for t in texts]
        lettered = np.array([bool(_LETTER.search(t)) for t in texts]) if m.families else np.zeros(len(texts), bool)
        found = [("und", 0.0)] * len(texts)
        use = np.flatnonzero(lettered)
        if len(use):
            x = np.stack([features(texts[j].encode("utf-8", "replace")) for j in use])
            for j, f in zip(use, m.predict(x), strict=True):
                found[j] = f
        return [pa.array([f for f, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_texts(rows, ["doc_id", "held_out"], make, "lang_pred string, score double")

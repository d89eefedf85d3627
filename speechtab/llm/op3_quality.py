"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Statistics are counted over whole texts. The trees are trained on the driver with a histogram method on a bounded
sample of labelled rows (``sample`` rows, those of least hash of doc_id), flattened into numpy node arrays and scored
for a whole batch at once. A split on a constrained feature is taken only where its leaf values keep the wanted order,
and the bounds of the values pass down to both sides, so the score never rises with that feature.

Null text has no words. A document fails the base rules with fewer than 50 words or with over half of its words in
repeated 3-word windows. Without labelled rows of both classes the trees are empty and only the base rules decide.
Every row is judged on its own, repeated ones alike; an empty table gives an empty one; columns are told apart by place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import map_texts, release

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_len", "symbols", "dup_lines", "repeated", "unique", "digits", "upper", "punct", "line_len"]
#: -1: the quality score must not rise with the feature.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeated": -1}


def repeat_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    n = Counter(grams)
    hit = np.zeros(len(words) + 3, dtype=bool)
    at = np.flatnonzero(np.fromiter((n[g] > 1 for g in grams), dtype=bool, count=len(grams)))
    for d in range(3):
        hit[at + d] = True
    return int(hit.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts (as ``COUNTS``) and the features (as ``FEATURES``) of one text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, chars = len(words), len(text)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    word_chars = chars - sum(map(text.count, SPACES))
    symbols, dup = sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))
    repeated = repeat_words(words)
    letters = np.frombuffer(raw, dtype=np.uint8)
    of = np.bincount(letters, minlength=256)
    w, b = max(n, 1), max(len(raw), 1)
    features = [
        float(np.log1p(n)), word_chars / w, symbols / w, dup / max(len(lines), 1), repeated / w, len(set(words)) / w,
        of[48:58].sum() / b, of[65:91].sum() / b, of[[33, 44, 46, 58, 59, 63]].sum() / b, float(np.log1p(n / max(len(lines), 1))),
    ]
    return [n, word_chars, symbols, dup, repeated], features


@dataclass
class Forest:
    """Trees as arrays; a leaf points to itself. ``roots`` are the node numbers of the trees' roots."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float = 0.0
    cut: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(go_left, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, keep: float = 0.995, least: int = 10) -> Forest:
    """Boosted trees for the log odds of y = 1. ``keep``: the share of good training rows that the cut must keep."""
    empty = np.zeros(0, dtype=np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Forest(empty, empty.astype(float), empty, empty, empty.astype(float), empty, 0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], axis=1)
    signs = [MONOTONE.get(f, 0) for f in FEATURES]
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin, nodes, roots, lam = np.full(len(y), base), [], [], 1.0
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)

        def grow(rows: np.ndarray, level: int, low: float, high: float, g=g, h=h) -> int:
            me = len(nodes)
            value = float(np.clip(g[rows].sum() / (h[rows].sum() + lam), low, high))
            nodes.append([0, 0.0, me, me, rate * value])
            best = None
            if level < depth and len(rows) >= 2 * least:
                for f, q in enumerate(cuts):
                    if not len(q):
                        continue
                    b = binned[rows, f]
                    gs, hs, ns = (np.bincount(b, w, minlength=len(q) + 1).cumsum()[:-1] for w in (g[rows], h[rows], None))
                    gr, hr = g[rows].sum() - gs, h[rows].sum() - hs
                    vl, vr = np.clip(gs / (hs + lam), low, high), np.clip(gr / (hr + lam), low, high)
                    gain = gs * vl - (hs + lam) * vl**2 / 2 + gr * vr - (hr + lam) * vr**2 / 2
                    ok = (ns >= least) & (len(rows) - ns >= least) & ((signs[f] == 0) | (signs[f] * (vr - vl) >= 0))
                    if ok.any() and (best is None or gain[ok].max() > best[0]):
                        i = int(np.flatnonzero(ok)[gain[ok].argmax()])
                        best = (float(gain[i]), f, i, float(vl[i]), float(vr[i]))
            own = g[rows].sum() * value - (h[rows].sum() + lam) * value**2 / 2
            if best and best[0] > own + 1e-6:
                _, f, i, vl, vr = best
                mid, go = (vl + vr) / 2, binned[rows, f] <= i
                bound = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[signs[f]]
                nodes[me][0], nodes[me][1] = f, float(cuts[f][i])
                nodes[me][2] = grow(rows[go], level + 1, *bound[0])
                nodes[me][3] = grow(rows[~go], level + 1, *bound[1])
            return me

        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        t = np.array(nodes)
        tree = Forest(t[:, 0].astype(np.int64), t[:, 1], t[:, 2].astype(np.int64), t[:, 3].astype(np.int64), t[:, 4], np.array(roots[-1:]), depth)
        margin = margin + tree.margin(x)
    tree.roots, tree.base = np.array(roots), base
    tree.cut = float(min(0.5, np.quantile(tree.score(x)[y == 1], 1 - keep)))
    return tree


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the features of every row."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        found = [statistics(t) for t in texts]
        counts = [pa.array([c[i] for c, _ in found], pa.int64()) for i in range(len(COUNTS))]
        return [*counts, pa.array([f for _, f in found], pa.list_(pa.float64()))]

    return map_texts(docs, ["doc_id"], make, ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Forest:
    """Trees from at most ``sample`` labelled doc_ids, those of least hash; of rows of one doc_id the least features count.

    A doc_id that is labelled twice has its least label. Rows without doc_id or without a label of 0 or 1 teach nothing.
    """
    chosen = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    one = measure(rows.select("doc_id", "text")).groupBy("doc_id").agg(F.min("features").alias("features"))
    got = one.join(F.broadcast(chosen), "doc_id").collect()  # at most ``sample`` rows
    got.sort(key=lambda r: r["doc_id"])
    x = np.array([r["features"] for r in got]).reshape(-1, len(FEATURES))
    return train(x, np.array([r["quality"] for r in got], dtype=float))


def verdicts(found: list[tuple[list[int], list[float]]], trees: Forest) -> tuple[np.ndarray, ...]:
    """Counts, base_failed, kept and score of measured texts."""
    c = np.array([c for c, _ in found], dtype=np.int64).reshape(-1, len(COUNTS))
    score = trees.score(np.array([f for _, f in found]).reshape(-1, len(FEATURES)))
    failed = (c[:, 0] < 50) | (100 * c[:, 4] > 50 * c[:, 0])
    return c, failed, ~failed & (score >= trees.cut), score


def judge(docs: DataFrame, forest: Forest, columns: list[str] | None = None) -> DataFrame:
    """The counts, base_failed, score and kept of every row, beside the input's ``columns`` (doc_id by default)."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def make(texts: list[str | None]) -> list[pa.Array]:
        c, failed, kept, score = verdicts([statistics(t) for t in texts], sent.value)
        return [*(pa.array(np.ascontiguousarray(x)) for x in c.T), *map(pa.array, (failed, score, kept))]

    fields = [*(f"{c} long" for c in COUNTS), "base_failed boolean, score double, kept boolean"]
    return map_texts(docs, columns or ["doc_id"], make, ", ".join(fields))


def keep(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    text = docs.columns.index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [statistics(t) for t in part.column(text).to_pylist()]
                yield part.filter(pa.array(verdicts(found, sent.value)[2]))
        release()

    return docs.mapInArrow(batches, docs.schema)

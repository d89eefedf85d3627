"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Fingerprints within
``radius`` bits of each other differ in at most ``radius // segments`` bits in one of the segments, so each distinct
fingerprint is filed under the Hamming ball of half that radius around each of its segments: two such balls meet
exactly where the segments are close enough. Rows are dealt by ball point, sorted, and each run of one point is
verified over the whole 64 bits; a run gives the edges of a spanning forest of its links, never all pairs. A run longer
than ``run_limit`` is not searched in one task: its fingerprints are linked through the full 64-bit balls of half the
radius instead, a star per common point, which finds exactly the same links. Components follow from the edges.

Null and word-less texts have fingerprint zero, which links like any other; repeated rows and doc_ids are rows of their
own; component ids are the least doc_id reached (a null doc_id never is, unless no other is there). Copies share a
fingerprint and are joined to it at the end, so they cost no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import map_texts, materialize, partitions, release
from speechtab.llm.graph import components

SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of the whole sequence if there are fewer words; none of no words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, SEED) for g in grams], dtype="<u8")


def majority(hashes: np.ndarray) -> np.uint64:
    """The SimHash of some hashes: the bits that more than half of them have."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of very long texts
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0] if len(hashes) else np.uint64(0)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned fingerprint of one text."""
    return int(majority(shingle_hashes(text, shingle)))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (signed long) of every row of ``docs`` (doc_id, text)."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))]

    return map_texts(docs, ["doc_id"], make, "fp long")


def ball_masks(bits: int, radius: int, shift: int = 0) -> list[int]:
    """Masks of at most ``radius`` of ``bits`` bits from ``shift`` on, as signed longs."""
    out = [sum(1 << (shift + b) for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def _probe(segment: int, part: Column, low: int) -> Callable[[Column], Column]:
    return lambda m: F.shiftrightunsigned(part.bitwiseXOR(m), low).bitwiseOR(F.lit(segment << 32))


def _points(fps: DataFrame, words: list[str], segments: int, reach: int) -> DataFrame:
    """The rows of ``fps`` once per segment and point of the ball around it; key has both (the segment from bit 32 on)."""
    width = 64 // segments
    edges = [width * i for i in range(segments)] + [64]
    probes = []
    for i, w in enumerate(words):
        for s, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
            keep = sum(1 << b for b in range(low, high))
            part = F.col(w).bitwiseAND(F.lit(keep - (1 << 64) if keep >= 1 << 63 else keep))
            masks = F.array(*map(F.lit, ball_masks(high - low, reach, low)))
            probes.append(F.transform(masks, _probe(i * segments + s, part, low)))
    return fps.select("*", F.explode(F.concat(*probes)).alias("key"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def _forest(group: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (places in the run) of a spanning forest of the links within one run; none between rows of one group."""
    left, out = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = distances(fps[left], fps[x]) <= radius
            if near.any():
                found = left[near]
                new = found[group[found] != group[x]]
                out.append((np.full(len(new), x), new))
                queue.extend(found)
                left = left[~near]
    return out


def run_edges(keys: np.ndarray, group: np.ndarray, fps: np.ndarray, radius: int, run_limit: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (places of two rows) within the runs of equal keys, and the places of rows in runs over ``run_limit``.

    Rows of one group count as linked already and get no edges.
    """
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[cut, len(keys)])
    place = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 16), sizes))
    k, f, g = keys[place], fps[place], group[place]
    out = []
    for d in range(1, min(16, len(k))):
        same = np.flatnonzero((k[d:] == k[:-d]) & (g[d:] != g[:-d]))
        near = same[distances(f[same + d], f[same]) <= radius]
        out.append((place[near], place[near + d]))
    over = []
    for i in np.flatnonzero(sizes > 16):
        run = slice(cut[i], cut[i] + sizes[i])
        if run_limit is not None and sizes[i] > run_limit:
            over.append(np.arange(run.start, run.stop))
        else:
            out += [(a + cut[i], b + cut[i]) for a, b in _forest(group[run], fps[run], radius)]
    none = np.zeros(0, dtype=np.int64)
    pick = lambda j: np.concatenate([x[j] for x in out]) if out else none
    return pick(0), pick(1), np.concatenate(over) if over else none


def _searched(points: DataFrame, node: str, words: list[str], radius: int, run_limit: int | None) -> DataFrame:
    """u, v, over: the edges between ``node`` values of each run; where ``over``, u is of a run too long to search."""

    def search(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []

        def close(rows: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
            k, g, f = (np.concatenate(x) for x in zip(*rows, strict=True))
            a, b, over = run_edges(k, g, f, radius, run_limit)
            out = pd.DataFrame({"u": g[np.r_[a, over]], "v": g[np.r_[b, over]], "over": np.r_[np.zeros(len(a), bool), np.ones(len(over), bool)]})
            return out.drop_duplicates()

        for pdf in it:
            if not len(pdf):
                continue
            k, g = pdf["key"].to_numpy(np.int64), pdf[node].to_numpy(np.int64)
            f = np.ascontiguousarray(pdf[words].to_numpy(np.int64)).view(np.uint64)
            whole = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0  # what stands before the last run
            if held and (whole or k[0] != held[-1][0][-1]):
                if whole:
                    held.append((k[:whole], g[:whole], f[:whole]))
                yield close(held)
                held = []
            elif whole:
                yield close([(k[:whole], g[:whole], f[:whole])])
            held.append((k[whole:], g[whole:], f[whole:]))
        if held:
            yield close(held)
        release()

    dealt = points.repartition(partitions(points.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInPandas(search, "u long, v long, over boolean")


def links(fps: DataFrame, radius: int = 4, segments: int = 2, run_limit: int = 100_000) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints of ``fps`` (distinct, fp) linked by chains of near ones."""
    if radius % 2 or radius // segments % 2:
        raise ValueError("radius and radius // segments must be even, so that balls of half of it meet exactly")
    points = _points(fps.select("fp"), ["fp"], segments, radius // segments // 2)
    found = materialize(_searched(points, "fp", ["fp"], radius, run_limit), "links")
    over = found.where("over").select(F.col("u").alias("fp")).distinct()
    edges = found.where("not over").select("u", "v")
    if over.isEmpty():
        return edges
    full = over.select("fp", F.explode(F.array(*map(F.lit, ball_masks(64, radius // 2)))).alias("m"))
    full = full.select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
    star = full.groupBy("point").agg(F.min("fp").alias("v"))
    return edges.union(full.join(star, "point").where("fp <> v").select(F.col("fp").alias("u"), "v"))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, segments: int = 2, run_limit: int = 100_000) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs`` (doc_id, text)."""
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(fps.select("fp"), radius, segments, run_limit))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")

"""Removal of bytes repeated from earlier documents, by difference-cover blockwise suffix sorting.

A byte goes if a string of ``size`` bytes covers it that also starts in a document of smaller doc_id. Documents are
written once to block files in the shared folder; later stages are keyed by block and read those files, so no text is
shuffled. The work on suffixes is cut down, and dealt out, without loss:

1. Of texts that are equal as a whole only the one of least doc_id is searched; the others go entirely (if they have
   ``size`` bytes).
2. Each window of ``size`` bytes has an anchor: its ``GRAM``-byte substring of least hash. Equal windows have equal
   anchors, and consecutive windows mostly share theirs. Anchor hashes meet in hash buckets, which send back one bit
   each: whether another document may have it. Windows of other anchors are unique.
3. The stretches of bytes around the remaining anchors go to suffix buckets by anchor hash; within a block, equal
   stretches are sent once, from the least document, and the others are known to go. So a passage that many documents
   share costs at most one stretch per block.
4. Each bucket's suffixes are sorted one block of leading bytes at a time: by their first ``PERIOD`` bytes, then, where
   these tie, by ranks of the difference-cover sample (the suffixes that start at positions in the cover, modulo the
   period), which prefix doubling made before. Any two residues have a distance at which both suffixes meet the sample,
   and the ranks there decide between them; ties are split in three by a member of each until none is left.
   Neighbours in the sorted order that share ``size`` bytes form a class; members of documents beyond the class's
   least go.

Memory is bounded by the sizes of block files and buckets, both parameters. Null text counts as empty; a null doc_id
is neither smaller nor larger than any, so its document loses nothing and takes nothing; rows of equal doc_id do not
remove from each other. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import file_system, make_folder, materialize, new_path, release

SIZE = 50
GRAM = 24
PERIOD = 32
#: Window starts, or stretches, that are worked on at once.
CHUNK = 1 << 19
#: Stretches of a suffix bucket that are sorted together.
PART = 1 << 16
NONE = np.iinfo(np.int64).max


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A small set of residues whose differences are all residues, found greedily."""
    cover, missing = [0, 1], set(range(period)) - {0, 1, period - 1}
    while missing:
        best = max(range(period), key=lambda c: (len(({(c - x) % period for x in cover} | {(x - c) % period for x in cover}) & missing), -c))
        cover.append(best)
        missing -= {(best - x) % period for x in cover} | {(x - best) % period for x in cover}
    return tuple(sorted(cover))


# Block files


def write_block(path: str, ids: np.ndarray, stops: np.ndarray, raw: bytes) -> None:
    body = zstandard.ZstdCompressor(level=1).compress(raw)
    store, name = file_system(path)
    with store.open_output_stream(name) as f:
        f.write(struct.pack("<3Q", len(ids), len(raw), len(body)) + ids.astype("<i8").tobytes() + stops.astype("<i8").tobytes() + body)


def read_block(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids (NONE for null), the ends of the documents, and all bytes, of one block in ascending doc_id order."""
    store, name = file_system(path)
    with store.open_input_stream(name) as f:
        data = f.read()
    n, size, _ = struct.unpack_from("<3Q", data)
    ids = np.frombuffer(data, dtype="<i8", count=n, offset=24)
    stops = np.frombuffer(data, dtype="<i8", count=n, offset=24 + 8 * n)
    raw = zstandard.ZstdDecompressor().decompress(data[24 + 16 * n :], max_output_size=max(size, 1)) if size else b""
    return ids, stops, np.frombuffer(raw, dtype=np.uint8)


def write_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Writes block files and returns path, ord, doc_id, n_bytes, sha of every row."""
    folder = new_path(docs.sparkSession, "blocks")
    make_folder(docs.sparkSession, folder)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            held.sort(key=lambda x: x[0])
            path = f"{folder}/{uuid.uuid4().hex}"
            ids, sizes = np.array([i for i, _ in held], dtype=np.int64), np.array([len(t) for _, t in held], dtype=np.int64)
            write_block(path, ids, sizes.cumsum(), b"".join(t for _, t in held))
            out = [
                pa.array([path] * len(held)), pa.array(range(len(held)), pa.int32()), pa.array(ids, mask=ids == NONE),
                pa.array(sizes), pa.array([hashlib.sha256(t).digest() for _, t in held], pa.binary()),
            ]
            held, size = [], 0
            return pa.RecordBatch.from_arrays(out, names=["path", "ord", "doc_id", "n_bytes", "sha"])

        for batch in it:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = (t or "").encode("utf-8", "replace")
                    held.append((NONE if d is None else d, raw))
                    size += len(raw)
                    if size >= block_bytes:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select("doc_id", "text").mapInArrow(batches, "path string, ord int, doc_id long, n_bytes long, sha binary")
    return materialize(rows, "rows")


# Anchors


def _words(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a number; the text is padded with zeros."""
    n = len(raw)
    pad = np.zeros(n + 16 - n % 8, dtype=np.uint8)
    pad[:n] = raw
    out = np.empty(len(pad) - 8, dtype=np.uint64)
    for o in range(8):
        part = pad[o : o + (len(pad) - o) // 8 * 8].view("<u8")
        out[o::8] = part[: len(out[o::8])]
    return out[:n]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    w = _words(raw)
    n = len(raw) - GRAM + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for at, mul in ((8, 0xBF58476D1CE4E5B9), (16, 0x94D049BB133111EB)):
        h += w[at : at + n]
        h *= np.uint64(mul)
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(raw: np.ndarray, stops: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each run of windows that share their anchor: first window, last window, anchor, document, anchor's hash.

    Windows start within the documents marked in ``use`` and end within the same document.
    """
    parts = []
    for low in range(0, len(raw) - SIZE + 1, CHUNK):
        sub = raw[low : low + CHUNK + SIZE - 1]
        h = gram_hashes(sub)
        # The leading half of the hash, then the place: the same order in every block, so that equal windows choose alike.
        half = np.uint64(32)
        least = (h >> half << half) | np.arange(len(h), dtype=np.uint64)
        span, reach, n = SIZE - GRAM + 1, 1, len(sub) - SIZE + 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        least = np.minimum(least[:n], least[span - reach : span - reach + n])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.arange(low, low + n)
        doc = np.searchsorted(stops, first, side="right")
        ok = np.flatnonzero(use[doc] & (first + SIZE <= stops[doc]))
        if not len(ok):
            continue
        first, doc, at = first[ok], doc[ok], at[ok]
        cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + 1)])
        end = np.r_[cut[1:], len(at)] - 1
        # Least hashes are small; mixed once more they spread over the buckets.
        spread = h[at[cut]] * np.uint64(0xC2B2AE3D27D4EB4F)
        spread = (spread ^ (spread >> half)) * np.uint64(0x9FB21C651E98DF25)
        parts.append((first[cut], first[end], at[cut] + low, doc[cut], spread ^ (spread >> half)))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _split(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets (by leading bits) within sorted hashes."""
    b = buckets.bit_length() - 1
    edge = np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - b) if b else np.zeros(0, dtype=np.uint64)
    return np.r_[0, np.searchsorted(values, edge), len(values)]


def _rest(values: np.ndarray, buckets: int) -> np.ndarray:
    """The 32 bits behind those that tell the bucket."""
    return (values >> np.uint64(32 - (buckets.bit_length() - 1))).astype(np.uint32)


def distinct_anchors(path: str, skip: np.ndarray) -> tuple:
    ids, stops, raw = read_block(path)
    use = ids != NONE
    use[skip] = False
    first, last, a, doc, h = anchors(raw, stops, use)
    u, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
    return ids, raw, stops, first, last, a, doc, h, u, inverse, n


#: By the number of bytes wanted: the bits of a little-endian word that hold them.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def equal_stretches(first: np.ndarray, before: np.ndarray, count: np.ndarray, doc: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal stretches together, those of the least document first, and each one's class's first.

    Equal means the same bytes around an anchor at the same place.
    """
    if not len(first):
        return first, first
    words, sizes = _words(raw), count + SIZE - 1
    w = np.empty((-(-int(sizes.max()) // 8) + 1, len(first)), dtype=np.uint64)
    w[0] = before * 256 + count
    for i in range(1, len(w)):
        at = 8 * (i - 1)
        w[i] = words[np.minimum(first + at, len(words) - 1)] & LOW_BYTES[np.clip(sizes - at, 0, 8)]
    del words
    mix = np.zeros(len(first), dtype=np.uint64)
    for x in w:
        mix = (mix ^ x) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(32)
    order = np.lexsort((doc, mix))
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for x in (mix, *w):
        y = x[order]
        new[1:] |= y[1:] != y[:-1]
    return order, order[np.flatnonzero(new)][np.cumsum(new) - 1]


# Suffix buckets


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows by the keys, the first one leading."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def sample_ranks(text: np.ndarray, words: np.ndarray, depth: int, period: int = PERIOD) -> np.ndarray:
    """Ranks (from 1) of the difference-cover sample's suffixes by their first ``depth`` bytes, at their positions."""
    cover = np.array(difference_cover(period))
    at = np.flatnonzero(np.isin(np.arange(period), cover))
    pos = (np.arange(0, len(text), period)[:, None] + at).ravel()
    pos = pos[pos < len(text)]
    be = lambda o: words[np.minimum(pos + o, len(words) - 1)]
    rank = np.zeros(len(text) + depth + period, dtype=np.int32)
    rank[pos] = 1 + _ranks([be(8 * i) for i in range(period // 8)])
    reached = period
    while reached < depth:  # prefix doubling: a sample position plus a multiple of the period is one too
        rank[pos] = 1 + _ranks([rank[pos], rank[pos + reached]])
        reached *= 2
    return rank


@lru_cache
def common_distances(period: int) -> np.ndarray:
    """By two residues: the least distance behind them at which both are in the cover."""
    inside = np.zeros(period, dtype=bool)
    inside[list(difference_cover(period))] = True
    behind = inside[(np.arange(period)[:, None] + np.arange(period)) % period]  # residue, distance
    return np.argmax(behind[:, None, :] & behind[None, :, :], axis=2).astype(np.int32)


def resolve_ties(p: np.ndarray, new: np.ndarray, rank: np.ndarray, period: int) -> np.ndarray:
    """Sorts the suffixes ``p`` within their ties (runs that begin where ``new``) by the sample's ranks."""
    common, rng = common_distances(period), np.random.default_rng(0)
    p = p.copy()
    tie = np.cumsum(new)
    open_ = np.flatnonzero(np.bincount(tie)[tie] > 1)
    tie = tie[open_]
    while len(open_):
        head = np.flatnonzero(np.r_[True, tie[1:] != tie[:-1]])
        n = np.diff(np.r_[head, len(open_)])
        x = p[open_]
        pivot = np.repeat(x[head + rng.integers(0, n)], n)
        d = common[x % period, pivot % period]
        side = np.sign(rank[x + d] - rank[pivot + d])
        part = np.repeat(np.arange(len(n)) * 3, n) + side + 1
        o = np.argsort(part, kind="stable")
        p[open_] = x[o]
        part, side = part[o], side[o]
        more = (side != 0) & (np.bincount(part)[part] > 1)
        open_, tie = open_[more], part[more]
    return p


def sorted_suffixes(text: np.ndarray, suffixes: np.ndarray, size: int = SIZE, period: int = PERIOD, block: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields the ``suffixes`` (positions) sorted, a block at a time, and whether each shares ``size`` bytes with the one before.

    The order is right over two periods' bytes at least.
    """
    words = _words(text).byteswap()  # big-endian, so that numbers compare as strings do
    words = np.r_[words, np.zeros(size + period + 8, dtype=np.uint64)]
    rank = sample_ranks(text, words, 2 * period, period)
    lead = (words[suffixes] >> np.uint64(40)).astype(np.int64)
    order = np.argsort(lead, kind="stable")
    lead = lead[order]
    low = 0
    while low < len(order):
        high = min(low + block, len(order))
        if high < len(order):  # a block ends where the leading bytes change
            end = np.searchsorted(lead, lead[high - 1], side="left")
            high = int(end) if end > low else int(np.searchsorted(lead, lead[high - 1], side="right"))
        p = suffixes[order[low:high]]
        keys = [words[p + 8 * i] for i in range(period // 8)]
        o = np.lexsort(keys[::-1])
        p = p[o]
        new = np.ones(len(p), dtype=bool)
        new[1:] = False
        for k in keys:
            new[1:] |= k[o[1:]] != k[o[:-1]]
        p = resolve_ties(p, new, rank, period)
        same = ~new
        tied = np.flatnonzero(same)
        for at in [*range(period, size - 7, 8), size - 8]:
            same[tied] &= words[p[tied] + at] == words[p[tied - 1] + at]
        yield p, same
        low = high


def repeated_windows(doc: np.ndarray, before: np.ndarray, count: np.ndarray, offset: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows to remove: stretch, first window, last window (both counted within the stretch).

    A stretch is of document ``doc``, has ``before`` bytes before its anchor and ``count`` windows; its bytes start at
    ``offset`` of ``raw``.
    """
    n = len(doc)
    left = SIZE - GRAM  # the most bytes that a stretch has before its anchor
    lead = -(-left // PERIOD) * PERIOD
    width = lead + -(-(SIZE) // PERIOD) * PERIOD
    text = np.zeros(n * width, dtype=np.uint8)
    sizes = count + SIZE - 1
    row = np.repeat(np.arange(n), sizes)
    within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text[row * width + lead - before[row] + within] = raw[offset[row] + within]
    row = np.repeat(np.arange(n), count)
    within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    suffixes = row * width + lead - before[row] + within
    gone = np.zeros(len(suffixes), dtype=bool)
    back = np.full(len(text), -1, dtype=np.int32)
    back[suffixes] = np.arange(len(suffixes), dtype=np.int32)
    for p, same in sorted_suffixes(text, suffixes):
        i = back[p]
        group = np.cumsum(~same) - 1
        d = doc[row[i]]
        least = np.minimum.reduceat(d, np.flatnonzero(~same))
        gone[i] = d > least[group]
    hit = np.flatnonzero(gone)
    if not len(hit):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    cut = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])])
    end = np.r_[cut[1:], len(hit)] - 1
    return row[hit[cut]], within[hit[cut]], within[hit[end]]


def _met(order: np.ndarray, mix: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of ``order``, which is by ``mix``, what has a ``mix`` that two documents have."""
    if not len(order):
        return order
    m, d = mix[order], doc[order]
    head = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
    lone = np.minimum.reduceat(d, head) == np.maximum.reduceat(d, head)
    return order[np.repeat(~lone, np.diff(np.r_[head, len(order)]))]


def repeated_in_parts(doc: np.ndarray, before: np.ndarray, count: np.ndarray, offset: np.ndarray, raw: np.ndarray, most: int = PART) -> tuple[np.ndarray, ...]:
    """``repeated_windows`` over parts of at most ``most`` stretches, unless one anchor has more; anchors stay whole.

    Of equal stretches only the least document's are searched: the others go at once.
    """
    words = _words(raw)
    at = offset + before
    mix = np.zeros(len(at), dtype=np.uint64)
    for i in range(0, GRAM, 8):
        mix = (mix ^ words[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(32)
    del words
    # An anchor that stands in one document only has nothing to remove.
    order = _met(np.argsort(mix, kind="stable"), mix, doc)
    equal, head = equal_stretches(offset[order], before[order], count[order], doc[order], raw)
    later = doc[order[equal]] > doc[order[head]]
    whole = order[equal[later]]
    stay = np.ones(len(order), dtype=bool)
    stay[equal[later]] = False
    order = _met(order[stay], mix, doc)
    mix = mix[order]
    low, out = 0, [(whole, np.zeros_like(whole), count[whole] - 1)]
    while low < len(order):
        high = min(low + most, len(order))
        if high < len(order):  # a part ends where the anchor changes
            end = int(np.searchsorted(mix, mix[high - 1], side="left"))
            high = end if end > low else int(np.searchsorted(mix, mix[high - 1], side="right"))
        p = order[low:high]
        s, a, b = repeated_windows(doc[p], before[p], count[p], offset[p], raw)
        out.append((p[s], a, b))
        low = high
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# Stages


def _pack(*arrays: np.ndarray) -> bytes:
    body = b"".join(struct.pack("<Q", a.nbytes) + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    body, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    for t in types:
        (n,) = struct.unpack_from("<Q", body, at)
        out.append(np.frombuffer(body, dtype=t, count=n // np.dtype(t).itemsize, offset=at + 8))
        at += 8 + n
    return out


def remove_repeats(docs: DataFrame, block_bytes: int = 8 << 20, bucket_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    rows = write_blocks(docs, block_bytes)
    total = rows.agg(F.sum("n_bytes"), F.count_distinct("path")).first()
    buckets = 1 << max(2, math.ceil(math.log2(max(1, (total[0] or 0) // bucket_bytes))))
    tasks = max(1, total[1])

    # Texts equal as a whole: all but those of the least doc_id are left out of the search, and go.
    known = rows.where(F.col("doc_id").isNotNull())
    first = known.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = known.join(first, "sha").where("doc_id > least").groupBy("path").agg(F.collect_list("ord").alias("skip"))
    plan = rows.select("path").distinct().join(copies, "path", "left")
    empty = F.array().cast("array<int>")
    plan = materialize(plan.select("path", F.coalesce("skip", empty).alias("skip")), "plan")

    def hashes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, skip in zip(pdf["path"], pdf["skip"], strict=True):
                *_, u, _, _ = distinct_anchors(path, np.array(skip, dtype=np.int64))
                at = _split(u, buckets)
                rest = _rest(u, buckets)
                some = [b for b in range(buckets) if at[b] < at[b + 1]]
                yield pd.DataFrame({"path": path, "bucket": some, "x": [rest[at[b] : at[b + 1]].tobytes() for b in some]})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, dtype=np.uint32) for x in pdf["x"]]
        every = np.concatenate(parts)
        s = np.sort(every)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        where = np.searchsorted(twice, every)
        hit = (where < len(twice)) & (twice[np.minimum(where, len(twice) - 1)] == every) if len(twice) else np.zeros(len(every), bool)
        bits = [np.packbits(h).tobytes() for h in np.split(hit, np.cumsum([len(p) for p in parts])[:-1])]
        return pd.DataFrame({"path": pdf["path"], "bucket": pdf["bucket"], "bits": bits})

    blocks = plan.repartition(tasks, "path")
    sent = blocks.mapInPandas(hashes, "path string, bucket int, x binary").repartition(buckets, "bucket")
    shared = sent.groupBy("bucket").applyInPandas(meet, "path string, bucket int, bits binary")
    bits = shared.groupBy("path").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))

    def stretches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, skip, found in zip(pdf["path"], pdf["skip"], pdf["bits"], strict=True):
                ids, raw, stops, first, last, a, doc, h, u, inverse, n = distinct_anchors(path, np.array(skip, dtype=np.int64))
                at = _split(u, buckets)
                hit = n > 1
                for r in found if found is not None else []:
                    low, high = at[r["bucket"]], at[r["bucket"] + 1]
                    hit[low:high] |= np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), count=high - low).astype(bool)
                use = np.flatnonzero(hit[inverse])
                if not len(use):
                    continue
                first, last, a, doc, h = first[use], last[use], a[use], doc[use], h[use]
                starts = np.r_[0, stops[:-1]]
                before, count = a - first, last - first + 1
                # Equal stretches of the block: the least document's stay, the others go at once.
                order, head = equal_stretches(first, before, count, ids[doc], raw)
                later = ids[doc[order]] > ids[doc[head]]
                gone, stay = order[later], order[~later]
                lo = first - starts[doc]
                if len(gone):
                    yield pd.DataFrame({"path": [path], "bucket": [-1], "x": [_pack(doc[gone].astype("<u4"), lo[gone].astype("<u4"), (lo[gone] + count[gone] - 1 + SIZE).astype("<u4"))]})
                stay = stay[np.argsort(h[stay], kind="stable")]
                edge = _split(h[stay], buckets)
                for b in np.flatnonzero(np.diff(edge)):
                    s = stay[edge[b] : edge[b + 1]]
                    sizes = count[s] + SIZE - 1
                    idx = np.repeat(first[s] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                    body = _pack(ids[doc[s]].astype("<i8"), doc[s].astype("<u4"), lo[s].astype("<u4"), before[s].astype("u1"), count[s].astype("u1"), raw[idx])
                    yield pd.DataFrame({"path": [path], "bucket": [int(b)], "x": [body]})

    ready = plan.join(bits, "path", "left").repartition(tasks, "path")
    ready = materialize(ready.mapInPandas(stretches, "path string, bucket int, x binary"), "stretches")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x, "<i8", "<u4", "<u4", "u1", "u1", "u1") for x in pdf["x"]]
        of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        ids, doc, lo, before, count, raw = (np.concatenate([p[i] for p in parts]) for i in range(6))
        before, count = before.astype(np.int64), count.astype(np.int64)
        sizes = count + SIZE - 1
        s, a, b = repeated_in_parts(ids, before, count, np.cumsum(sizes) - sizes, raw)
        out = []
        for k in np.unique(of[s]):
            m = of[s] == k
            i = s[m]
            out.append((pdf["path"].iloc[k], _pack(doc[i], (lo[i] + a[m]).astype("<u4"), (lo[i] + b[m] + SIZE).astype("<u4"))))
        release()
        return pd.DataFrame(out, columns=["path", "x"])

    found = ready.where("bucket >= 0").repartition(buckets, "bucket").groupBy("bucket").applyInPandas(search, "path string, x binary")
    cuts = found.union(ready.where("bucket < 0").select("path", "x")).groupBy("path").agg(F.collect_list("x").alias("cuts"))

    def finish(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, gone, found in zip(pdf["path"], pdf["skip"], pdf["cuts"], strict=True):
                ids, stops, raw = read_block(path)
                starts = np.r_[0, stops[:-1]]
                turn = np.zeros(len(raw) + 1, dtype=np.int32)
                for x in found if found is not None else []:
                    d, lo, hi = (y.astype(np.int64) for y in _unpack(x, "<u4", "<u4", "<u4"))
                    np.add.at(turn, starts[d] + lo, 1)
                    np.add.at(turn, starts[d] + hi, -1)
                out = np.cumsum(turn[:-1]) > 0
                for i in gone:
                    if stops[i] - starts[i] >= SIZE:
                        out[starts[i] : stops[i]] = True
                rows = []
                for i in range(len(ids)):
                    part, o = raw[starts[i] : stops[i]], out[starts[i] : stops[i]]
                    n = int(o.sum())
                    spans = int((o[1:] & ~o[:-1]).sum()) + int(o[0]) if n else 0
                    kept = part[~o].tobytes() if n else part.tobytes()
                    rows.append((len(part), n, spans, hashlib.sha256(kept).hexdigest(), kept))
                got = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
                got.insert(0, "doc_id", pd.arrays.IntegerArray(np.array(ids), ids == NONE))
                yield got

    last = plan.join(cuts, "path", "left").repartition(tasks, "path")
    return last.mapInPandas(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

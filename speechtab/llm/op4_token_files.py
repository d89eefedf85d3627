"""Token ids in binary files of patched frame-of-reference blocks.

Documents are range-partitioned by doc_id, encoded and written, one or more files per task, in ascending order. A file:

    magic  8 bytes   b"STPFOR1\\n"
    header 4 x u64   documents, ids, blocks, bytes of the blocks
    docs   n x (i64 doc_id, u64 ids, u8 flags)   flag 1: doc_id is null
    index  (blocks + 1) x u64   where each block starts, from the first block on
    blocks

A block holds 128 ids (the last one fewer, padded with its minimum): u32 minimum, u8 width, u8 number of exceptions,
``width`` planes of 128 bits (bit b of each id less the minimum), then a u8 position and a u32 of high bits per exception.
The width is the bit length that ``share`` of the block's ids stay within; longer ones are exceptions.

Files are written under names of their attempt and count only where the manifest names them, so a lost task's leavings
are never read. Reading needs the manifest (path, order, number of ids), whose running sum gives each file's first
position.

Null text counts as empty (one end id); null doc_ids come first; rows of equal doc_id are ordered by a hash of the text.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechtab.llm.common import file_system, make_folder, materialize, new_path, release

MAGIC = b"STPFOR1\n"
BLOCK = 128
DOC = np.dtype([("id", "<i8"), ("n", "<u8"), ("flags", "u1")])
#: A space beside white space, or white space but the space and the line feed (RE2). Any other space stands between two
#: characters that are no white space, or at an end of the text; it starts a pre-token, so the text can be cut before it.
_ODD = (
    r"  | \n|\n |[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


class Encoder:
    """The tokenizer, with the ids of space-separated chunks kept (of the ``room`` first ones of a worker).

    A chunk of letters and one closing mark has the ids of the letters and those of the mark, which is a pre-token of
    its own. New chunks are encoded in one call, joined by the spaces that start them, and told apart again by the
    lengths of the tokens.
    """

    MARKS = ".,;:!?|"

    def __init__(self, path: str, room: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # A byte-level vocabulary has one character per byte.
        size = self.tokenizer.get_vocab_size()
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.room, self.known = room, {}
        self.marks = {m: self._one(m) for m in self.MARKS}

    @classmethod
    @lru_cache(maxsize=1)
    def load(cls, path: str) -> Encoder:
        return cls(path)

    def _one(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _encode_new(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of chunks, each with a space before it."""
        plain = [c for c in chunks if c and not (c[0].isspace() or c[-1].isspace())]
        out = {c: self._one(" " + c) for c in chunks if not c or c[0].isspace() or c[-1].isspace()}
        for i in range(0, len(plain), 4096):
            some = plain[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.cumsum([1 + len(c.encode()) for c in some])
            stop = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            raw, low = ids.tobytes(), 0
            for c, k in zip(some, (4 * stop).tolist(), strict=True):
                out[c] = raw[low:k]
                low = k
        return out

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        known, marks = self.known, self.marks
        ended = {c: c[:-1] for c in chunks if c[-1:] in marks and c[:-1].isalpha()} if chunks else {}
        new = {s for s in ended.values() if s not in known} | {c for c in chunks if c not in ended}
        out = self._encode_new(list(new))
        if len(known) < self.room:  # only what was encoded is kept; marks are put to it again
            known.update((c, v) for c, v in out.items() if len(c) <= 32)
        for c, s in ended.items():
            out[c] = (known.get(s) or out[s]) + marks[c[-1]]
        return out

    def encode(self, texts: pa.StringArray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls), one after the other, and the number of each text's; each with ``end_id`` behind."""
        odd = pc.match_substring_regex(texts, _ODD)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        odd_ids = self.tokenizer.encode_batch_fast([texts[int(i)].as_py() for i in whole], add_special_tokens=False)
        words = pc.split_pattern(pc.if_else(odd, "", texts) if len(whole) else texts, " ")
        first = words.offsets.to_numpy()[:-1].astype(np.int64)
        first -= words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        unique, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().copy()
        ids = list(map(self.known.get, unique))
        missing = [i for i, x in enumerate(ids) if x is None]
        fresh = self._learn({unique[i] for i in missing})
        for i in missing:
            ids[i] = fresh[unique[i]]
        # The first chunk of a text has no space before it; a text that can't be cut is one chunk.
        heads = self.tokenizer.encode_batch_fast([unique[i] for i in at[first]], add_special_tokens=False)
        head_ids = [array("I", e.ids).tobytes() for e in heads]
        for i, e in zip(whole, odd_ids, strict=True):
            head_ids[i] = array("I", e.ids).tobytes()
        at[first] = len(ids) + np.arange(len(first), dtype=np.int32)
        ids += head_ids
        size = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids) + bytes(4), dtype="<u4"), np.cumsum(size, dtype=np.int32) - size
        n = size[at]
        last = np.r_[first[1:], len(n)] - 1
        if end_id is not None:  # a place more behind each text's last chunk, filled below
            n[last] += 1
        stop = np.cumsum(n, dtype=np.int32)
        pos = np.repeat(start[at] - (stop - n), n)
        pos += np.arange(len(pos), dtype=np.int32)
        out = flat[pos]
        if end_id is not None:
            out[stop[last] - 1] = end_id
        return out, np.diff(np.r_[0, stop[last]]).astype(np.int64)


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


_SHORT = bit_lengths(np.arange(1 << 16))


def pack(ids: np.ndarray, share: float = 0.9) -> tuple[bytes, np.ndarray]:
    """The blocks' bytes and their starts (one more than blocks)."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(1, dtype="<u8")
    x = np.full(n * BLOCK, ids[(n - 1) * BLOCK :].min(), dtype=np.uint32)
    x[: len(ids)] = ids
    x = x.reshape(n, BLOCK)
    least = x.min(axis=1)
    rest = x - least[:, None]
    short = rest.max() < 1 << 16
    width_of = _SHORT[rest] if short else bit_lengths(rest)
    at_share = int(np.ceil(share * BLOCK)) - 1
    width = np.partition(width_of, at_share, axis=1)[:, at_share]
    late = width_of > width[:, None]
    extra = late.sum(axis=1)
    sizes = 6 + BLOCK // 8 * width.astype(np.int64) + 5 * extra
    starts = np.zeros(n + 1, dtype="<u8")
    np.cumsum(sizes, out=starts[1:])
    out = np.zeros(int(starts[-1]), dtype=np.uint8)
    at = starts[:-1].astype(np.int64)
    head = np.concatenate([least.astype("<u4").view(np.uint8).reshape(n, 4), width[:, None], extra.astype(np.uint8)[:, None]], axis=1)
    out[at[:, None] + np.arange(6)] = head
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        some = rest[rows].astype(np.uint16) if short else rest[rows]
        for b in range(int(w)):
            plane = np.packbits(((some >> b) & 1).astype(np.uint8), axis=1, bitorder="little")
            out[at[rows][:, None] + 6 + BLOCK // 8 * b + np.arange(BLOCK // 8)] = plane
    row, pos = np.nonzero(late)
    if len(row):
        rank = np.arange(len(row)) - np.repeat(np.cumsum(extra) - extra, extra)
        to = at[row] + 6 + BLOCK // 8 * width[row].astype(np.int64)
        out[to + rank] = pos
        high = (rest[row, pos] >> width[row]).astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(to + extra[row] + 4 * rank)[:, None] + np.arange(4)] = high
    return out.tobytes(), starts


def unpack(blocks: bytes, starts: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of consecutive whole blocks; ``starts`` are relative to ``blocks``."""
    raw, at = np.frombuffer(blocks, dtype=np.uint8), starts[:-1].astype(np.int64)
    n = len(at)
    if not n:
        return np.zeros(0, dtype="<u4")
    least = np.ascontiguousarray(raw[at[:, None] + np.arange(4)]).view("<u4").ravel()
    width, extra = raw[at + 4], raw[at + 5].astype(np.int64)
    out = np.zeros((n, BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        kind = np.uint16 if w <= 16 else np.uint32
        some = np.zeros((len(rows), BLOCK), dtype=kind)
        for b in range(int(w)):
            plane = raw[at[rows][:, None] + 6 + BLOCK // 8 * b + np.arange(BLOCK // 8)]
            some |= np.unpackbits(plane, axis=1, bitorder="little").astype(kind) << kind(b)
        out[rows] = some
    row = np.repeat(np.arange(n), extra)
    if len(row):
        rank = np.arange(len(row)) - np.repeat(np.cumsum(extra) - extra, extra)
        to = at[row] + 6 + BLOCK // 8 * width[row].astype(np.int64)
        high = np.ascontiguousarray(raw[(to + extra[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").ravel()
        out[row, raw[to + rank]] |= high << width[row]
    return (out + least[:, None]).ravel()[:n_ids].astype("<u4")


def write_file(path: str, ids: list[int | None], sizes: np.ndarray, tokens: np.ndarray) -> int:
    """Writes one file (through pyarrow's file systems) and returns its number of ids."""
    docs = np.zeros(len(ids), dtype=DOC)
    docs["id"] = [0 if i is None else i for i in ids]
    docs["n"] = sizes
    docs["flags"] = [i is None for i in ids]
    blocks, starts = pack(tokens)
    store, name = file_system(path)
    with store.open_output_stream(name) as f:
        f.write(MAGIC + struct.pack("<4Q", len(docs), int(docs["n"].sum()), len(starts) - 1, len(blocks)))
        f.write(docs.tobytes() + starts.tobytes())
        f.write(blocks)
    return int(docs["n"].sum())


def read_file(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The document rows and all ids of one file."""
    store, name = file_system(path)
    with store.open_input_stream(name) as f:
        raw = f.read()
    if raw[:8] != MAGIC:
        raise ValueError(f"{path} is no file of token ids")
    n, total, blocks, _ = struct.unpack_from("<4Q", raw, 8)
    docs = np.frombuffer(raw, dtype=DOC, count=n, offset=40)
    at = 40 + n * DOC.itemsize
    starts = np.frombuffer(raw, dtype="<u8", count=blocks + 1, offset=at)
    return docs, unpack(raw[at + 8 * (blocks + 1) :], starts, total)


def _slices(texts: pa.StringArray, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about ``most`` bytes together."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, side="right")))
        yield low, high
        low = high


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, file_ids: int = 4_000_000, parts: int | None = None) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) and returns the manifest: path, part, seq, n_ids, start."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    make_folder(spark, folder)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = Encoder.load(tokenizer), TaskContext.get().partitionId()
        ids, sizes, tokens, held, seq = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, sizes, tokens, held, seq
            path = f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.pfor"
            n = write_file(path, ids, np.concatenate(sizes), np.concatenate(tokens))
            ids, sizes, tokens, held, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict({"path": [path], "part": pa.array([part], pa.int32()), "seq": pa.array([seq - 1], pa.int32()), "n_ids": [n]})

        for batch in it:
            for low, high in _slices(batch.column(1)):
                coded, n = encoder.encode(batch.column(1).slice(low, high - low), end_id)
                ids += batch.column(0).slice(low, high - low).to_pylist()
                sizes.append(n)
                tokens.append(coded)
                held += len(coded)
                if held >= file_ids:
                    yield flush()
        if ids:
            yield flush()
        release()

    key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("_h"))
    order = [F.asc_nulls_first("doc_id"), F.asc("_h")]
    rows = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    rows = rows.sortWithinPartitions(*order).select("doc_id", "text")
    manifest = materialize(rows.mapInArrow(batches, "path string, part int, seq int, n_ids long"), "manifest")
    # One row per file of millions of ids, so the running sum in one task stays small.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, start in zip(pdf["path"], pdf["start"], strict=True):
                docs, ids = read_file(path)
                n = docs["n"].astype(np.int64)
                stop = n.cumsum()
                crc = [zlib.crc32(ids[b - k : b].tobytes()) for b, k in zip(stop, n, strict=True)]
                doc_id = pd.array(docs["id"], dtype="Int64")
                doc_id[docs["flags"] == 1] = pd.NA
                yield pd.DataFrame({"doc_id": doc_id, "start": start + stop - n, "n_tokens": n, "ids_crc32": crc})

    files = manifest.repartition(max(1, manifest.count()), "path")
    return files.mapInPandas(batches, "doc_id long, start long, n_tokens long, ids_crc32 long")
